"""Weekly blocks and latest runs over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_counts(events: DataFrame, key: str = "event_type", ts: str = "ts", late: str = "2 days") -> DataFrame:
    """key, week, n per Monday-to-Sunday block, with a watermark; works on batch and streaming input."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    e = e.withWatermark(ts, late) if e.isStreaming else e
    week = F.window(ts, "7 days", "7 days", "4 days")  # the epoch is a Thursday
    return e.groupBy(F.col(key).alias("phrase"), week.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("phrase", F.col("w.start").cast("date").alias("week"), "n")


def daily_counts(events: DataFrame, key: str = "event_type", ts: str = "ts", late: str = "1 day") -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    e = e.withWatermark(ts, late) if e.isStreaming else e
    return e.groupBy(F.col(key).alias("phrase"), F.window(ts, "1 day").alias("w")).agg(F.count(F.lit(1)).cast("double").alias("count")).select("phrase", F.col("w.start").cast("date").alias("day"), "count")


def upsert_latest(target: str):
    """A foreachBatch function that keeps the latest run of each phrase in a parquet folder of versions."""

    def run(batch: DataFrame, epoch: int) -> None:
        from tidemark.operators.graph import latest_run

        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        old = sorted(s.getPath().toString() for s in fs.listStatus(path)) if fs.exists(path) else []
        both = batch.unionByName(spark.read.parquet(old[-1])) if old else batch
        latest_run(both).write.mode("overwrite").parquet(f"{target}/v{epoch:010d}")

    return run
