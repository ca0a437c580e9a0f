"""Run folders: manifest.json plus one file per view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import extract_phrase, parse_day
from tidemark.operators import contract

MANIFEST = (
    "phrase STRING, region STRING, created_at STRING, source_url STRING, "
    "exports ARRAY<STRUCT<view: STRING, file: STRING, raw_file: STRING, row_count: INT, dtypes: MAP<STRING, STRING>>>, _corrupt_record STRING"
)
RAW_MONTHLY = "raw_period STRING, raw_queries STRING, raw_share STRING, raw_title STRING"


class ManifestError(ValueError):
    """A manifest is missing or cannot be read."""


class EmptyDatasetError(ValueError):
    """A monthly export has no rows."""


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """run_dir and manifest fields of every run below root; unreadable ones keep their _corrupt_record.

    ManifestError if there is no manifest at all.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise ManifestError(f"no run folders at {root}")
    df = spark.read.schema(MANIFEST).option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").json(root, multiLine=True)
    return df.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("run_dir"), "*")


def export_file(exports, view: str):
    """File of a view in a manifest, NULL if it has none."""
    return F.get(F.filter(exports, lambda e: e["view"] == view), F.lit(0))["file"]


def raw_monthly(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """source and the four raw fields of monthly CSVs: BOM, CR line ends, semicolons."""
    df = spark.read.schema(RAW_MONTHLY).csv(paths, sep=";", header=True, lineSep="\r", enforceSchema=True)
    return df.select(F.col("_metadata.file_path").alias("source"), "*").where(F.concat_ws("", "raw_period", "raw_queries", "raw_share") != "")


def load_monthly(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """source, period, queries, share_pct; EmptyDatasetError if no row is there."""
    rows = contract.parsed(raw_monthly(spark, paths))
    if not rows.limit(1).count():
        raise EmptyDatasetError(f"no rows in {paths}")
    return rows


def load_runs(spark: SparkSession, root: str, view: str = "dynamics") -> DataFrame:
    """phrase, region, period, queries, share_pct, created_at of the latest run of each phrase."""
    from tidemark.operators.graph import latest_run

    m = latest_run(manifests(spark, root).where("phrase IS NOT NULL")).withColumn("file", export_file(F.col("exports"), view)).where("file IS NOT NULL")
    csv = spark.read.schema(RAW_MONTHLY).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(root, sep=";", header=True, lineSep="\r", enforceSchema=True)
    csv = csv.select(F.col("_metadata.file_path").alias("source"), "*")
    rows = contract.parsed(csv)
    wanted = m.select("phrase", "region", "created_at", F.concat_ws("/", "run_dir", "file").alias("source"))
    return rows.join(wanted, "source").select("phrase", "region", "period", "queries", "share_pct", F.to_timestamp("created_at").alias("created_at"))


def load_daily(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """phrase, day, count of daily CSVs; the phrase stands in the header's chart title."""
    text = spark.read.text(paths, lineSep="\r").select(F.col("_metadata.file_path").alias("source"), "value")
    title = text.where(F.col("value").contains("«")).groupBy("source").agg(F.max(extract_phrase(F.col("value"))).alias("phrase"))
    parts = F.split("value", ";")
    rows = text.select("source", parse_day(F.get(parts, F.lit(0))).alias("day"), contract.parse_queries(F.get(parts, F.lit(1))).cast("double").alias("count"))
    return rows.where("day IS NOT NULL").join(title, "source").select("phrase", "day", "count")


def edges(spark: SparkSession, root: str) -> DataFrame:
    """src, dst, frequency from top_related parquet of each phrase's latest run; columns are found by prefix."""
    from tidemark.operators.graph import clean_edges, latest_run

    found = latest_run(manifests(spark, root).where("phrase IS NOT NULL")).withColumn("file", export_file(F.col("exports"), "top_related"))
    found = found.where("file IS NOT NULL").select("phrase", F.concat_ws("/", "run_dir", "file").alias("path"))
    files = found.select("path").distinct()
    # columns are named after the phrase, so each file is read with its own schema, in the tasks that hold its bytes
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root)
    # an export is a file, or a folder of files
    raw = raw.select(F.explode(F.array("path", F.regexp_replace("path", r"/[^/]*\.parquet$", ""))).alias("path"), "content")
    parts = files.join(raw, "path")
    rows = parts.select("path", "content").mapInArrow(_related_rows, "path string, dst string, frequency string")
    return clean_edges(rows.join(found, "path").select(F.col("phrase").alias("src"), "dst", "frequency"))


#: How the two columns of a file of related phrases begin.
RELATED, COUNTED = "Запросы со словами", "Число запросов"


def _related_rows(batches):
    """path and content of parquet files -> path, dst, frequency as text."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            table = pq.read_table(pa.BufferReader(content))
            named = [next((c for c in table.column_names if c.startswith(x)), None) for x in (RELATED, COUNTED)]
            if None in named:
                raise ManifestError(f"{path}: no column that begins with {RELATED!r} or {COUNTED!r}")
            dst, count = (table.column(c).combine_chunks().cast(pa.string()) for c in named)
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(dst), pa.string()), dst, count], names=["path", "dst", "frequency"])


def has_export(spark: SparkSession, root: str, view: str) -> DataFrame:
    """phrase, available: keeps 'no data yet' apart from 'no rows'."""
    return manifests(spark, root).groupBy("phrase").agg(F.max(export_file(F.col("exports"), view).isNotNull()).alias("available"))


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """phrase of each line that is neither blank nor a # comment."""
    t = spark.read.text(path).select(F.trim("value").alias("phrase"))
    return t.where((F.col("phrase") != "") & ~F.col("phrase").startswith("#"))


def run_status(outcomes: DataFrame) -> DataFrame:
    """collected, failed, last_error over outcomes (phrase, at, error): one row, zeros and NULL if there are none.

    The last error is that of the latest failure, ties by phrase.
    """
    failed = F.col("error").isNotNull()
    last = F.max_by("error", F.when(failed, F.struct("at", "phrase")))
    return outcomes.agg(F.count_if(~failed).alias("collected"), F.count_if(failed).alias("failed"), last.alias("last_error"))


def dataset_digest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, size, sha256 of files."""
    f = spark.read.format("binaryFile").load(paths)
    return f.select(F.regexp_extract("path", "[^/]*$", 0).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def run_violations(spark: SparkSession, root: str) -> DataFrame:
    """source, check, severity: manifests that cannot be read, and views that are missing."""
    m = manifests(spark, root)
    bad = m.where("_corrupt_record IS NOT NULL OR phrase IS NULL").select(F.col("run_dir").alias("source"), F.lit("manifest").alias("check"), F.lit("error").alias("severity"))
    none = m.where(F.col("phrase").isNotNull() & export_file(F.col("exports"), "dynamics").isNull()).select(F.col("run_dir"), F.lit("dynamics"), F.lit("error"))
    views = m.where("phrase IS NOT NULL").select("run_dir", F.explode("exports").alias("e")).where(F.col("e.view").isin("top_popular", "top_related") & (F.col("e.row_count") > 0))
    return bad.union(none).union(views.select("run_dir", F.concat(F.lit("not-empty:"), "e.view"), F.lit("info")))
