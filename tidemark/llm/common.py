"""What the corpus operators share: tables, the shared folder and batch helpers."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Java and Python spelling of the word class of every contract here: runs of anything but
#: space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


#: Rows that a function over batches works on at once.
ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see.

    It is read from spark.checkpoint.dir; only where that is unset (tests on one machine) a
    folder of this machine is chosen.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("tidemark.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file:/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("tidemark.shared.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    # batches to Python workers of ROWS rows, so that whole texts take little memory beside the heap
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete what cut() wrote, once nothing reads it any more."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def free(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs now: it does so when the driver collects their plans."""
    gc.collect()
    spark._jvm.System.gc()


def map_batches(
    df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]
) -> DataFrame:
    """mapInArrow with state per task: make() is called once in each task and gives the batch function, which sees ROWS rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                if (out := step(batch.slice(at, ROWS))) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, so extra ones with clashing names never reach an operator."""
    return df.select(*[F.col(f"`{n}`") for n in names])
