"""What the operators share: reading tables, and cutting a plan in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            return kept.get()
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there and every executor can reread it.

    tasks: where df is known to be small, in so many tasks and files at most.
    """
    spark = df.sparkSession
    path = fresh(spark, name)
    (df.coalesce(tasks) if tasks else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of one Arrow batch: texts of some thousand characters in it stay within a few MB in either process.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches to BATCH_ROWS rows, so that tasks hold few texts at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """What earlier batches took of a worker's memory and no longer use, Arrow gives back to the machine. A worker lives on after its task, and Arrow keeps some 50 MB otherwise."""
    pa.default_memory_pool().release_unused()


def sized(df: DataFrame, most_rows: int) -> DataFrame:
    """df (written before, so counting is cheap) marked for a broadcast if it has at most most_rows rows, else for a merge join."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= most_rows else df.hint("merge")
