"""Packed reads: three bits for each base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import checked_header, pack_read, read_header, unpack_read, words_for


def pack(reads: DataFrame, *, seq: str = "seq") -> DataFrame:
    """reads with header and blocks in place of seq."""
    return reads.withColumn("header", read_header(F.col(seq))).withColumn("blocks", pack_read(F.col(seq))).drop(seq)


def unpack(packed: DataFrame, *, seq: str = "seq") -> DataFrame:
    return packed.withColumn(seq, unpack_read(F.col("header"), F.col("blocks"))).drop("header", "blocks")


def save(packed: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Packed reads as Parquet."""
    packed.write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Stored packed reads; an error where a header is none or doesn't fit its blocks. Null reads stay null."""
    packed = spark.read.parquet(path)
    header = F.when(F.col("header").isNotNull() | F.col("blocks").isNotNull(), checked_header(F.col("header"), F.col("blocks")))
    return packed.withColumn("header", header)


def packed_size(reads: DataFrame, *, seq: str = "seq") -> DataFrame:
    """(reads, bytes) that reads take when packed, from their lengths alone."""
    return reads.agg(F.count("*").alias("reads"), (F.coalesce(F.sum(words_for(F.col(seq))), F.lit(0)) * 4).alias("bytes"))
