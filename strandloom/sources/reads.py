"""Reads and query lists as DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codec import check_k, checked_query
from .fastq import register

#: The letters and the blank of text, and the base that stands for each. All other characters become N.
TEXT_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz "
TEXT_TO = "ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTACT"

NUMBERED = T.StructType([T.StructField("path", T.StringType()), T.StructField("line", T.LongType()), T.StructField("text", T.StringType())])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text) of text files, lines counted from 0 in each file.

    Lines end at \\n alone. A file is cut into splits as any text is; the row's place in its split, after the number of
    lines in the splits before it, is its number. The counts are one row for each split, so they are broadcast and no line is shuffled.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text")
    )
    per_block = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # A window over the splits of one file: a row for each 128 MB.
    before = F.expr("coalesce(sum(n) over (partition by path order by block rows between unbounded preceding and 1 preceding), 0)")
    starts = per_block.select("path", "block", "first", before.alias("before"))
    return lines.join(F.broadcast(starts), ["path", "block"]).select("path", (F.col("before") + F.col("at") - F.col("first")).alias("line"), "text")


def _split_bytes(spark: SparkSession) -> int:
    return spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def scan_fastq(spark: SparkSession, path: str, columns: str = "seq string", *, mode: str = "strict") -> DataFrame:
    """Records of FASTQ files in one pass, without numbers; see sources.fastq for the columns and modes."""
    register(spark)
    return spark.read.format("fastq").schema(columns).options(mode=mode, split_bytes=_split_bytes(spark)).load(path)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(path, read_id, seq): the second of each four lines, whatever the others hold. Blank lines count; gzip files are read as they are.

    A first pass counts the lines of each range of bytes, one row for each to the driver; the second reads. Nothing is shuffled.
    """
    register(spark)
    size, before = _split_bytes(spark), {}
    for r in sorted(spark.read.format("newlines").option("split_bytes", size).load(path).collect()):
        done = before.setdefault(r["path"], [0])
        done.append(done[-1] + r["n"])
    options = {"mode": "lines", "split_bytes": size, "lines_before": json.dumps(before)}
    return spark.read.format("fastq").schema("path string, read_id long, seq string").options(**options).load(path)


def reads_from_text(df: DataFrame, *key: str, text: str = "text") -> DataFrame:
    """(key..., line, seq): each line of a text column as a read, letters and blanks mapped to bases."""
    rows = df.select(*key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "raw"))
    return rows.select(*key, F.col("line").cast("long").alias("line"), F.regexp_replace(F.translate("raw", TEXT_FROM, TEXT_TO), "[^ACGT]", "N").alias("seq"))


def read_queries(spark: SparkSession, path: str, k: int, n: int) -> DataFrame:
    """(qid, kmer) of the first n lines of a file: each one's first k characters.

    An error if fewer lines are there, if they are of several files, or if a line has fewer than k bases or another character among them.
    """
    check_k(k)
    lines = numbered_lines(spark, path).where(F.col("line") < n)
    if len(files := [r[0] for r in lines.select("path").distinct().limit(2).collect()]) > 1:
        raise ValueError(f"a query list is one file, but {path} has {' and '.join(files)}")
    if (there := lines.count()) < n:
        raise ValueError(f"{path} has {there} query lines of {n}")
    return lines.select(F.col("line").cast("int").alias("qid"), checked_query(F.col("text"), k).alias("kmer"))
