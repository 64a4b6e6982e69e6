"""Counts over a stream of reads: in the state of the stream, or in a stored table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import PARTITIONS, check_k
from ..operators import kmers, tables
from ..sources.fastq import register

#: Batches after which the parts that they were appended to are put together.
COMPACT_EVERY = 20


def stream_reads(spark: SparkSession, folder: str) -> DataFrame:
    """(seq): one read for each line of the text files that arrive in a folder."""
    return spark.readStream.text(folder).select(F.col("value").alias("seq"))


def stream_fastq(spark: SparkSession, folder: str, log: str) -> DataFrame:
    """(seq): the reads of FASTQ files that arrive in a folder; log is a folder of the source's own."""
    register(spark)
    return spark.readStream.format("fastq").schema("seq string").option("log", log).load(folder)


def stream_counts(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, cnt) so far.

    A task counts its windows before anything is shuffled, so a row for each k-mer and task meets the state. There is no event time: the state holds a
    row of two integers (some 100 bytes with the store's own) for each k-mer that ever came, shared out over the shuffle partitions. stream_into_table() has no state.
    """
    return kmers.count(reads, k)


def run_available(counts: DataFrame, folder: str) -> DataFrame:
    """(kmer, cnt) after all that has arrived. Each batch appends the counts that it changed under folder; a count only grows.

    A batch that runs again after a failure overwrites its own folder, so nothing is doubled.
    """
    run = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{run}/changed/batch={number}")

    query = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{run}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    changed = counts.sparkSession.read.schema(counts.schema).option("recursiveFileLookup", "true").parquet(f"{run}/changed")
    return changed.groupBy("kmer").agg(F.max("cnt").alias("cnt"))


def stream_into_table(reads: DataFrame, k: int, path: str, progress: str, *, stream: str = "stream", partitions: int = PARTITIONS) -> None:
    """Take all that has arrived into the stored table at path, batch by batch, and return; run again for what arrives later.

    Each batch appends its counts with its number, so one that runs again after a failure is not taken in twice, and no count is kept as state.
    After COMPACT_EVERY batches the table's parts are put together. progress is the stream's own folder; stream names it in the table.
    """
    check_k(k)

    def take(batch: DataFrame, number: int) -> None:
        tables.save(kmers.count(batch, k, enc=True), k, path, mode="append", partitions=partitions, batch=(stream, number))
        tables.compact(batch.sparkSession, path, k, least=COMPACT_EVERY)

    query = reads.writeStream.foreachBatch(take).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
