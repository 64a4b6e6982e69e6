"""Looking up a list of k-mers in a count table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codec import PARTITIONS, canonical, encode_kmer, partition_id
from .kmers import counts_of
from .tables import among, load
from .versions import Entry, latest

#: Query lists are broadcast up to this number of rows, beyond it they are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def parts_of(queries: DataFrame, k: int, partitions: int = PARTITIONS) -> list[int]:
    """The folders of a stored table that a query list needs, at most `partitions` numbers."""
    part = partition_id(encode_kmer(F.col("kmer")), k, partitions)
    return sorted(r[0] for r in queries.select(part).distinct().collect())


def _asked(queries: DataFrame, mode: str) -> DataFrame:
    """(qid, kmer, _key): the k-mer that a query stands for."""
    if mode not in ("exact", "canonical"):
        raise ValueError(f"mode is 'exact' or 'canonical', not {mode!r}")
    return queries.select("qid", "kmer", (canonical(F.col("kmer")) if mode == "canonical" else F.col("kmer")).alias("_key"))


def lookup(counts: DataFrame, queries: DataFrame, *, mode: str = "exact", dup: str = "all") -> DataFrame:
    """(qid, kmer, cnt) for each query (qid, kmer), 0 for k-mers without a count.

    mode 'exact' looks for the k-mer as it is typed, so one that is not canonical has 0; 'canonical' for its canonical
    form. dup 'last' gives 0 to all but the last of equal queries.
    """
    if dup not in ("all", "last"):
        raise ValueError(f"dup is 'all' or 'last', not {dup!r}")
    asked = _asked(queries, mode)
    few = asked.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    keys = asked.select("_key").distinct()
    # A left join can't broadcast its left side: the table is first reduced to what is asked for.
    if "enc" in counts.columns:
        hits = counts.select("enc", "cnt").join(F.broadcast(_encoded(keys)) if few else _encoded(keys), "enc").select("_key", "cnt")
    else:
        hits = counts.select(F.col("kmer").alias("_key"), "cnt").join(F.broadcast(keys) if few else keys, "_key")
    out = asked.join(hits, "_key", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)).cast("long"))
    if dup == "last":
        # Ties of one text are as many as its repetitions in the query list.
        last = F.max("qid").over(Window.partitionBy("kmer"))
        out = out.withColumn("cnt", F.when(F.col("qid") == last, F.col("cnt")).otherwise(0).cast("long"))
    return out.select("qid", "kmer", "cnt")


def _encoded(keys: DataFrame) -> DataFrame:
    return keys.select("_key", encode_kmer(F.col("_key")).alias("enc"))


def lookup_stored(spark: SparkSession, path: str, queries: DataFrame, k: int, *, mode: str = "exact", dup: str = "all") -> DataFrame:
    """lookup() in a stored table, of which only the parts and pages that may hold a query are read.

    Queries up to MOST_BROADCAST are listed as integers, eight bytes each, to make the filter; longer lists read their parts whole. Counts that
    were appended are added up for the k-mers that are asked for.
    """
    keys = _encoded(_asked(queries, mode).select("_key").distinct()).select("enc")
    values = np.array([r[0] for r in keys.limit(MOST_BROADCAST + 1).collect()], np.int64)
    if len(values) > MOST_BROADCAST:
        table = load(spark, path, k)
    else:
        values = np.sort(values)
        entry_parts = sorted(set(_part_numbers(values, k, latest(spark, path.rstrip("/")))))
        table = load(spark, path, k, entry_parts).where(among(F.col("enc"), values))
    found = table.select("enc", "cnt").join(keys if len(values) > MOST_BROADCAST else F.broadcast(keys), "enc", "left_semi")
    return lookup(found.groupBy("enc").agg(F.sum("cnt").alias("cnt")), queries, mode=mode, dup=dup)


def _part_numbers(values: np.ndarray, k: int, entry: Entry | None) -> list[int]:
    # An absent table is load()'s error.
    return ((values >> k // 2) % (entry.partitions if entry else PARTITIONS)).tolist()


def count_and_lookup(reads: DataFrame, queries: DataFrame, k: int, *, mode: str = "exact", dup: str = "all") -> DataFrame:
    """lookup() in the counts of reads, of which only those of the queries are made."""
    asked = _asked(queries, mode)
    return lookup(counts_of(reads, asked.select(F.col("_key").alias("kmer")), k), queries, mode=mode, dup=dup)


def write_result(result: DataFrame, path: str, *, one_file: bool = False) -> None:
    """kmer and count by tab, in query order; over several files in their order, or for lists of a file's size in one."""
    rows = result.orderBy("qid").select("kmer", "cnt")
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").csv(path, sep="\t")
