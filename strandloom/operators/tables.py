"""Count tables: stored, loaded, changed in place, merged, measured. What a stored table consists of is in operators.versions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import PARTITIONS, check_k, decode_kmer, encode_kmer, partition_id
from ..sources.files import written
from . import versions
from .versions import Entry, latest, vacuum  # noqa: F401

STORED = "enc long, cnt long, version string, part int"
#: Pairs of one flat array.
FLAT_PAIRS = 1 << 16
#: Values that a filter names one by one, and ranges that it names beyond that.
MOST_VALUES, MOST_RANGES = 200, 64


def partitioned(counts: DataFrame, k: int, partitions: int = PARTITIONS, by: str = "middle") -> DataFrame:
    """(k, kmer, enc, cnt, part)."""
    rows = counts if "enc" in counts.columns else counts.withColumn("enc", encode_kmer(F.col("kmer")))
    return rows.select(F.lit(check_k(k)).alias("k"), "kmer", "enc", "cnt", partition_id(F.col("enc"), k, partitions, by).alias("part"))


def _write(rows: DataFrame, path: str) -> str:
    """Rows (enc, cnt, part) as a new version, which no entry names yet. Tasks are balanced by size: a large part is several files, small parts share a task. Each file is sorted by enc."""
    version = versions.new_version()
    rows = rows.select("enc", "cnt", "part").hint("rebalance", "part").sortWithinPartitions("part", "enc")
    rows.write.partitionBy("part").parquet(f"{path}/{versions.VERSION}={version}")
    return version


def _known(spark: SparkSession, path: str, k: int, partitions: int | None = None) -> Entry:
    entry = latest(spark, path)
    if entry is None:
        raise ValueError(f"{path} is no stored table")
    if entry.k != check_k(k):
        raise ValueError(f"{path} holds counts for k = {entry.k}, not {k}")
    if partitions not in (None, entry.partitions):
        raise ValueError(f"{path} has {entry.partitions} parts, not {partitions}")
    return entry


def save(counts: DataFrame, k: int, path: str, *, partitions: int = PARTITIONS, mode: str = "overwrite", batch: tuple[str, int] | None = None) -> None:
    """A stored table of counts. mode 'append' adds rows to one; added_up() makes one row of equal k-mers when it is read, compact() when it is stored.

    batch is the name and number of a batch of a stream or job: a table that has taken in this one or a later one of that name stays as it is.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode is 'overwrite' or 'append', not {mode!r}")
    spark, path = counts.sparkSession, path.rstrip("/")
    before = latest(spark, path)
    if mode == "append" and before:
        _known(spark, path, k, partitions)
    if batch and before and before.done.get(batch[0], -1) >= batch[1]:
        return
    version = _write(partitioned(counts, k, partitions), path)
    kept = before.versions if before and mode == "append" else {}
    added = {p: kept.get(p, []) + [version] for p in versions.parts_in(spark, path, version)}
    done = (before.done if before and mode == "append" else {}) | (dict([batch]) if batch else {})
    versions.commit(spark, path, Entry(k, partitions, kept | added, done), before)


def load(spark: SparkSession, path: str, k: int, parts: list[int] | None = None) -> DataFrame:
    """(k, kmer, enc, cnt, part) of a stored table; an error if it was made for another k. Only the folders of parts are listed and read."""
    path = path.rstrip("/")
    entry = _known(spark, path, k)
    chosen = entry.versions if parts is None else {p: v for p, v in entry.versions.items() if p in set(parts)}
    table = _read(spark, path, k, chosen)
    return table.where(F.col("part").isin(parts)) if parts is not None else table


def _read(spark: SparkSession, path: str, k: int, chosen: dict[int, list[str]]) -> DataFrame:
    folders = versions.folders(path, chosen)
    rows = spark.read.schema(STORED).option("basePath", path).parquet(*folders) if folders else spark.createDataFrame([], STORED)
    return rows.select(F.lit(k).alias("k"), decode_kmer(F.col("enc"), k).alias("kmer"), "enc", "cnt", "part")


def upsert(counts: DataFrame, k: int, path: str, *, batch: tuple[str, int] | None = None) -> list[int]:
    """Add counts to a stored table: those of k-mers that it has are added up, others are put in. The parts that were written again.

    Other parts keep their files. A change that fails leaves the table as it was; one that ran already, by its batch, isn't run again.
    """
    spark, path = counts.sparkSession, path.rstrip("/")
    before = _known(spark, path, k)
    if batch and before.done.get(batch[0], -1) >= batch[1]:
        return []
    # Written first, so that counts are made once and their parts are known.
    news = _write(partitioned(counts, k, before.partitions), path)
    touched = versions.parts_in(spark, path, news)
    mixed = {p: before.versions.get(p, []) + [news] for p in touched}
    merged = {}
    if touched:
        version = _write(_summed(_read(spark, path, k, mixed)), path)
        merged = {p: [version] for p in touched}
    versions.commit(spark, path, Entry(k, before.partitions, before.versions | merged, before.done | (dict([batch]) if batch else {})), before)
    versions.delete(spark, f"{path}/{versions.VERSION}={news}")
    return touched


def compact(spark: SparkSession, path: str, k: int, *, least: int = 2) -> list[int]:
    """One version, and one row for each k-mer, of the parts that consist of at least so many. The parts that were written again."""
    path = path.rstrip("/")
    before = _known(spark, path, k)
    many = {p: v for p, v in before.versions.items() if len(v) >= least}
    if many:
        version = _write(_summed(_read(spark, path, k, many)), path)
        versions.commit(spark, path, Entry(k, before.partitions, before.versions | {p: [version] for p in many}, before.done), before)
    return sorted(many)


def added_up(table: DataFrame) -> DataFrame:
    """A stored table to which counts were appended, with one row for each k-mer."""
    return table.groupBy("k", "kmer", "enc", "part").agg(F.sum("cnt").alias("cnt")).select("k", "kmer", "enc", "cnt", "part")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part", "enc").agg(F.sum("cnt").alias("cnt"))


def among(enc: Column, values: np.ndarray) -> Column:
    """Whether enc may be one of values (sorted): they themselves if they are few, else ranges that hold them all, parted at the widest gaps. Either goes down to Parquet, whose pages are skipped by it."""
    if len(values) <= MOST_VALUES:
        return enc.isin(values.tolist()) if len(values) else F.lit(False)
    cuts = np.sort(np.argsort(np.diff(values))[-(MOST_RANGES - 1) :])
    lows, highs = values[np.append(0, cuts + 1)], values[np.append(cuts, len(values) - 1)]
    out = F.lit(False)
    for low, high in zip(lows.tolist(), highs.tolist(), strict=True):
        out = out | enc.between(low, high)
    return out


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """(kmer, cnt) of two count tables added up."""
    both = a.select("kmer", "cnt").unionByName(b.select("kmer", "cnt"))
    return both.groupBy("kmer").agg(F.sum("cnt").alias("cnt"))


def flat(counts: DataFrame, pairs: int = FLAT_PAIRS) -> DataFrame:
    """(part, chunk, offset, pairs): each part's keys and counts in turn, in the order of keys, as arrays of so many pairs at most; offset is the number of pairs before.

    Rows are put in order by ranges of (part, enc), so a large part is many tasks; the pairs before each range are counted, a row for each part and range.
    """
    if pairs < 1:
        raise ValueError(f"an array has one pair at least, not {pairs}")
    order = counts.select("part", "enc", "cnt").repartitionByRange("part", "enc").sortWithinPartitions("part", "enc")
    # The id is the range's number and the row's place in it.
    rows = written(order.withColumn("id", F.monotonically_increasing_id()), "flat-order").withColumn("range", F.shiftright("id", 33))
    before = F.expr("sum(n) over (partition by part order by range) - n")
    ranges = rows.groupBy("part", "range").agg(F.count("*").alias("n"), F.min("id").alias("first")).select("part", "range", "first", before.alias("before"))
    at = F.col("before") + F.col("id") - F.col("first")
    placed = rows.join(F.broadcast(ranges), ["part", "range"]).select("part", "enc", "cnt", at.alias("at"))
    found = placed.groupBy("part", F.floor(F.col("at") / pairs).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("enc", "cnt"))).alias("p"))
    return found.select("part", "chunk", (F.col("chunk") * pairs).alias("offset"), F.flatten(F.transform("p", lambda x: F.array(x["enc"], x["cnt"]))).alias("pairs"))


def from_flat(arrays: DataFrame, k: int) -> DataFrame:
    """(enc, cnt) of arrays of keys and counts in turn."""
    at = F.sequence(F.lit(0), F.greatest(F.size("pairs") - 2, F.lit(0)), F.lit(2))
    rows = arrays.where("size(pairs) > 1").select(F.explode(F.transform(at, lambda i: F.struct(F.get("pairs", i).alias("enc"), F.get("pairs", i + 1).alias("cnt")))).alias("x"))
    return rows.select("x.enc", "x.cnt")


def merge_flat(counts: DataFrame, arrays: DataFrame, k: int) -> DataFrame:
    """(kmer, cnt) of a count table with the counts of flat arrays added."""
    return merge(counts, from_flat(arrays, k).select(decode_kmer(F.col("enc"), k).alias("kmer"), "cnt"))


def partition_stats(counts: DataFrame, k: int, partitions: int = PARTITIONS, by: str = "middle") -> DataFrame:
    """(part, distinct_kmers, total)."""
    return partitioned(counts, k, partitions, by).groupBy("part").agg(F.count("*").alias("distinct_kmers"), F.sum("cnt").alias("total"))


def totals(counts: DataFrame) -> DataFrame:
    """(distinct_kmers, total, largest)."""
    return counts.agg(F.count("*").alias("distinct_kmers"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"), F.coalesce(F.max("cnt"), F.lit(0)).alias("largest"))
