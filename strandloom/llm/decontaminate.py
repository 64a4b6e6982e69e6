"""Benchmark decontamination by size-partitioned MinHash containment search.

A document contains a test item if at least `share` of the item's shingles stand in it. Shingles have five words; an item
of fewer words is one shingle of its own width, which is looked for in documents at that width. Of a document only
the shingles that some item has are kept, which changes no intersection. Documents are partitioned by how many are
left, items by size. For each pair of partitions the least Jaccard similarity that such a containment implies fixes the
number of MinHash values, each a band of its own, so that a containing document is missed with a chance under MISS.
Bands that agree propose pairs; the exact count of shared shingles decides.
Where a partition would need over MOST_BANDS values (a small item in a document with very many kept shingles), the kept
shingles are looked up instead: of an item's first shingles, one more than it may lack, one at least is in the document.

Items are dealt into blocks of some BLOCK shingles, each block against all documents, so what is broadcast stays
bounded however large the benchmark grows; the items themselves stay a table.

Words are runs of ASCII letters and digits, in lower case, and of characters beyond ASCII. Defined results: null and
empty texts contain nothing and are contained nowhere; of items or documents that repeat an id each row is searched for itself, and the pair
of rows that shares most stands for the ids; an empty table gives an
empty one; extra columns are not used by find() and pass through drop_contaminated().
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from ._common import cut, sized, unused

WIDTH = 5
SHARE = 0.8
MISS = 1e-9
MOST_BANDS = 256
BLOCK = 4_000_000
#: Ids of contaminated documents that are broadcast at most, beyond it they are joined by a shuffle.
MOST_BROADCAST = 500_000
SEEDS = 0xA0761D6478BD642F


def _set_rows(texts: DataFrame) -> DataFrame:
    """(item_id, hashes, width): the shingles of an item and their number of words."""

    def batches(parts):
        for part in parts:
            words = [S.words((t.as_py() or "").encode("utf-8", "surrogatepass"), S.BY_LETTER) for t in part.column(1)]
            sets = [S.shingles(w, WIDTH) for w in words]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            width = pa.array([min(WIDTH, len(w)) for w in words], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), width], names=["item_id", "hashes", "width"])

    return texts.mapInArrow(batches, "item_id long, hashes array<long>, width int")


def n_bands(item_size: int, most_left: int, share: float) -> int:
    """MinHash values such that an item of this size in a document with at most most_left kept shingles is missed with a chance under MISS."""
    need = math.ceil(share * item_size)
    jaccard = need / (item_size + max(most_left, need) - need)
    return 1 if jaccard >= 1 else math.ceil(math.log(MISS) / math.log(1 - jaccard))


def minhashes(values: np.ndarray, first: int, last: int) -> np.ndarray:
    """MinHash values number first to last - 1 of a set."""
    seeds = S.mix(np.arange(first, last, dtype=np.uint64) * np.uint64(SEEDS))
    out = np.full(last - first, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(values), 256):
        np.minimum(out, S.mix(values[a : a + 256, None] ^ seeds).min(0), out=out)
    return out


def first_shingles(values: np.ndarray, share: float) -> np.ndarray:
    """So many shingles of an item that one is in any document that contains it."""
    return values[: len(values) - math.ceil(share * len(values)) + 1]


def _search(docs: DataFrame, items: DataFrame, share: float) -> DataFrame:
    spark = docs.sparkSession
    known = np.unique(items.select(F.explode("hashes").alias("h")).distinct().toArrow().column(0).to_numpy().view(np.uint64))
    facts = items.select(F.size("hashes").alias("size"), "width").distinct().collect()
    sizes, widths = sorted({r["size"] for r in facts}), sorted({r["width"] for r in facts})
    least = min(math.ceil(share * s) for s in sizes)
    shared = spark.sparkContext.broadcast(known)

    def kept(parts):
        """(doc_id, values, kept, probed): MinHash values and the kept shingles of a document, and whether these are looked up."""
        own = shared.value
        for part in parts:
            ids, values, sets, probed = [], [], [], []
            for i, t in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                if i is None:
                    continue
                words = S.words((t.as_py() or "").encode("utf-8", "surrogatepass"), S.BY_LETTER)
                found = [S.shingles(words, w) for w in widths if len(words) >= w]
                found = [f[own[np.minimum(np.searchsorted(own, f), len(own) - 1)] == f] for f in found]
                found = np.sort(np.concatenate([*found, np.zeros(0, np.uint64)]))
                if not len(found) or len(found) < least:
                    continue
                most = 1 << (len(found) - 1).bit_length()
                bands = [n_bands(s, most, share) for s in sizes if math.ceil(share * s) <= most]
                ids.append(i)
                sets.append(found)
                values.append(minhashes(found, 0, max([n for n in bands if n <= MOST_BANDS], default=0)))
                probed.append(any(n > MOST_BANDS for n in bands))
            ends = lambda x: pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends(x), pa.array(np.concatenate([*x, np.zeros(0, np.uint64)]).view(np.int64))) for x in (values, sets)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *lists, pa.array(probed, pa.bool_())], names=["doc_id", "values", "kept", "probed"])

    # Pairs are told apart by rows until they are decided, as ids may repeat.
    left = docs.mapInArrow(kept, "doc_id long, values array<long>, kept array<long>, probed boolean")
    left = cut(left.withColumn("doc_row", F.monotonically_increasing_id()), "leaks-kept")
    most, largest, probed = left.agg(F.max(F.size("values")), F.max(F.size("kept")), F.max("probed")).first()
    ceiling = 1 << max(0, (largest or 1) - 1).bit_length()

    def signed(parts):
        """(item_row, band, value): an item's MinHash values, and in band -1 its first shingles where documents look them up."""
        for part in parts:
            for i, h in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                own = np.array(h.as_py(), np.int64).view(np.uint64)
                need = n_bands(len(own), ceiling, share)
                values = [minhashes(own, 0, min(most or 0, need))]
                bands = [np.arange(len(values[0]), dtype=np.int32)]
                if probed and need > MOST_BANDS:
                    values.append(first_shingles(own, share))
                    bands.append(np.full(len(values[1]), -1, np.int32))
                bands, values = np.concatenate(bands), np.concatenate(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bands), i, np.int64)), pa.array(bands), pa.array(values.view(np.int64))], names=["item_row", "band", "value"])

    bands = items.select("item_row", "hashes").mapInArrow(signed, "item_row long, band int, value long")
    asked = left.select("doc_row", F.posexplode("values").alias("band", "value")).unionByName(left.where("probed").select("doc_row", F.lit(-1).alias("band"), F.explode("kept").alias("value")))
    proposed = asked.join(bands, ["band", "value"]).select("doc_row", "item_row").distinct()
    both = proposed.join(left.select("doc_row", "doc_id", "kept"), "doc_row").join(items.select("item_row", "item_id", "hashes"), "item_row")
    counted = both.select("doc_id", "item_id", F.size("hashes").cast("long").alias("n_item"), F.size(F.array_intersect("hashes", "kept")).cast("long").alias("n_shared"))
    return counted.where(F.col("n_shared") >= F.ceil(F.col("n_item") * share))


def find(docs: DataFrame, benchmark: DataFrame, *, text="text", doc_id="doc_id", item_text="text", item_id="item_id", share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every document that contains a test item."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = _set_rows(benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))).where("size(hashes) > 0 and item_id is not null")
    items = cut(items.withColumn("item_row", F.monotonically_increasing_id()), "leaks-items")
    blocks = -(-(items.agg(F.sum(F.size("hashes"))).first()[0] or 0) // BLOCK)
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_item long, n_shared long")
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_row"), F.lit(blocks)) == k)
        if not block.isEmpty():
            out = out.unionByName(_search(docs, block, share))
    # Of rows that repeat both ids, the pair that shares most stands for all.
    best = F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_item", "n_shared"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.n_item", "x.n_shared", "x.containment")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, share: float = SHARE) -> DataFrame:
    """docs without those that contain a test item; all columns stay."""
    name = unused(docs, "_hit")
    hit = cut(find(docs, benchmark, share=share).select(F.col("doc_id").alias(name)).distinct(), "leaks-hit")
    return docs.join(sized(hit, MOST_BROADCAST), docs["doc_id"] == hit[name], "left_anti")


#: The same by counting, in DuckDB SQL.
ORACLE = rf"""
WITH t AS (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (SELECT k, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM t),
v AS (SELECT DISTINCT least(len(w), {WIDTH}) AS v FROM w WHERE k = 'i' AND len(w) > 0),
s AS (SELECT DISTINCT k, id, array_to_string(w[p:p + v - 1], ' ') AS s
      FROM (SELECT k, id, w, v, unnest(range(1, len(w) - v + 2)) AS p FROM w JOIN v ON len(w) >= v AND (k = 'd' OR v = least(len(w), {WIDTH})))),
n AS (SELECT id, count(*) AS n FROM s WHERE k = 'i' GROUP BY id),
c AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS c FROM s d JOIN s i ON d.s = i.s AND d.k = 'd' AND i.k = 'i' GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item, c AS n_shared, c::DOUBLE / n AS containment FROM c JOIN n ON n.id = item_id WHERE c >= ceil({SHARE} * n)
"""
