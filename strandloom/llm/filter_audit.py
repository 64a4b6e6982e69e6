"""How text filters interact: what each removes, and would have removed, under every order in which they may run.

A document fails a set of filters, a bit mask. Under an order it is removed at the first step whose filter it fails: with
a matrix of masks (0 where a filter fails a mask's documents, else infinite) and one of places (the place of each filter
in each order, the inverse permutation), the removal step of every mask under every order is their product in which minimum
stands for the sum and the sum for the product. So documents are first added up by part and mask, at most 2 to
the number of filters for each part, and the steps say where these weights are counted.

Whole texts are filtered by expressions of the row; copies are told by SHA-256 of the text, and the smallest doc_id of each text is
one pre-aggregated row, met again by digest and doc_id together, so a text of a third of all rows is no hot key.

Nulls: a null text is the empty one; a null source is the part ''. A null doc_id is neither smaller than another nor has
it a smaller one, and has no labels. Empty texts fail A alone, and E if copied. Rows that repeat a doc_id and its text are no copies
of one another; all count. Several labels of one doc_id: it is good or toxic if one of them says so. No documents: no rows. Other columns are left alone.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, sized

#: Words are what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
NAMES = "ABCDE"
#: 2,000,000 labelled rows of 10 bytes are broadcast at most; more are joined by a shuffle.
MOST_LABELS = 2_000_000
#: Orders are all permutations, so filters are few.
MOST_FILTERS = 6
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def own_failures(text: Column, words: Column) -> dict[str, Column]:
    """Filters A to D, which see one text: too few words, too few different ones, many capitals, odd characters."""
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < 200, "B": 100 * different < 50 * n, "C": 100 * capitals > 2 * F.length(text), "D": text.rlike("[#$%&*|]")}


def failures(docs: DataFrame, *, part: str = "source") -> DataFrame:
    """(doc_id, salt, part, mask) of every row: bit i of mask is set if the document fails the i-th filter of NAMES."""
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    fails = own_failures(F.col("text"), F.col("words"))
    mask = sum((F.when(fails[f], 1 << i).otherwise(0) for i, f in enumerate("ABCD")), F.lit(0))
    # Null ids match nothing later on; their salts, fixed by the written table, keep them from meeting in one task.
    salt = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id() % 4096).otherwise(0)
    digest = F.unhex(F.sha2("text", 256))
    thin = cut(rows.select("doc_id", "part", mask.cast("int").alias("mask"), digest.alias("digest"), salt.cast("int").alias("salt")), "filter-masks")
    first = thin.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copied = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return thin.join(first, ["digest", "doc_id"], "left").select("doc_id", "salt", "part", (F.col("mask") + F.when(copied, 16).otherwise(0)).alias("mask"))


def labelled(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """masks with good and toxic, 0 or 1."""
    flag = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int"))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic")).where("good + toxic > 0")
    known = sized(cut(known, "filter-labels"), MOST_LABELS).withColumn("salt", F.lit(0))
    out = masks.join(known, ["doc_id", "salt"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})


def removal_steps(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For n filters: orders (orders x places, the filter at each), places (filters x orders, from 1) and steps (masks x orders; n + 1: kept)."""
    orders = np.array(list(permutations(range(n))))
    places = np.argsort(orders, axis=1).T + 1
    fails = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    masks = np.where(fails == 1, 0, n + 1)
    steps = np.min(masks[:, :, None] + places[None, :, :], axis=1)
    return orders, places, np.minimum(steps, n + 1)


def interactions(weights: np.ndarray, n: int) -> np.ndarray:
    """COUNTS of every part, order and step, from weights (parts x masks x (documents, good, toxic))."""
    orders, places, steps = removal_steps(n)
    parts, each = len(weights), np.arange(len(orders))
    removed = np.zeros((parts, len(orders), n + 1, 3), np.int64)
    redundant = np.zeros((parts, len(orders), n), np.int64)
    for mask in range(1, 1 << n):
        weight = weights[:, mask]
        removed[:, each, steps[mask] - 1] += weight[:, None, :]
        for f in range(n):
            if mask >> f & 1:
                late = places[f] > steps[mask]
                redundant[:, each[late], places[f][late] - 1] += weight[:, :1]
    removed = removed[:, :, :n]
    kept = weights[:, :, 0].sum(axis=1)[:, None, None] - removed[..., 0].cumsum(axis=2)
    unique = weights[:, 1 << orders, 0]
    shapley = np.stack([removed[:, each, places[f] - 1, 0].sum(axis=1) for f in range(n)], axis=1)[:, orders]
    return np.stack([kept, removed[..., 0], redundant, unique, removed[..., 1], removed[..., 2], shapley], axis=-1)


def audit(masks: DataFrame, names: str = NAMES) -> DataFrame:
    """(part, filter_order, step, COUNTS) of rows (part, mask, good, toxic): one row for each part, order and step."""
    n = len(names)
    if not 1 <= n <= MOST_FILTERS or len(set(names)) < n:
        raise ValueError(f"from 1 to {MOST_FILTERS} different letters are the names, not {names!r}")
    spelt = ["".join(names[f] for f in order) for order in permutations(range(n))]
    added = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    # No more entries than masks.
    by_part = added.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("w"))

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                few = batch.slice(at, 64)
                weights = np.zeros((few.num_rows, 1 << n, 3), np.int64)
                for i, entries in enumerate(few.column("w").to_pylist()):
                    for e in entries:
                        weights[i, e["mask"]] = e["n"], e["good"], e["toxic"]
                found = interactions(weights, n).reshape(-1, len(COUNTS))
                part = few.column("part").take(pa.array(np.repeat(np.arange(few.num_rows), len(spelt) * n)))
                order = pa.array(np.tile(np.repeat(np.array(spelt, object), n), few.num_rows), pa.string())
                step = pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), few.num_rows * len(spelt)))
                yield pa.RecordBatch.from_arrays([part, order, step, *(pa.array(found[:, i]) for i in range(len(COUNTS)))], names=["part", "filter_order", "step", *COUNTS])

    return by_part.mapInArrow(rows, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def filter_audit(docs: DataFrame, labels: DataFrame, *, part: str = "source") -> DataFrame:
    """audit() of the five filters over documents (doc_id, text, part) and labels (doc_id, quality, toxic)."""
    return audit(labelled(failures(docs, part=part), labels))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
f AS (SELECT doc_id, part, len(words) < 200 AS A, 100 * len(list_distinct(words)) < 50 * len(words) AS B,
  100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) AS C, regexp_matches(text, '[#$%&*|]') AS D,
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE) AS E FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
d AS (SELECT part, [A, B, C, D, E] AS fails, A::INT + B::INT + C::INT + D::INT + E::INT AS n_fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM f LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, n_fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
x(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
r AS (SELECT c.*, filter_order, coalesce(list_min([i FOR i IN range(1, 6) IF fails[ascii(filter_order[i]) - 64]]), 6) AS step_out FROM c, o),
s AS (SELECT part, filter_order, step, ascii(filter_order[step]) - 64 AS filter,
  sum(n) FILTER (step_out > step) AS kept, sum(n) FILTER (step_out = step) AS removed,
  sum(n) FILTER (fails[ascii(filter_order[step]) - 64] AND step_out < step) AS redundant,
  sum(n) FILTER (fails[ascii(filter_order[step]) - 64] AND n_fails = 1) AS unique_fails,
  sum(good) FILTER (step_out = step) AS good_lost, sum(toxic) FILTER (step_out = step) AS toxic_lost
  FROM r, range(1, 6) g(step) GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter)::BIGINT AS shapley
FROM s
"""
