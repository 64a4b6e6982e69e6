"""N-gram Jaccard join: which texts have word-shingle sets with 100 * intersection >= percent * union, size-aware.

Texts with the same set are one class, found by a 128-bit digest of the set. Two sets of sizes a and b link if they share
c = ceil(percent * (a + b) / (100 + percent)) shingles.

Light sets, of at most `boundary` shingles: all subsets of size c are enumerated for each size b that may link; two sets
that share one link, with nothing left to verify. Heavy sets: inverted lists from shingle to set are scanned. Each set is
listed under so many of its first hashes, in an order that puts common ones last, that two linked sets must meet in a
list. The boundary is chosen by the cost
of both ways, from the sizes of the small sets and the lengths of their lists.

Lists that hold the same sets count as one. Short lists give their pairs, if the sets meet in as many lists as linked
ones must. Long lists hold either large groups of near copies or a passage that many texts share; there each set is
compared with one leader only. Two sets of the list that link, and are not both linked with the leader, differ from it in
partly the same hashes. So each set's difference from the leader, rare hashes first, is listed in turn, and the next
round scans these inverted lists. Copies with edits of their own and texts that only share a passage meet no more there.
No link depends on chance. After MOST_ROUNDS, or once a round has joined no components, the lists that are left give all
their pairs, which are verified: texts that are put together from few shared passages, none of them linked, then cost the
square of a list.

Defined results: null and empty texts, and texts without words, have no shingles and link with nothing; rows that
repeat a doc_id are one vertex; rows with a null doc_id keep their n_shingles and link with nothing; equal texts are
always in one component; an empty table gives an empty one; extra columns are not used.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from ._common import cut, give_back, sized, unused
from .components import components

#: Sets above this size are never enumerated; it bounds a set's subsets.
LIGHT_MOST = 28
#: Lists with at most so many pairs to compare for each set give all of them; in others each set is compared with the leader.
SHORT_LIST = 8
#: What a set is in a list of differences from a leader: not linked with it, linked, or not linked and of use for near sets alone.
CORE, NEAR, TAIL = 0, 1, 2
#: Ids that are broadcast at most (16 bytes each); beyond it they are joined by a shuffle.
MOST_BROADCAST = 500_000
#: When no more pairs than this are left for each row of the first lists, when a round joined no components, or after so
#: many rounds, all lists give their pairs; no link is lost either way.
FEW_PAIRS = 12
MOST_ROUNDS = 4
#: In groups of more sets than CROWDED, hashes in more than one of CROWDED_SHARE differences go last. There are at most
#: CROWDED_SHARE times as many of them as a difference lists.
CROWDED = 64
CROWDED_SHARE = 6
#: Leaders whose such hashes are broadcast.
MOST_OFTEN = 2_000
#: Sets with so many hashes in all are broadcast (8 bytes each); more are joined by a shuffle.
FEW_HASHES = 2_000_000
#: Rows of the lists for each task that writes what is made of them, and so many tasks at least.
TASK_ROWS = 20_000
LEAST_TASKS = 12
#: Comparisons with one leader in one group of rows; leaders with more are dealt out.
PER_SALT = 500
#: Hashes in more prefixes than this are common; so many of them at most are broadcast (8 bytes each).
COMMON = 8
MOST_COMMON = 1_000_000
OTHER = np.uint64(0x5851F42D4C957F2D)


def shared_at_least(a: int, b: int, percent: int) -> int:
    return -(-percent * (a + b) // (100 + percent))


def prefix(n: int, percent: int) -> int:
    """Among so many first hashes of a set of n, one is also among those of any set that links."""
    return n - -(-percent * n // 100) + 1


def _digests(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return S.mix(x), S.mix(x ^ OTHER)


FEATURES = "doc_id long, n long, d1 long, d2 long, hashes array<long>"


def common_hashes(docs: DataFrame, width: int, percent: int) -> np.ndarray:
    """Hashes that stand in the prefixes of many texts, ascending: at most MOST_COMMON, those over a power of two of texts.

    They come last in the order from which prefixes are taken. Any such set keeps the join whole, as the order is the
    same for all texts; this one makes the lists short. Prefixes are taken longer here, as they move on when common
    hashes leave them.
    """

    def batches(parts):
        for part in parts:
            give_back()
            found = []
            for t in part.column(0):
                own = S.of_text(t.as_py(), width)
                found.append(own[: prefix(len(own), percent) * 3 // 2 + 4])
            keys, n = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    counts = docs.select("text").mapInArrow(batches, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    often = cut(counts.where(F.col("n") > COMMON).withColumn("log", F.floor(F.log2("n")).cast("int")), "join-common")
    least, total = 64, 0
    for r in sorted(often.groupBy("log").count().collect(), key=lambda r: -r["log"]):
        total += r["count"]
        if total > MOST_COMMON:
            break
        least = r["log"]
    kept = often.where(F.col("log") >= least).select("key").toArrow().column(0).to_numpy()
    return np.sort(kept.view(np.uint64)) if len(kept) else np.zeros(0, np.uint64)


def in_order(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A set's hashes, ascending, with the common ones last."""
    if not len(common) or not len(own):
        return own
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    often = common[at] == own
    return np.concatenate([own[~often], own[often]])


def features(docs: DataFrame, width: int, percent: int, common: np.ndarray) -> DataFrame:
    """doc_id, size and digests of the set, and its first hashes in order: the prefix, or the whole set up to LIGHT_MOST."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def batches(parts):
        for part in parts:
            give_back()
            sets = [in_order(S.of_text(t.as_py(), width), shared.value) for t in part.column(1)]
            n = np.array([len(s) for s in sets], np.int64)
            d1, d2, kept = [], [], []
            for s in sets:
                a, b = _digests(s)
                d1.append(a.sum(dtype=np.uint64))
                d2.append(b.sum(dtype=np.uint64))
                kept.append(s if len(s) <= LIGHT_MOST else s[: prefix(len(s), percent)])
            ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
            values = np.concatenate([*kept, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array(n), pa.array(np.array(d1, np.uint64).view(np.int64)), pa.array(np.array(d2, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))],
                names=["doc_id", "n", "d1", "d2", "hashes"],
            )

    return docs.select("doc_id", "text").mapInArrow(batches, FEATURES)


def sets(docs: DataFrame, ids: DataFrame, width: int, common: np.ndarray) -> DataFrame:
    """(id, hashes): the whole sets of some documents, in order."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def batches(parts):
        for part in parts:
            give_back()
            found = [in_order(S.of_text(t.as_py(), width), shared.value) for t in part.column(1)]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["id", "hashes"])

    texts = docs.select(F.col("doc_id").alias("id"), "text").join(sized(ids, MOST_BROADCAST), "id", "left_semi")
    return texts.mapInArrow(batches, "id long, hashes array<long>")


def partner_sizes(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def n_subsets(n: int, percent: int) -> int:
    return sum(comb(n, c) for t in partner_sizes(n, percent) if (c := shared_at_least(n, t, percent)) <= min(n, t) and not c == n == t)


def boundary(sizes: dict[int, int], scanned: float, percent: int) -> int:
    """The size up to which sets are light: enumerating costs a step for each subset, lists one for each posting and scanned set."""
    best, least, total = 0, 0.0, 0.0
    for n in range(1, LIGHT_MOST + 1):
        total += sizes.get(n, 0) * (n_subsets(n, percent) - prefix(n, percent) * (1 + scanned))
        if total <= least:
            best, least = n, total
    return best


def light_links(classes: DataFrame, most: int, percent: int) -> DataFrame:
    """(a, b): in each bucket of a subset, the sets of either size with the smallest one of the other size."""
    schema = "id long, low int, high int, k1 long, k2 long"

    def subsets(parts):
        for part in parts:
            out: list[tuple] = []
            for i, hashes in zip(part["id"], part["hashes"], strict=True):
                own = np.asarray(hashes, np.int64).view(np.uint64)
                n = len(own)
                m1, m2 = _digests(own)
                with np.errstate(over="ignore"):
                    t1, t2 = m1.sum(dtype=np.uint64), m2.sum(dtype=np.uint64)
                    for t in partner_sizes(n, percent):
                        c = shared_at_least(n, t, percent)
                        if t > most or c > min(n, t) or c == n == t:
                            continue
                        for gone in combinations(range(n), n - c):
                            g = list(gone)
                            out.append((i, min(n, t), max(n, t), np.int64((t1 - m1[g].sum(dtype=np.uint64)).view(np.int64)), np.int64((t2 - m2[g].sum(dtype=np.uint64)).view(np.int64))))
            yield pd.DataFrame(out, columns=["id", "low", "high", "k1", "k2"])

    keyed = classes.where(F.col("n") <= most).select("id", "hashes", "n")
    rows = keyed.drop("n").mapInPandas(subsets, schema).join(keyed.select("id", F.col("n").cast("int").alias("n")), "id")
    rows = cut(rows, "join-subsets")
    bucket = ["low", "high", "k1", "k2"]
    heads = cut(
        rows.groupBy(*bucket).agg(F.min(F.when(F.col("n") == F.col("low"), F.col("id"))).alias("_low"), F.min(F.when(F.col("n") == F.col("high"), F.col("id"))).alias("_high")).where("_low is not null and _high is not null"),
        "join-subset-heads",
    )
    other = F.when(F.col("n") == F.col("low"), F.col("_high")).otherwise(F.col("_low"))
    return rows.join(heads, bucket).select(F.col("id").alias("a"), other.alias("b")).where("a <> b").distinct()


def _often(postings: DataFrame, name: str) -> DataFrame:
    """The postings (key, id, n) of lists with two sets at least."""
    often = cut(postings.groupBy("key").agg(F.count("*").alias("length")).where("length > 1").select("key"), name)
    return cut(postings.join(often.hint("merge"), "key"), name)


def distinct_lists(lists: DataFrame, name: str, tasks: int) -> DataFrame:
    """lists (key, id, n, comp, role, pos, differ) with their length, weight and work. Of lists with the same sets one stays,
    whose weight is their number, with the first place of each set in any; lists without a pair to compare go.

    Two lists are the same if four sums of 32-bit hashes of their ids agree. Work is the number of pairs to compare:
    none of two near sets, nor of a tail but with a near set.
    """
    h = [F.xxhash64(F.lit(seed), "id") for seed in (0, 1)]
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate([y for x in h for y in (x.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(x, 32))])]
    counts = [F.count_if(F.col("role") == role).alias(c) for role, c in ((CORE, "core"), (NEAR, "near"), (TAIL, "tail"))]
    signed = lists.groupBy("key").agg(F.count("*").alias("length"), F.min("comp").alias("low"), F.max("comp").alias("high"), *counts, *sums)
    work = F.col("core") * (F.col("core") - 1) / 2 + F.col("near") * (F.col("core") + F.col("tail"))
    signed = cut(signed.where((F.col("low") != F.col("high")) & (work > 0)).withColumn("work", work), name, tasks)
    same = ["length", "s0", "s1", "s2", "s3"]
    first = signed.groupBy(*same).agg(F.min("key").alias("first"), F.count("*").alias("weight"), F.max("work").alias("work"))
    kept = cut(signed.select("key", *same).join(first.hint("merge"), same).select("key", "first", "length", "weight", "work"), name, tasks)
    out = lists.join(sized(kept, MOST_BROADCAST), "key")
    least = [F.min(c).alias(c) for c in ("n", "comp", "role", "pos", "differ", "length", "weight", "work")]
    return cut(out.groupBy(F.col("first").alias("key"), "id").agg(*least), name, tasks)


def leaders(lists: DataFrame, crowd: DataFrame, tasks: int) -> DataFrame:
    """(a, b): each set of a list with the list's leader b, the one of the highest rank by crowd (id, rank).

    Among near copies it should be one with few edits of its own, so that many link with it and the others' differences
    from it are small.
    """
    led = lists.join(crowd, "id").groupBy("key").agg(F.max(F.struct("rank", "n", F.xxhash64("id").alias("h"), "id")).alias("l"))
    led = cut(led.select("key", F.col("l.id").alias("b")), "join-leaders", tasks)
    return lists.join(sized(led, MOST_BROADCAST), "key").where("id <> b").select(F.col("id").alias("a"), "b")


def list_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b, k, ...): pairs of different components in one list whose sizes may link, and in how many lists they meet.

    Where sets stand with their difference from a leader, a pair that links has its first common hash so early in both
    that the hashes after it suffice.
    """
    own = ["n", "comp", "role", "pos", "differ"]
    one = lists.select("key", "weight", F.col("id").alias("a"), *own)
    two = lists.select("key", F.col("id").alias("b"), *[F.col(c).alias(f"{c}2") for c in own])
    fits = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent
    roles = ((F.col("role") == CORE) & (F.col("role2") == CORE)) | ((F.col("role") == NEAR) != (F.col("role2") == NEAR))
    shared = F.ceil((F.col("differ") + F.col("differ2") - F.floor((100 - percent) * (F.col("n") + F.col("n2")) / (100 + percent))) / 2)
    early = (F.col("pos") <= F.col("differ") - shared) & (F.col("pos2") <= F.col("differ2") - shared)
    met = one.join(two.hint("merge"), "key").where((F.col("a") < F.col("b")) & (F.col("comp") != F.col("comp2")) & fits & roles & F.coalesce(early, F.lit(True)))
    return met.groupBy("a", "b").agg(F.sum("weight").alias("k"), *[F.max(c).alias(c) for c in ("n", "n2")])


def _meetings(percent: int):
    """The least number of common hashes in the prefixes of two sets that link: up to the place where the first prefix
    ends, all common hashes are in both; after it that set has no more than its size less its prefix."""
    share = lambda c: F.ceil(F.col(c) * percent / 100)
    return F.ceil((F.col("n") + F.col("n2")) * percent / (100 + percent)) - F.greatest(share("n"), share("n2")) + 1


def compared(pairs: DataFrame, sets: DataFrame, percent: int, aside: DataFrame | None = None) -> DataFrame:
    """pairs (a, b, led) with n, the size of a's set, linked, the number of hashes that differ, and if led, rest: so much of the difference of both sets that,
    of two sets that link and of which one at least doesn't link with b, the rests share a hash.

    With x and y the differences of two sets from b, and x's set not linked with b, they link only if over
    percent / (100 + percent) of y's hashes are also in x. What a set has beyond b comes first, and what aside (b, often)
    names comes last, so rests are mostly of hashes that few sets have.
    """
    if (sets.agg(F.sum(F.size("hashes"))).first()[0] or 0) <= FEW_HASHES:
        y = sets.select(F.col("id").alias("b"), F.col("hashes").alias("_y"))
        y = y.withColumn("often", F.lit(None).cast("array<long>")) if aside is None else y.join(sized(aside, MOST_OFTEN), "b", "left")
        rows = pairs.join(F.broadcast(sets.select(F.col("id").alias("a"), F.col("hashes").alias("_x"))), "a").join(F.broadcast(y), "b")
    else:
        per_leader = pairs.groupBy("b").agg(F.ceil(F.count("*") / PER_SALT).cast("int").alias("salts")).where("salts > 1")
        hot = sized(cut(per_leader, "join-hot"), MOST_BROADCAST)
        salts = F.coalesce("salts", F.lit(1))
        left = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("_x")).hint("merge"), "a").join(hot, "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), salts).cast("int")).drop("salts")
        right = sets.join(pairs.select(F.col("b").alias("id")).distinct().hint("merge"), "id", "left_semi").select(F.col("id").alias("b"), F.col("hashes").alias("_y"))
        right = right.withColumn("often", F.lit(None).cast("array<long>")) if aside is None else right.join(aside.hint("merge"), "b", "left")
        right = right.join(hot, "b", "left").select("b", "_y", "often", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        rows = left.join(right.hint("merge"), ["b", "salt"])
    rows = rows.withColumn("both", F.size(F.array_intersect("_x", "_y")))
    n, m, both = F.size("_x"), F.size("_y"), F.col("both")
    rows = rows.withColumn("linked", (both > 0) & (100 * both >= percent * (n + m - both))).withColumn("differ", n + m - 2 * both)
    differ, whole = F.col("differ"), 100 + percent
    partner = F.floor(100 * n / percent)
    most = F.floor((100 - percent) * (n + partner) / whole)
    near_most = F.floor((100 - percent) * (m + partner) / whole)
    by_share = F.floor(percent * differ / whole) + 1
    shared = F.when(F.col("linked"), by_share).when(differ - most > near_most, F.greatest(by_share, differ - most)).otherwise(F.greatest(F.lit(1), differ - most))
    beyond = F.concat(F.array_except("_x", "_y"), F.array_except("_y", "_x"))
    if aside is not None:
        often = F.coalesce("often", F.array().cast("array<long>"))
        beyond = F.concat(F.array_except(beyond, often), F.array_intersect(beyond, often))
    rest = F.slice(beyond, F.lit(1), F.greatest(F.lit(0), differ - shared + 1).cast("int"))
    return rows.select("a", "b", n.alias("n"), "linked", "differ", F.when(F.col("led"), rest).alias("rest"))


def merged(labels: DataFrame | None, edges: DataFrame, tasks: int) -> DataFrame:
    """labels (id, comp) after edges (a, b) joined some components."""
    if labels is None:
        return components(edges, tasks)
    near = sized(labels, MOST_BROADCAST)
    of = lambda c: near.select(F.col("id").alias(c), F.col("comp").alias(f"c_{c}"))
    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    between = cut(between.where("a <> b"), "join-between", tasks)
    if between.isEmpty():
        return labels
    moved = components(between, tasks)
    old = labels.join(sized(moved, MOST_BROADCAST).select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    new = moved.join(near.select("id"), "id", "left_anti")
    return cut(old.unionByName(new), "join-labels", tasks)


def heavy_links(lists: DataFrame, sets_of, edges: DataFrame, percent: int) -> DataFrame:
    """(id, comp) of all sets that link with another: by edges (a, b), and by the lists (key, id, n).

    Short lists give their pairs. In a long list each set is compared with the leader alone. Sets that link with it are
    of one component; what else may link in the list has common hashes in the differences from the leader, so these
    are the lists of the next round.
    """
    labels = None
    raw = {"comp": F.col("id"), "role": F.lit(CORE), "pos": F.lit(0), "differ": F.lit(None).cast("int")}
    tasks = max(LEAST_TASKS, lists.count() // TASK_ROWS)
    lists = distinct_lists(lists.withColumns(raw), "join-lists", tasks)
    n_rows, grown = lists.count(), True
    for turn in range(MOST_ROUNDS + 1):
        last = turn == MOST_ROUNDS or not grown or (lists.agg(F.sum(F.col("work") / F.col("length"))).first()[0] or 0) <= FEW_PAIRS * n_rows
        short = F.lit(True) if last else F.col("work") <= F.col("length") * SHORT_LIST
        long = lists.where(~short)
        # First, sets whose places are in the longest lists are the least edited; then those nearest to the last leader.
        rank = F.sum(F.col("weight") * F.col("length")) if turn == 0 else -F.min("differ")
        crowd = cut(long.groupBy("id").agg(F.sum("weight").alias("long"), rank.alias("rank")), "join-crowd", tasks)
        crowd = sized(crowd, MOST_BROADCAST)
        pairs = list_pairs(lists.where(short), percent)
        if turn == 0:
            # Two sets may meet in long lists as well, in no more than either stands in.
            for end in ("a", "b"):
                pairs = pairs.join(crowd.select(F.col("id").alias(end), F.col("long").alias(f"long_{end}")), end, "left")
            elsewhere = F.least(*[F.coalesce(f"long_{end}", F.lit(0)) for end in ("a", "b")])
            pairs = pairs.where(F.col("k") + elsewhere >= _meetings(percent))
        pairs = pairs.select("a", "b", F.lit(False).alias("led")).unionByName(leaders(long, crowd, tasks).withColumn("led", F.lit(True)))
        pairs = cut(pairs.groupBy("a", "b").agg(F.max("led").alias("led")), "join-pairs", tasks)
        ends = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "join-ends", tasks)
        own_sets = cut(sets_of(ends), "join-sets")
        seen = cut(compared(pairs, own_sets, percent), "join-compared")
        found = seen.where("linked").select("a", "b")
        before, labels = labels, merged(labels, edges.unionByName(found) if turn == 0 else found, tasks)
        grown = labels is not before
        named = sized(labels, MOST_BROADCAST).withColumnRenamed("id", "a")
        open_ = seen.where("rest is not null").join(named, "a", "left")
        open_ = open_.groupBy("b").agg(*[f(F.coalesce("comp", "a")).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))], F.count("*").alias("size"))
        open_ = cut(open_.where("low <> high").select("b", "size"), "join-open", tasks)
        if open_.isEmpty():
            return labels
        listed = cut(seen.where("rest is not null").join(sized(open_, MOST_BROADCAST).select("b"), "b", "left_semi"), "join-rests")
        # What many differences have in common is a hash that the leader lacks or alone has; it parts no sets, so it goes last.
        often = listed.select("b", F.explode("rest").alias("e")).groupBy("b", "e").count().join(sized(open_.where(F.col("size") > CROWDED), MOST_BROADCAST), "b")
        often = cut(often.where(F.col("count") * CROWDED_SHARE > F.col("size")).groupBy("b").agg(F.collect_list("e").alias("often")), "join-aside", tasks)
        if not often.isEmpty():
            crowded = sized(often, MOST_OFTEN).select("b")
            again = listed.join(crowded, "b", "left_semi").select("a", "b", F.lit(True).alias("led"))
            listed = listed.join(crowded, "b", "left_anti").unionByName(cut(compared(again, own_sets, percent, often), "join-again"))
        core = F.col("differ") - F.floor(percent * F.col("differ") / (100 + percent))
        role = F.when(F.col("linked"), NEAR).when(F.col("pos") < core, CORE).otherwise(TAIL)
        listed = listed.join(named, "a", "left").select("b", F.col("a").alias("id"), "n", F.coalesce("comp", "a").alias("comp"), "linked", "differ", F.posexplode("rest").alias("pos", "e"))
        lists = distinct_lists(cut(listed.select(F.xxhash64("b", "e").alias("key"), "id", "n", "comp", role.alias("role"), "pos", "differ"), "join-listed", tasks), "join-lists", tasks)
        if lists.isEmpty():
            return labels
    return labels


def join(docs: DataFrame, *, text="text", doc_id="doc_id", width: int = 3, percent: int = 90) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    common = common_hashes(docs, width, percent)
    rows = cut(features(docs, width, percent, common), "join-features")
    usable = rows.where("n > 0 and doc_id is not null")
    members = usable.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.min("hashes").alias("hashes"))
    classes = cut(members, "join-classes")

    small = classes.where(F.col("n") <= LIGHT_MOST)
    sizes = {r["n"]: r["count"] for r in small.groupBy("n").count().collect()}
    postings = classes.select(F.explode(F.slice("hashes", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))).alias("key"), "id", "n")
    scan = postings.where(F.col("n") <= LIGHT_MOST).groupBy("key").count().agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0]
    light = boundary(sizes, scan or 1.0, percent)

    edges = cut(light_links(classes, light, percent), "join-edges")
    lists = _often(postings.where(F.col("n") >= -(-percent * (light + 1) // 100)), "join-often")
    comps = heavy_links(lists, lambda ids: sets(docs, ids, width, common), edges, percent)

    named = cut(classes.select("n", "d1", "d2", "id", "copies").join(comps.hint("merge"), "id", "left").withColumn("comp", F.coalesce("comp", "id")).where("copies > 1 or comp <> id").select("n", "d1", "d2", "comp"), "join-named")
    return rows.join(named.hint("merge"), ["n", "d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, *, text="text", doc_id="doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """docs with only the smallest doc_id of each component; all its columns and rows stay."""
    groups = join(docs, text=text, doc_id=doc_id, width=width, percent=percent)
    name = unused(docs, "_gone")
    gone = cut(groups.where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct(), "join-gone")
    return docs.join(gone.hint("merge"), docs[doc_id] == gone[name], "left_anti")
