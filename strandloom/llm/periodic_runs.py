"""Runs of repeated wording: stretches of words that repeat with a period, at least `times` periods long, and the text without the repeats.

A run is a maximal stretch of words in which words `period` apart are the same, period being the smallest such number.

Each appended word extends the suffix automaton of the words before it. Its tree of suffix links is held by a link-cut tree
whose preferred paths have one colour each, the place where their words last ended. Access to the new state recolours the way to the
root: on each segment, the words up to the segment's length ended at the old colour and end here now. If the
distance is no more than that length, the last two distances' words are a square, which is extended both ways to the run. An
amortised logarithm of the number of words is spent on each word, whatever it repeats.

Before that, words that can stand in no run are set aside: in a run, each three words stand again at most a period away, and the
period is a `times`-th of the run at most. Stretches of words that meet this are what the automaton reads; the rest of a text never does.
This loses nothing, as a run lies within one stretch with all its words, and the word beyond either end would be in it too if it went on.

A document is one row of a task; memory is some hundred bytes for each word of the longest stretch. Nothing is shuffled.

Null and empty texts, and those of white space, have no runs and collapse to the empty text. Each row is answered for itself, so
null or repeated doc_ids and repeated rows change nothing. Other columns pass through; one that has the result's name, which is the caller's choice, is replaced.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are what stands between ASCII white space: that of bytes.split().
WORD = r"[^\x20\x09-\x0D]+"
SHORTEST, TIMES = 6, 4
#: Longer stretches keep their numbers in arrays of four bytes, which are a little slower than lists.
LONG = 100_000
RESULT = "struct<runs: array<struct<start: long, length: long, period: long>>, collapsed: string>"


def squares(words: list[int]) -> Iterator[tuple[int, int]]:
    """(period, end): squares of words, the last word at end, one at least in every run of two periods and more and at each of its ends."""
    n = 2 * len(words) + 2
    new = (lambda: array("i", bytes(4 * n))) if len(words) > LONG else (lambda: [0] * n)
    # State 0 is none, 1 the start. A state has mostly one way on: to[s] by word via[s]; more[s] has the others.
    size, link, via, to, more = new(), new(), new(), new(), {}
    # The link-cut tree: up leads to the parent within a path's splay tree, or from its root to the state above the path.
    up, left, right, colour = new(), new(), new(), new()

    def splay(x: int) -> None:
        top = 0
        while p := up[x]:
            if left[p] == x:
                x_left = True
            elif right[p] == x:
                x_left = False
            else:
                break
            g = up[p]
            p_left, p_right = (left[g] == p, right[g] == p) if g else (False, False)
            if p_left or p_right:
                top, above = g, up[g]
                if p_left == x_left:  # the same side twice: p is turned above g first
                    if x_left:
                        b, c = right[p], right[x]
                        left[g], right[p], left[p], right[x] = b, g, c, p
                    else:
                        b, c = left[p], left[x]
                        right[g], left[p], right[p], left[x] = b, g, c, p
                    if b:
                        up[b] = g
                    if c:
                        up[c] = p
                    up[g], up[p] = p, x
                else:
                    if x_left:
                        b, c = left[x], right[x]
                        right[g], left[p], left[x], right[x] = b, c, g, p
                    else:
                        b, c = right[x], left[x]
                        left[g], right[p], right[x], left[x] = b, c, g, p
                    if b:
                        up[b] = g
                    if c:
                        up[c] = p
                    up[g] = up[p] = x
                if above:
                    if left[above] == g:
                        left[above] = x
                    elif right[above] == g:
                        right[above] = x
                up[x] = above
            else:
                top = p
                if x_left:
                    b = right[x]
                    left[p], right[x] = b, p
                else:
                    b = left[x]
                    right[p], left[x] = b, p
                if b:
                    up[b] = p
                up[p], up[x] = x, g
        if top:
            colour[x] = colour[top]

    states, last = 2, 1
    via[1] = -1
    for i, w in enumerate(words):
        cur = states
        states += 1
        size[cur], via[cur] = size[last] + 1, -1
        p = last
        while p:
            if via[p] == w:
                q = to[p]
                break
            if via[p] < 0:
                via[p], to[p] = w, cur
            else:
                others = more.get(p)
                if others is None:
                    more[p] = {w: cur}
                elif w in others:
                    q = others[w]
                    break
                else:
                    others[w] = cur
            p = link[p]
        if not p:
            parent = 1
        elif size[p] + 1 == size[q]:
            parent = q
        else:
            # The shorter words of q get a state of their own between q and its parent, on q's path and in its colour.
            parent = states
            states += 1
            size[parent], link[parent], via[parent], to[parent] = size[p] + 1, link[q], via[q], to[q]
            if q in more:
                more[parent] = dict(more[q])
            splay(q)
            if b := left[q]:
                up[b], left[parent] = parent, b
            left[q], up[parent], link[q] = parent, q, parent
            while p:
                if via[p] == w:
                    if to[p] != q:
                        break
                    to[p] = parent
                else:
                    others = more.get(p)
                    if others is None or others.get(w) != q:
                        break
                    others[w] = parent
                p = link[p]
        link[cur] = up[cur] = parent
        below, x = cur, parent
        while x:
            splay(x)
            # What hangs below x on its old path keeps its colour; x's new path goes on to the appended word.
            if b := right[x]:
                colour[b] = colour[x]
            if (distance := i + 1 - colour[x]) <= size[x]:
                yield distance, i
            right[x], below, x = below, x, up[x]
        colour[below] = i + 1
        last = cur


def runs_of(words: list[int], shortest: int = SHORTEST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of length at least shortest and times periods, by start, then period. times is 2 at least."""
    n, ends, found = len(words), {}, []
    for period, end in squares(words):
        if ends.get(period, -1) >= end:
            continue  # within the last run of this period
        start, stop = end - 2 * period + 1, end + 1
        while start and words[start - 1] == words[start - 1 + period]:
            start -= 1
        while stop < n and words[stop] == words[stop - period]:
            stop += 1
        ends[period] = stop - 1
        if stop - start >= max(shortest, times * period):
            found.append((start, stop - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(words: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> list[tuple[int, int]]:
    """(start, stop) of stretches that hold all runs. Each three words in them stand again at most a times-th of the stretch away.

    times is 3 at least, and shortest 5: then a run has each of its threes twice within a period.
    """
    n = len(words)
    if n < shortest:
        return []
    threes = words[:-2].astype(np.int64)
    for other in (words[1:-1], words[2:]):
        threes = np.unique(threes * (int(words.max()) + 1) + other, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(threes, kind="stable")
    gap = np.where(threes[order[1:]] == threes[order[:-1]], np.diff(order), n)
    near = np.full(n - 2, n)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    good = near < n
    while True:
        edges = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
        starts, stops = edges[::2], edges[1::2] + 2
        long_enough = stops - starts >= shortest
        starts, stops = starts[long_enough], stops[long_enough]
        bound = np.zeros(n - 1, np.int64)
        np.add.at(bound, starts, (stops - starts) // times)
        np.subtract.at(bound, stops - 2, (stops - starts) // times)
        still = near <= np.cumsum(bound)[:-1]
        if (still == good).all():
            return list(zip(starts.tolist(), stops.tolist(), strict=True))
        good = still


def find_in(text: str | None, shortest: int = SHORTEST, times: int = TIMES) -> tuple[list[tuple[int, int, int]], str]:
    """The runs of a text, and its words without those that a run repeats, joined by spaces."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    runs = []
    if len(number) < len(words):
        ids = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
        for a, b in stretches(ids, shortest, times):
            runs += [(a + start, length, period) for start, length, period in runs_of(ids[a:b].tolist(), shortest, times)]
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return runs, b" ".join(words).decode("utf-8", "replace")


def find_runs(docs: DataFrame, *, text: str = "text", out: str = "periodic", shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """docs with out: runs, an array of (start, length, period) by start, then period, in words from 0; and collapsed, the text without repeats."""
    if shortest < 5 or times < 3:
        raise ValueError(f"a run has at least 5 words and 3 periods, not {shortest} and {times}")
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    @F.arrow_udf(RESULT)
    def found(texts: pa.Array) -> pa.Array:
        answers = [find_in(t.as_py(), shortest, times) for t in texts]
        runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs, _ in answers], pa.list_(run))
        return pa.StructArray.from_arrays([runs, pa.array([c for _, c in answers], pa.string())], names=["runs", "collapsed"])

    return docs.withColumn(out, found(F.col(text)))


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared without rounding; of equal ones the first. Null without runs."""
    more = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    return F.aggregate(runs, F.get(runs, F.lit(0)), more)


def spelt(runs: Column | str) -> Column:
    """A line `start,length,period` for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]).cast("string")), "\n")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in which documents with crc32(doc_id) % 10 = 0 end periodically; the others as they are.

    With n words (from 0), g = floor(crc32 / 10), a = g % n and p = 1 + floor((n - a) / (3 + g % 8)), word i >= a becomes word a + (i - a) % p.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.withColumn("_g", F.floor(h / 10).cast("long")).withColumn("_w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    rows = rows.withColumn("_n", F.size("_w").cast("long"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n"))).withColumn("_rest", F.col("_n") - F.col("_a"))
    rows = rows.withColumn("_p", 1 + F.floor(F.col("_rest") / (3 + F.col("_g") % 8)))
    number = lambda c: c.cast("int")
    unit = F.slice("_w", number(F.col("_a") + 1), number(F.col("_p")))
    tail = F.slice(F.flatten(F.array_repeat(unit, number(F.ceil(F.col("_rest") / F.col("_p"))))), F.lit(1), number(F.col("_rest")))
    edited = F.array_join(F.concat(F.slice("_w", F.lit(1), number(F.col("_a"))), tail), " ")
    return rows.withColumn("text", F.when(F.col("_n") > 0, edited).otherwise(F.col("text"))).select(*docs.columns)
