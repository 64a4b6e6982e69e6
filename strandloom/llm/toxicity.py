"""Toxicity by class-conditional Kneser-Ney models.

Two models of words as character sequences, one of toxic and one of ordinary labelled texts, are interpolated
Kneser-Ney models of ORDER characters. Below ORDER both back off to the same model of the words of all documents, of 4,
3 and 2 characters. So a word or ending never seen costs both the same, only the parts that one class uses speak, and
how much they say is smoothed by how common they are anywhere.
A word's score is the difference of its log-likelihoods divided by its length. A text is judged by the mean over its
words and by the means of its highest few; a logistic model, fitted on labelled texts that the two models have not
seen, turns these into a score from 0 to 1.

The class counts come from all usable labelled rows that fit the models, the shared counts and the scores from all
documents. The logistic model has five weights and takes at most MOST_LABELLED of the other labelled rows, the first in
the order of a hash of doc_id. All counts and log-ratios are Spark aggregations and joins; of each different n-gram of the
labelled rows a hash and a log-ratio, 12 bytes, reach the driver and the workers, and of each four-character window of
all documents its count.

Defined results: null and empty texts, and texts without words, have the features 0 and thus a low score; labels that
repeat a doc_id count as toxic if one says so; null labels are not used; without labelled rows of both classes the
score is 0; an empty table gives an empty one; extra columns pass through score().
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, give_back, sized, unused
from .shingles import mix

ORDER = 5
DISCOUNT = 0.75
#: Rows of the logistic model alone.
MOST_LABELLED = 20_000
#: Labels that are broadcast; beyond it documents and labels are joined by a merge.
MOST_BROADCAST = 1_000_000
#: So many of a hundred labelled rows fit the models, the others the logistic model.
FIT_SHARE = 60
THRESHOLD = 0.7
#: Words whose score a task keeps, some 150 bytes each; beyond it the memory starts anew. Texts that are scored at once.
KEPT_WORDS = 100_000
STEP = 200
#: Characters whose windows are counted at once; they take some 70 bytes for each.
KEYED_CHARS = 1 << 18
WORD = re.compile(r"[^\W_]+")
#: Characters from here on fall into so many classes for the shared counts.
FIRST_SHARED, SHARED = 0x250, 1024
CLASSES = FIRST_SHARED + SHARED
TOPS = (2, 4)
FEATURES = ("mean", *(f"top{k}" for k in TOPS))


def _classes(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < FIRST_SHARED, codes, FIRST_SHARED + codes % SHARED)


def grams(word: str):
    padded = f"^{word}$"
    for i in range(1, len(padded)):
        yield padded[max(0, i - ORDER + 1) : i + 1]


BITS = 11
LOW = (1 << BITS) - 1
BOUNDARY = 0x20


@lru_cache(None)
def _class_of() -> np.ndarray:
    """The class of each code point, BOUNDARY for those that stand in no word."""
    out = np.full(0x110000, BOUNDARY, np.int64)
    for m in WORD.finditer("".join(map(chr, range(0x110000)))):
        out[m.start() : m.end()] = _classes(np.arange(m.start(), m.end()))
    return out


def _keys(text: str) -> np.ndarray:
    """The four-character windows of the text's words, ^ and $ as BOUNDARY, 11 bits a character; a word of one character
    is a window with 0 before it."""
    c = _class_of()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    inner = c[1:-1] != BOUNDARY
    three = (c[:-2] << 2 * BITS) | (c[1:-1] << BITS) | c[2:]
    alone = three[inner & (c[:-2] == BOUNDARY) & (c[2:] == BOUNDARY)]
    four = (three[:-1] << BITS) | c[3:]
    return np.concatenate([four[inner[:-1] & inner[1:]], alone])


def shared_counts(docs: DataFrame, text="text") -> DataFrame:
    """(key, n): how often each four-character window stands in the words of all documents."""

    def batches(parts):
        kept, waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64)), []

        def merged():
            keys = np.concatenate([kept[0], *(k for k, _ in waiting)])
            found, at = np.unique(keys, return_inverse=True)
            n = np.zeros(len(found), np.int64)
            np.add.at(n, at, np.concatenate([kept[1], *(m for _, m in waiting)]))
            return found, n

        for part in parts:
            give_back()
            texts, size = [], 0
            for t in [*part.column(0), None]:
                value = None if t is None else t.as_py()
                if value:
                    texts.append(value.lower())
                    size += len(value)
                # A window of few texts at a time, so that a task holds some MB.
                if texts and (t is None or size > KEYED_CHARS):
                    waiting.append(np.unique(_keys("\n".join(texts)), return_counts=True))
                    texts, size = [], 0
            if sum(len(k) for k, _ in waiting) > 1 << 20:
                kept = merged()
                waiting = []
        kept = merged()
        for a in range(0, len(kept[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)]) for x in kept], names=["key", "n"])

    return docs.select(text).mapInArrow(batches, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def labelled(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, toxic) of all labelled rows that fit the models, and of the sample of the others that fits the
    logistic model. usable restricts both, by doc_id."""
    marks = labels.where("doc_id is not null and toxic is not null")
    if usable is not None:
        marks = marks.where(usable)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = cut(marks.withColumn("fits", F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(100)) < FIT_SHARE), "toxicity-labels")
    texts = docs.select("doc_id", "text")
    sample = marks.where("not fits").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED).select("doc_id", "toxic")
    fitting = texts.join(sized(marks.where("fits").select("doc_id", "toxic"), MOST_BROADCAST), "doc_id")
    return fitting, cut(texts.join(F.broadcast(cut(sample, "toxicity-sample")), "doc_id"), "toxicity-labelled")


def gram_counts(rows: DataFrame) -> DataFrame:
    """(toxic, gram, n): in how many texts of the class a word with the n-gram stands, summed over words."""

    def words(parts):
        for part in parts:
            out = [(int(y), w) for t, y in zip(part["text"], part["toxic"], strict=True) for w in sorted(set(WORD.findall((t or "").lower())))]
            yield pd.DataFrame(out, columns=["toxic", "word"])

    def split(parts):
        for part in parts:
            sums: Counter = Counter()
            for y, w, n in zip(part["toxic"], part["word"], part["n"], strict=True):
                for g in grams(w):
                    sums[int(y), g] += int(n)
            yield pd.DataFrame([(y, g, n) for (y, g), n in sums.items()], columns=["toxic", "gram", "n"])

    per_word = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInPandas(words, "toxic int, word string").groupBy("toxic", "word").agg(F.count("*").alias("n"))
    return per_word.mapInPandas(split, "toxic int, gram string, n long").groupBy("toxic", "gram").agg(F.sum("n").alias("n"))


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sum of n and the number of rows of each."""
    found, at, rows = np.unique(keys, return_inverse=True, return_counts=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, at, n)
    return found, sums, rows


class Shared:
    """The model that both classes back off to: Kneser-Ney over the four-character windows of all documents."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.levels = {}
        alone = keys >> 3 * BITS == 0
        raw, raw_n = keys[alone], n[alone]
        keys, n = keys[~alone], n[~alone]
        for length in (4, 3, 2):
            order = np.argsort(keys)
            self.levels[length] = (keys[order], n[order], *_sums(keys >> BITS, n))
            # Below: how many different characters stand before; at a word's start nothing does, and counts stay counts.
            first = keys >> (length - 1) * BITS == BOUNDARY
            lower, _, kinds = _sums(keys & ((1 << (length - 1) * BITS) - 1), n)
            start = _sums(np.concatenate([keys[first] >> BITS, raw]), np.concatenate([n[first], raw_n])) if length > 2 else (raw[:0], n[:0])
            raw, raw_n = raw[:0], raw_n[:0]
            keys, n = np.concatenate([lower, start[0]]), np.concatenate([kinds, start[1]])
        order = np.argsort(keys)
        self.single, self.single_n, self.all = keys[order], n[order], int(n.sum())

    def p(self, grams: list[str]) -> np.ndarray:
        """Of the last character of each n-gram after the others, at most four characters in all."""
        chars = np.array([[ord(c) if c not in "^$" else BOUNDARY for c in g.rjust(4, "\0")] for g in grams], np.int64).reshape(-1, 4)
        length = np.fromiter(map(len, grams), np.int64, len(grams))
        key = np.zeros(len(grams), np.int64)
        for c in _classes(chars).T:
            key = key << BITS | c
        out = (_at(self.single, self.single_n, key & LOW) + 1) / (self.all + CLASSES)
        for k in range(2, 5):
            keys, n, contexts, sums, kinds = self.levels[k]
            own = key & ((1 << k * BITS) - 1)
            total = _at(contexts, sums, own >> BITS)
            better = (np.maximum(_at(keys, n, own) - DISCOUNT, 0) + DISCOUNT * _at(contexts, kinds, own >> BITS) * out) / np.maximum(total, 1)
            out = np.where((k <= length) & (total > 0), better, out)
        return out


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of wanted keys, 0 for those that are not in keys, which are sorted."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], values.dtype.type(0))


#: Added to the hashes of contexts, which share a table with n-grams.
CONTEXT = np.uint64(0x6A09E667F3BCC909)


def gram_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, contexts, word): the hashes of all n-grams of all words, as grams() lists them, those of the n-grams
    without their last characters, and the number of the word of each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(len(codes)) - start
    # ends[k]: the hash of the k characters that end at each place, or of all from the word's start if they are fewer.
    ends = [np.zeros(len(codes), np.uint64)]
    for k in range(1, ORDER + 1):
        back = np.zeros(len(codes), np.uint64)
        back[k - 1 :] = codes[: len(codes) - k + 1]
        ends.append(np.where(place >= k - 1, mix(ends[-1] * np.uint64(0x9FB21C651E98DF25) + back), ends[-1]))
    inside = np.flatnonzero(place > 0)
    word = np.repeat(np.arange(len(words)), lengths)
    return ends[ORDER][inside], ends[ORDER - 1][inside - 1] + CONTEXT, word[inside]


def log_ratios(counts: DataFrame, shared: Shared) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ascending; values): the log-ratio of the classes for a character after a context, by the hash of the n-gram,
    and for an unknown character after it, where both back off to the same probability, by that of the context.

    Computed by Spark over counts (toxic, gram, n); 12 bytes for each n-gram reach the driver.
    """
    model = counts.sparkSession.sparkContext.broadcast(shared)
    of_class = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
    long = counts.where(F.length("gram") > 2).withColumn("y", (F.col("toxic") > 0).cast("int"))
    each = cut(long.groupBy("gram").agg(of_class(0).alias("n0"), of_class(1).alias("n1")).withColumn("h", F.expr("substring(gram, 1, length(gram) - 1)")), "toxicity-grams")
    per = each.groupBy("h").agg(*[f(c).alias(f"{s}{y}") for y in (0, 1) for f, s, c in ((F.sum, "t", F.col(f"n{y}")), (F.count_if, "k", F.col(f"n{y}") > 0))])
    per = cut(per, "toxicity-contexts")

    def ratios(parts):
        for part in parts:
            grams = part["gram"].tolist()
            below, ps = model.value.p([g[1:] for g in grams]), []
            for y in (0, 1):
                n, total, kinds = (part[f"{c}{y}"].to_numpy(np.float64) for c in "ntk")
                ps.append(np.where(total > 0, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds * below) / np.maximum(total, 1), below))
            yield pd.DataFrame({"key": whole_hashes(grams).view(np.int64), "value": np.log(ps[1] / ps[0])})

    def weights(parts):
        for part in parts:
            w = []
            for y in (0, 1):
                total, kinds = (part[f"{c}{y}"].to_numpy(np.float64) for c in "tk")
                w.append(np.where(total > 0, np.log(DISCOUNT * np.maximum(kinds, 1) / np.maximum(total, 1)), 0.0))
            yield pd.DataFrame({"key": (whole_hashes(part["h"].tolist()) + CONTEXT).view(np.int64), "value": w[1] - w[0]})

    schema = "key long, value float"
    both = each.join(per.hint("merge"), "h").mapInPandas(ratios, schema).unionByName(per.mapInPandas(weights, schema))
    found = cut(both, "toxicity-ratios").toPandas()
    keys = found["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found["value"].to_numpy(np.float32)[order]


def whole_hashes(grams: list[str]) -> np.ndarray:
    """The hashes of whole n-grams or contexts, as gram_hashes() has them."""
    lengths = np.fromiter(map(len, grams), np.int64, len(grams))
    codes = np.array([[ord(c) for c in g.rjust(ORDER, "\0")] for g in grams], np.uint64).reshape(-1, ORDER)
    out = np.zeros(len(grams), np.uint64)
    for k in range(ORDER):
        out = np.where(k < lengths, mix(out * np.uint64(0x9FB21C651E98DF25) + codes[:, ORDER - 1 - k]), out)
    return out


class Scorer:
    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.known = keys, values, {}

    def words(self, words: list[str]) -> np.ndarray:
        """The score of each word."""
        grams, contexts, word = gram_hashes(words)
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        found = self.keys[at] == grams
        x = np.where(found, self.values[at], 0).astype(np.float64)
        rest = np.flatnonzero(~found)
        x[rest] = _at(self.keys, self.values, contexts[rest])
        return np.bincount(word, x, len(words)) / (np.fromiter(map(len, words), np.int64, len(words)) + 1)

    def features(self, texts: list[str | None]) -> list[list[float]]:
        found = [WORD.findall((t or "").lower()) for t in texts]
        new = list(set().union(*found).difference(self.known))
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known.clear()
            new = list(set().union(*found))
        for a in range(0, len(new), 4096):
            self.known.update(zip(new[a : a + 4096], self.words(new[a : a + 4096]).tolist(), strict=True))
        return [self._of(words) for words in found]

    def _of(self, words: list[str]) -> list[float]:
        if not words:
            return [0.0] * len(FEATURES)
        x = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
        top = -np.sort(-np.partition(x, len(x) - TOPS[-1])[-TOPS[-1] :]) if len(x) > TOPS[-1] else -np.sort(-x)
        return [float(x.mean()), *(float(top[:k].mean()) for k in TOPS)]


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, deviations, weights, the constant last)."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(3000):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= z.T @ (p - y) / len(y) + 1e-4 * np.append(w[:-1], 0)
    return mean, spread, w


def score(docs: DataFrame, labels: DataFrame, *, text="text", usable: Column | None = None, out="score") -> DataFrame:
    """docs with the column out; labels: (doc_id, toxic)."""
    spark = docs.sparkSession
    fitting, sample = labelled(docs.select("doc_id", F.col(text).alias("text")), labels, usable)
    counts = cut(gram_counts(fitting), "toxicity-counts")
    checks, sides = ({r[0] for r in x.select(F.col("toxic") > 0).distinct().collect()} for x in (sample, counts))
    if len(checks) < 2 or len(sides) < 2:
        return docs.withColumn(out, F.lit(0.0))
    found = shared_counts(docs, text).toPandas()
    shared = Shared(found["key"].to_numpy(np.int64), found["n"].to_numpy(np.int64))
    tables = spark.sparkContext.broadcast(log_ratios(counts, shared))

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*tables.value)  # ends with the task
        for texts in batches:
            give_back()
            yield pd.Series([x for a in range(0, len(texts), STEP) for x in scorer.features(texts.iloc[a : a + STEP].tolist())], dtype=object)

    seen = sample.select("toxic", features("text").alias("x")).collect()
    mean, spread, weights = logistic(np.array([r["x"] for r in seen]), np.array([float(r["toxic"] > 0) for r in seen]))
    linear = F.lit(float(weights[-1]))
    name = unused(docs, "_features")
    for i in range(len(FEATURES)):
        linear = linear + (F.get(name, F.lit(i)) - float(mean[i])) / float(spread[i]) * float(weights[i])
    # Python is asked once for each text.
    return docs.withColumn(name, features(text)).withColumn(out, 1 / (1 + F.exp(-linear))).drop(name)


def keep_ordinary(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those whose score reaches the threshold; all columns stay."""
    name = unused(docs, "_toxicity")
    return score(docs, labels, out=name).where(F.col(name) < threshold).drop(name)
