"""The class-conditional Kneser-Ney models against counting by hand."""

import math
import random
import re
from collections import Counter

import numpy as np
from strandloom.llm import toxicity as T

D = T.DISCOUNT


def levels_of(texts):
    four, three = Counter(), Counter()
    for t in texts:
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            padded = f" {w} "
            if len(w) == 1:
                three[padded] += 1
            for k in range(len(padded) - 3):
                four[padded[k : k + 4]] += 1
    for g, n in four.items():
        three[g[1:]] += 1
        if g[0] == " ":
            three[g[:3]] += n
    two, one = Counter(), Counter()
    for g, n in three.items():
        two[g[1:]] += 1
        if g[0] == " ":
            two[g[:2]] += n
    for g in two:
        one[g[1:]] += 1
    return {1: one, 2: two, 3: three, 4: four}


def shared_p(levels, g):
    g = g.replace("^", " ").replace("$", " ")
    out = (levels[1][g[-1]] + 1) / (sum(levels[1].values()) + T.CLASSES)
    for k in range(2, len(g) + 1):
        own = g[-k:]
        same = [n for h, n in levels[k].items() if h[:-1] == own[:-1]]
        if same:
            out = (max(levels[k][own] - D, 0) + D * len(same) * out) / sum(same)
    return out


def test_scores_of_words(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 7)))
    rows = [(i, " ".join(word() for _ in range(6)), i % 2) for i in range(60)]
    texts = [t for _, t, _ in rows] + [" ".join(word() for _ in range(20)) for _ in range(20)]
    found = T.shared_counts(spark.createDataFrame([(t,) for t in texts], "text string")).toPandas()
    shared = T.Shared(found["key"].to_numpy(np.int64), found["n"].to_numpy(np.int64))
    counts = T.gram_counts(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    scorer = T.Scorer(*T.log_ratios(counts, shared))

    levels = levels_of(texts)
    sides = [Counter(), Counter()]
    for _, t, y in rows:
        for w in set(t.split()):
            sides[y].update(g for g in T.grams(w) if len(g) > 2)
    totals = []
    for side in sides:
        per: dict[str, list[int]] = {}
        for g, n in side.items():
            per.setdefault(g[:-1], []).append(n)
        totals.append(per)

    def naive(w):
        s = 0.0
        for g in T.grams(w):
            if g in sides[0] or g in sides[1]:
                below, ps = shared_p(levels, g[1:]), []
                for side, per in zip(sides, totals, strict=True):
                    x = per.get(g[:-1])
                    ps.append((max(side[g] - D, 0) + D * len(x) * below) / sum(x) if x else below)
                s += math.log(ps[1] / ps[0])
            else:
                s += sum(sign * math.log(D * len(per[g[:-1]]) / sum(per[g[:-1]])) for sign, per in ((-1, totals[0]), (1, totals[1])) if g[:-1] in per)
        return s / (len(w) + 1)

    words = sorted({w for _, t, _ in rows for w in t.split()} | {word() for _ in range(100)})
    got = scorer.words(words)
    for w, x in zip(words, got.tolist(), strict=True):
        assert math.isclose(x, naive(w), rel_tol=1e-4, abs_tol=1e-5), w
