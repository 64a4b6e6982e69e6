import random
import re
from collections import Counter

import numpy as np
from strandloom.llm import toxicity


def made(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(n)]


def test_expressions_of_all_labelled_rows_count(spark, monkeypatch):
    """The bound of the logistic model's sample keeps no labelled row from the class counts."""
    monkeypatch.setattr(toxicity, "MOST_LABELLED", 40)
    vile, plain = made(60, 1), made(60, 2)
    rows = [(i, f"{plain[i % 60]} {plain[i % 53]} {(vile if i % 2 else plain)[i // 2 % 60]} {plain[i % 47]}") for i in range(1200)]
    fresh = [(5000 + k, f"{plain[k % 53]} {w} {plain[k % 47]}") for k, w in enumerate(vile)] + [(6000 + k, f"{plain[k % 53]} {w} {plain[k % 47]}") for k, w in enumerate(plain)]
    docs = spark.createDataFrame(rows + fresh, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1200)], "doc_id long, toxic int")
    out = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    assert min(out[5000 + k] for k in range(60)) > max(out[6000 + k] for k in range(60))


def test_shared_counts_are_of_all_documents(spark):
    texts = ["One, two; a née 日本語 a", None, "", "x" * 30 + " I-am", "one\ntwo_ten", "😀 a"[-2:]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string")
    want = Counter()
    for t in texts * 3:
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            padded = f" {w} "
            for k in range(max(1, len(padded) - 3)):
                key = 0
                for c in toxicity._classes(np.array([ord(c) for c in padded[k : k + 4]])).tolist():
                    key = key << toxicity.BITS | c
                want[key] += 1
    got = {r["key"]: r["n"] for r in toxicity.shared_counts(rows).collect()}
    assert got == want
    model = toxicity.Shared(np.array(list(got)), np.array(list(got.values())))
    # ^ and $ stand for BOUNDARY in n-grams; as characters they are in no word, so their classes weigh as much as that of #.
    every = [chr(c) for c in range(toxicity.CLASSES) if chr(c) not in "^$ "]
    assert len({*toxicity._classes(np.array([ord(c) for c in every])).tolist()}) == toxicity.CLASSES - 3
    assert model.p(["one"]) > model.p(["onz"])
    for context in ("", "o", "on", "one", "^tw", "zz", "^a"):
        assert abs(model.p([context + c for c in [*every, "$", "#", "#"]]).sum() - 1) < 1e-6
