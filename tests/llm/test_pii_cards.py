from strandloom.llm import pii


def test_card_with_a_separator_after_each_digit(spark):
    """No two digits stand side by side; the base pattern takes them all the same."""
    texts = ["4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "pay 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1 now", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 2", "1 2"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: (r.n_card, list(r.base)) for r in pii.find(docs).collect()}
    assert out == {0: (1, ["card:0:31"]), 1: (1, ["card:4:35"]), 2: (0, []), 3: (0, [])}


def test_many_spans_in_one_text(spark):
    """The cost grows with the number of spans, not with its square."""
    import time

    pii.find(spark.createDataFrame([(0, "a@b.co")], "doc_id long, text string")).collect()
    N = 4_000
    text = " ".join(f"u{i}@b.co (212) 555-{i % 9000 + 1000}" for i in range(N))
    began = time.time()
    (row,) = pii.find(spark.createDataFrame([(0, text)], "doc_id long, text string")).collect()
    assert row.n_email == N and time.time() - began < 90
    at = [int(s.split(":")[1]) for s in row.base]
    assert at == [i for i in range(len(text)) if text.startswith("u", i)]


def test_expectation_maximisation_against_a_naive_one():
    """Over single candidates instead of counts of patterns; and labelers that disagree are told apart."""
    import math
    import random

    rnd = random.Random(1)
    truth, rows = [], []
    for _ in range(1500):
        y = rnd.random() < 0.6
        good = [0.95, 0.8, 0.6]
        votes = [1 if (rnd.random() < g) == y else -1 for g in good]
        rows.append((rnd.choice(["account", "name"]), tuple(votes)))
        truth.append(y)
    code = lambda v: ((v[0] + 1) * 9 + (v[1] + 1) * 3 + v[2] + 1) * pii.FORMS
    counts = {}
    for kind, v in rows:
        counts[kind, code(v)] = counts.get((kind, code(v)), 0) + 1
    got = pii.posteriors(counts)
    rate = [[{-1: 0.1, 0: 0.3, 1: 0.6}, {-1: 0.6, 0: 0.3, 1: 0.1}] for _ in range(3)]
    prior = {k: 0.7 for k in ("account", "name")}
    for _ in range(50):
        post = []
        for kind, v in rows:
            a, b = prior[kind], 1 - prior[kind]
            for r, x in zip(rate, v, strict=True):
                a, b = a * r[0][x], b * r[1][x]
            post.append(a / (a + b))
        for j in range(3):
            for side in (0, 1):
                sums = {x: 1 + sum(abs(side - p) for (_, v), p in zip(rows, post, strict=True) if v[j] == x) for x in (-1, 0, 1)}
                rate[j][side] = {x: n / sum(sums.values()) for x, n in sums.items()}
            for x, better, worse in ((1, 0, 1), (-1, 1, 0)):
                rate[j][better][x] = max(rate[j][better][x], rate[j][worse][x])
        for kind in prior:
            own = [p for (k, _), p in zip(rows, post, strict=True) if k == kind]
            prior[kind] = (7 + sum(own)) / (10 + len(own))
    assert all(math.isclose(got[kind, code(v)], p, abs_tol=1e-6) for (kind, v), p in zip(rows, post, strict=True))
    assert sum((p > 0.5) == y for p, y in zip(post, truth, strict=True)) > 0.9 * len(rows)
    belief = pii.fit(counts)
    assert sum((belief[k, code(v)] > 0.5) == y for (k, v), y in zip(rows, truth, strict=True)) > 0.9 * len(rows)
