import random
import re

from strandloom.llm import ngram_join as J

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width, percent):
    sets = [(i, brute_set(t, width)) for i, t in rows]
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((root(i), root(j)))
                label[q] = p
    return {(i, len(s), root(i)) for i, s in sets}


def edited(rnd, words, n):
    out = list(words)
    for _ in range(n):
        k = rnd.randrange(len(out))
        out[k : k + rnd.randint(0, 1)] = [f"e{rnd.randint(0, 999)}"]
    return out


def corpus(seed, copies=120):
    rnd = random.Random(seed)
    make = lambda n: [f"w{rnd.randint(0, 3000)}" for _ in range(n)]
    texts = ["", None, " \n", "a", "A", "a b", "a\tB\x0bc", "a b c"]
    passage = make(60)
    for n in (3, 9, 12, 13, 18, 21, 25, 29, 40, 80, 200):
        for _ in range(4):
            base = make(n)
            texts += [" ".join(edited(rnd, base, k)) for k in (0, 0, 1, 1, 2, n // 30 + 1)]
    base = make(150)
    texts += [" ".join(edited(rnd, base, rnd.randint(0, 4))) for _ in range(copies)]
    texts += [" ".join(make(40) + passage + make(30)) for _ in range(copies)]
    chain = make(100)
    for k in range(12):
        chain = edited(rnd, chain, 1)
        texts.append(" ".join(chain))
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_same_components_as_all_pairs(spark):
    for seed, width, percent in ((1, 3, 90), (2, 5, 80)):
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
        got = {tuple(r) for r in J.join(docs, width=width, percent=percent).collect()}
        assert got == brute(rows, width, percent)


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, None)], "doc_id long, text string")
    assert J.join(docs.limit(0)).count() == 0
    got = sorted(map(tuple, J.join(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 0, 2)], key=str)
    assert sorted(r.doc_id for r in J.one_of_each(docs.where("doc_id is not null")).collect()) == [1, 1, 2]


def test_the_boundary_follows_the_cost():
    assert J.boundary({10: 5, 20: 5}, 1.0, 90) < J.boundary({10: 5, 20: 5}, 1e6, 90) == J.LIGHT_MOST
