import hashlib
import os
import random
import re
import time
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from strandloom.llm import periodic_runs
from strandloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def naive(words, shortest=6, times=4):
    """All maximal stretches of every period, without those that a smaller period explains."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(shortest, times * q) and not any(all(words[x] == words[x + r] for x in range(i, i + length - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def naive_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = naive(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    spelt = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    row = (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
    return (*row, sha(spelt), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def rows(spark, docs, monkeypatch):
    from strandloom.llm import queries

    table = spark.createDataFrame(docs, "doc_id long, text string, periodic_ string")
    monkeypatch.setattr(queries, "table", lambda *_: table)
    return sorted(map(tuple, QUERIES["op12_periodic_runs"](spark, "").collect()), key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=14), st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(0, 40), st.lists(st.integers(0, 2), max_size=9))
def test_runs_are_those_of_brute_force(before, unit, n, after):
    words = before + (unit * 40)[:n] + after
    assert periodic_runs.runs_of(words) == naive(words)
    assert periodic_runs.runs_of(words, 4, 2) == naive(words, 4, 2)
    assert periodic_runs.find_in(" ".join(map(str, words)))[0] == naive(words)


def test_random_words_with_nested_and_touching_runs():
    rand = random.Random(5)
    for _ in range(1500):
        n, k = rand.randint(0, 70), rand.randint(1, 5)
        words = [rand.randrange(k) for _ in range(n)]
        for _ in range(rand.randint(0, 4)):
            if n > 8:
                a, p = rand.randrange(n), rand.randint(1, 9)
                for i in range(a + p, min(n, a + rand.randint(4, 45))):
                    words[i] = words[i - p]
        assert periodic_runs.runs_of(words) == naive(words)
        assert periodic_runs.find_in(" ".join(map(str, words)))[0] == naive(words)


def test_long_stretches_take_bounded_time():
    a, b = [0], [0, 1]
    while len(b) < 120_000:
        a, b = b, b + a
    rand = random.Random(2)
    for words in ([0] * 150_000, [i % 30_000 for i in range(150_000)], b, [rand.randrange(2) for _ in range(60_000)]):
        began = time.process_time()
        found = periodic_runs.runs_of(words)
        assert time.process_time() - began < 30
        assert all(all(x == y for x, y in zip(words[s : s + n - q], words[s + q : s + n], strict=True)) for s, n, q in found[:50])
    assert periodic_runs.runs_of([0] * 150_000) == [(0, 150_000, 1)]
    assert periodic_runs.runs_of([i % 30_000 for i in range(150_000)]) == [(0, 150_000, 30_000)]


def test_query_against_brute_force(spark, monkeypatch):
    rand = random.Random(11)
    docs = [(None, "a b " * 9, "x"), (None, None, None), (1, "", None), (2, " \t\n", "y"), (3, "no\x0bno no no\rno\x0cno", "")]
    docs += [(3, "no\x0bno no no\rno\x0cno", "")] * 2 + [(4, "é ü " * 4 + "é", ""), (5, "x y x y " * 4, "")]
    for i in range(6, 180):
        text = " ".join(rand.choice("abcdefgh" if i % 3 else "ab") for _ in range(rand.randint(0, 60)))
        docs.append((i - 90, text, "z"))
    got = rows(spark, docs, monkeypatch)
    assert got == sorted((naive_row(d, t) for d, t, _ in docs), key=str)
    assert sum(r[1] > 0 for r in got) > 20 and rows(spark, [], monkeypatch) == []


def test_other_columns_stay_and_one_of_the_same_name_is_replaced(spark):
    docs = spark.createDataFrame([("k", "a a a a a a b", 7)], "runs string, text string, start int")
    got = periodic_runs.find_runs(docs).collect()[0]
    assert (got["runs"], got["start"], got["periodic"]["collapsed"], [tuple(r) for r in got["periodic"]["runs"]]) == ("k", 7, "a b", [(0, 6, 1)])
    got = periodic_runs.find_runs(docs, out="Start")
    assert [c.lower() for c in got.columns] == ["runs", "text", "start"] and got.collect()[0][2]["collapsed"] == "a b"
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs, times=2)


@pytest.mark.skipif(not os.path.exists(SF), reason="the driver's tables are not here")
def test_driver_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = {d: naive_row(d, t) for d, t in docs if len(t or "") < 6000}
    got = {r[0]: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs) and {d: got[d] for d in short} == short
