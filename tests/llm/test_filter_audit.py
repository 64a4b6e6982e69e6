import os
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from strandloom.llm import filter_audit
from strandloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def naive(docs, labels, part_at=2):
    """Every document walked through every order."""
    good = {d for d, q, t in labels if q == 1 and d is not None}
    toxic = {d for d, q, t in labels if t == 1 and d is not None}
    rows = []
    for d in docs:
        doc_id, text, part = d[0], d[1] or "", d[part_at] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            fails.add("C")
        if re.search("[#$%&*|]", text):
            fails.add("D")
        if doc_id is not None and any(e[0] is not None and e[0] < doc_id and (e[1] or "") == text for e in docs):
            fails.add("E")
        rows.append((part, fails, doc_id in good, doc_id in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, total = [r for r in rows if r[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                kept = [r for r in left if f not in r[1]]
                early = sum(f in r[1] for r in mine) - len(gone)
                out[part, order, step] = [len(kept), len(gone), early, sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                total[f] += len(gone)
                left = kept
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def audited(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, mask string, good int, words int")
    got = filter_audit.filter_audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.COUNTS] for r in got.collect()}


def test_nulls_ties_copies_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", " \t", long, long, long + " #", "SHOUT " * 300, "a b " * 200, "é x|", long.upper(), "one\x0btwo"]
    docs = [(i % 9, t, None if i % 4 == 0 else ["", "s1", "s2"][i % 3], "m", 5, 6) for i, t in enumerate(texts * 3)]
    docs += [(None, long, "s1", "m", 1, 1)] * 3 + [(2, long, "s1", "m", 1, 1)] * 2 + [(7, None, "lone", None, None, None)]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (3, 1, None), (None, 1, 1), (8, 0, 0), (77, 1, 1)]
    assert audited(spark, docs, labels) == naive(docs, labels)


def test_no_documents_and_no_labels(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    docs = [(1, "a", "s", None, None, None), (2, "a", "s", None, None, None)]
    assert audited(spark, docs, []) == naive(docs, [])


def test_steps_are_those_of_walking_each_order():
    for n in (1, 2, 4):
        orders, places, steps = filter_audit.removal_steps(n)
        for mask in range(1 << n):
            for o, order in enumerate(orders):
                assert [places[f, o] for f in order] == list(range(1, n + 1))
                assert steps[mask, o] == next((i for i, f in enumerate(order, 1) if mask >> f & 1), n + 1)


def test_counts_add_up_for_any_weights():
    weights = np.random.default_rng(3).integers(0, 9, (3, 32, 3))
    found = filter_audit.interactions(weights, 5)
    kept, removed, redundant = found[..., 0], found[..., 1], found[..., 2]
    assert (kept[:, :, -1] == weights[:, :1, 0]).all()
    assert (kept + removed.cumsum(axis=2) == weights[:, :, 0].sum(axis=1)[:, None, None]).all()
    fails = (np.arange(32)[:, None] >> filter_audit.removal_steps(5)[0].ravel() & 1).reshape(32, 120, 5)
    assert (removed + redundant == np.einsum("pm,mos->pos", weights[:, :, 0], fails)).all()


def test_other_numbers_of_filters(spark):
    rows = spark.createDataFrame([("p", 1, 1, 0), ("p", 3, 0, 0), ("p", 0, 0, 0)], "part string, mask int, good int, toxic int")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant) for r in filter_audit.audit(rows, "xy").collect()}
    assert got == {("xy", 1): (1, 2, 0), ("xy", 2): (1, 0, 1), ("yx", 1): (2, 1, 0), ("yx", 2): (1, 1, 1)}
    with pytest.raises(ValueError):
        filter_audit.audit(rows, "aa")


def test_very_long_text_is_filtered_whole(spark):
    text = " ".join(f"w{i}" for i in range(200_000)) + " same" * 200_001 + "|"
    got = filter_audit.failures(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).collect()
    assert [r["mask"] for r in got] == [8]


@pytest.mark.skipif(not os.path.exists(SF), reason="the driver's tables are not here")
def test_same_rows_as_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    want = con.execute(ORACLE_SQL["op11_filter_audit"]).fetchdf()
    got = QUERIES["op11_filter_audit"](spark, SF)
    columns = sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want[columns].itertuples(index=False, name=None)))
