import os
import zlib

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
here = pytest.mark.skipif(not os.path.exists(SF), reason="the driver's tables are not here")


@here
def test_held_out_accuracy(spark):
    """sf0.1 has some 170 toxic texts to fit on; most expressions of its toxic German, French and Spanish texts are unseen there.
    When this was written 0.93 of all pairs were in order (English 0.94) and 0.95 of predictions right (English 0.99)."""
    from strandloom.llm import queries

    sf_dir = "/root/testdata/sf0.1"
    rows = queries.op8_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    rows = rows.join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    for some, least in ((held, 0.94), ([r for r in held if r.lang == "en"], 0.98)):
        assert sum((r.predicted == 1) == (r.toxic == 1) for r in some) >= least * len(some)
        ones, zeros = [r.score for r in some if r.toxic], [r.score for r in some if not r.toxic]
        assert sum(a > b for a in ones for b in zeros) >= 0.9 * len(ones) * len(zeros)


def test_odd_rows(spark):
    from strandloom.llm import toxicity

    words = ["good calm mild day", "vile nasty foul day"]
    rows = [(i, f"{words[i % 2]} number {i}", "x") for i in range(400)] + [(1000, None, "x"), (1001, "", "x"), (0, "good calm mild day number 0", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (5, None), (7, 1)], "doc_id long, toxic int")
    out = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    assert min(out[i] for i in range(1, 400, 2)) > max(out[i] for i in range(0, 400, 2))
    assert toxicity.score(docs, labels).count() == len(rows)
    assert {r.score for r in toxicity.score(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels).count() == 0


@here
def test_stages(spark):
    """Each stage against what its operator says of the stage's own input."""
    import corpus_pipeline as P
    from strandloom.llm import decontaminate, line_dedup, ngram_join, toxicity
    from strandloom.llm._common import cut, table

    small = "/root/testdata/sf0.001"
    docs = table(spark, small, "documents")
    columns = docs.columns
    labels = table(spark, small, "labels").select("doc_id", "toxic")
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())

    def stage(k, before):
        out = cut(P.STAGES[k][1](spark, before, small), "t")
        assert k == 4 or out.columns == columns
        return out

    one = stage(0, docs)
    assert ids(one) == ids(toxicity.score(docs, labels).where(F.col("score") < 0.7))
    two = stage(1, one)
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(one).collect()}
    assert all(texts[r.doc_id] == r.text and r.n_chars == len(r.text) for r in two.collect())
    three = stage(2, two)
    groups = ngram_join.join(two, width=5, percent=80)
    assert ids(three) == ids(groups.where("component_id = doc_id"))
    four = stage(3, three)
    hit = {r.doc_id for r in decontaminate.find(three, table(spark, small, "benchmark")).collect()}
    assert ids(four) == [i for i in ids(three) if i not in hit]
    five = stage(4, four)
    assert ids(five) == ids(four) and five.where("not round_trip").count() == 0
