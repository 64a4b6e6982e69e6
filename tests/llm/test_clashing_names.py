"""Columns with the names that the operators use themselves pass through the library's functions as they are."""

from pyspark.sql import functions as F
from strandloom.llm import decontaminate, fingerprints, line_dedup, ngram_join, toxicity

NAMES = ["_id", "_drop", "_site", "_pos", "_hit", "_wide", "_canon", "_k", "_t", "_place", "_fp", "_features", "_toxicity", "_gone", "id", "comp", "key", "hashes", "kept", "a", "b", "line"]


def docs(spark):
    rows = [(i, f"common line\nown {'calm' if i % 2 else 'vile'} words of number {i} and some more of them", f"s{i}") for i in range(40)]
    rows += [(None, "no id at all", "s1"), (7, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES)])


def same(out, n):
    rows = out.select(*NAMES).collect()
    assert len(rows) == n and all(tuple(r) == tuple(range(len(NAMES))) for r in rows)


def test_line_dedup(spark):
    same(line_dedup.dedup_lines(docs(spark)), 42)


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "own vile words of number 6"), (None, "no id at all")], "item_id long, text string")
    out = decontaminate.drop_contaminated(docs(spark), items)
    same(out, 41)
    assert out.where("doc_id = 6").isEmpty() and not out.where("doc_id is null").isEmpty()


def test_fingerprints(spark):
    same(fingerprints.fingerprint(docs(spark)), 42)
    same(fingerprints.fingerprint(docs(spark), make=lambda c: F.substring(fingerprints.digest(c), 1, 1)), 42)


def test_toxicity(spark):
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)], "doc_id long, toxic int")
    same(toxicity.score(docs(spark), labels), 42)


def test_one_of_each(spark):
    same(ngram_join.one_of_each(docs(spark)), 42)
