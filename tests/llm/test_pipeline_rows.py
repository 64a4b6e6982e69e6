import corpus_pipeline


def test_line_dedup_stage_keeps_every_row(spark):
    """A document whose lines all stand first elsewhere keeps them; the later stages tell whether it is a copy."""
    rows = [(i, f"common\nshared\nown {i}", "en", f"s{i}", 99) for i in range(6)]
    rows += [(10, "common\nshared", "en", "s0", 13), (11, " shared\n\ncommon", "en", "s1", 15), (12, "common", "en", "s2", 6), (13, None, "en", "s3", None), (14, "", "en", "s4", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    want = {i: (f"own {i}", 5) for i in range(1, 6)} | {0: (rows[0][1], 99)}
    assert out == want | {r[0]: (r[1], r[4]) for r in rows[6:]}
