import gzip
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from strandloom.sources import fastq, files
from strandloom.sources import reads as sources

COLUMNS = ["path", "offset", "name", "seq", "quality"]


def split_rows(path, split_bytes, strict=True, columns=COLUMNS[1:]):
    found = fastq.ranges(files.listed(str(path)), split_bytes)
    return [tuple(r.values()) for part in found for batch in fastq.records(part, list(columns), strict) for r in batch.to_pylist()]


def text_of(records, end="\n"):
    return "\n".join(f"@{n}\n{s}\n+{p}\n{q}" for n, s, p, q in records) + (end if records else "")


def rows_of(records):
    at, out = 0, []
    for n, s, p, q in records:
        out.append((at, n, s, q))
        at += len(f"@{n}\n{s}\n+{p}\n{q}\n")
    return out


@st.composite
def a_record(draw):
    seq = draw(st.text("ACGTN", max_size=12))
    quality = "".join(draw(st.lists(st.sampled_from("@+I!"), min_size=len(seq), max_size=len(seq))))
    return draw(st.text("@+xy 1", max_size=5)), seq, draw(st.sampled_from(["", "x", "@"])), quality


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(records=st.lists(a_record(), max_size=25), split=st.integers(1, 400), end=st.sampled_from(["\n", ""]), probe=st.integers(1, 200), block=st.integers(1, 300))
def test_any_ranges_give_the_records_of_one(tmp_path_factory, records, split, end, probe, block):
    path = tmp_path_factory.mktemp("f") / "x.fastq"
    path.write_text(text_of(records, end))
    old = fastq.PROBE, fastq.BLOCK
    fastq.PROBE, fastq.BLOCK = probe, block
    try:
        if not (records and not records[-1][3] and not end):  # without its newline an empty quality line is not there
            assert split_rows(path, split) == rows_of(records)
        seqs = [s for _, s, _, _ in records]
        assert [r[0] for r in split_rows(path, split, False, ["seq"])] == seqs
    finally:
        fastq.PROBE, fastq.BLOCK = old


@settings(max_examples=100, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lines=st.lists(st.text("@+AC\r", max_size=6), max_size=40), split=st.integers(1, 60), probe=st.integers(1, 50), block=st.integers(1, 50))
def test_mode_lines_takes_every_fourth_line_of_anything(tmp_path_factory, lines, split, probe, block):
    path = tmp_path_factory.mktemp("f") / "x.fastq"
    path.write_bytes("".join(x + "\n" for x in lines).encode())
    old = fastq.PROBE, fastq.BLOCK
    fastq.PROBE, fastq.BLOCK = probe, block
    try:
        assert [r[0] for r in split_rows(path, split, False, ["seq"])] == lines[1::4]
    finally:
        fastq.PROBE, fastq.BLOCK = old


def test_records_of_another_shape_are_errors(tmp_path):
    good = "@a\nACGT\n+\nIIII\n"
    for n, (bad, at) in enumerate({"a\nACGT\n+\nIIII\n": 0, "@a\nACGT\nIIII\n": 0, "@a\nACGT\n+\nIII\n": 0, "@a\nACGT\n": 0, "@a\nACGT\n+\nIIII\n\n": 15}.items()):
        path = tmp_path / f"{n}.fastq"
        path.write_text(good * 500 + bad)
        for split in (1 << 20, 700, 40):
            with pytest.raises(ValueError, match=f"no FASTQ record at byte {500 * len(good) + at}"):
                split_rows(path, split)
        path.write_text(good * 400 + bad + good * 400)
        if bad != good + "\n":
            with pytest.raises(ValueError, match="no FASTQ record at byte"):
                split_rows(path, 700)


def test_no_line_is_shuffled(spark, tmp_path):
    rand = random.Random(6)
    want = []
    for n in range(3):
        records = [(f"{n}:{i}", "".join(rand.choice("ACGTN") for _ in range(rand.randrange(90))), "", "") for i in range(2000)]
        records = [(a, s, p, "@" * len(s)) for a, s, p, _ in records]
        (tmp_path / f"{n}.fastq").write_text(text_of(records))
        want += [(f"{n}.fastq", i, s) for i, (_, s, _, _) in enumerate(records)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("10000", "134217728"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            numbered, scanned = sources.read_fastq(spark, str(tmp_path)), sources.scan_fastq(spark, f"file://{tmp_path}", "name string, seq string")
            assert scanned.rdd.getNumPartitions() > 50 if split == "10000" else scanned.rdd.getNumPartitions() == 3
            for plan in (numbered, scanned, sources.numbered_lines(spark, str(tmp_path))):
                text = plan._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
                assert "Exchange" not in text and "SortMergeJoin" not in text
            assert sorted((r["path"].rsplit("/", 1)[1], r["read_id"], r["seq"]) for r in numbered.collect()) == sorted(want)
            assert sorted(r["seq"] for r in scanned.collect()) == sorted(s for _, _, s in want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_compressed_hidden_and_empty_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.fastq.gz", "wt") as f:
        f.write("@1\nACGT\n+\nIIII\n" * 3)
    (tmp_path / "empty.fastq").write_text("")
    (tmp_path / "_SUCCESS").write_text("not a record")
    got = spark.read.format("fastq").load(str(tmp_path)).collect()
    assert [(r.offset, r.name, r.seq, r.quality) for r in got] == [(16 * i - i, "1", "ACGT", "IIII") for i in range(3)]
    with pytest.raises(ValueError):
        split_rows(tmp_path, 0)


def test_options_are_checked(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@1\nACGT\n+\nIIII\n" * 2)
    fastq.register(spark)
    for options, schema, why in (({"mode": "x"}, "seq string", "mode is"), ({}, "bases string", "have no bases")):
        with pytest.raises(Exception, match=why):
            spark.read.format("fastq").schema(schema).options(**options).load(str(tmp_path)).collect()
    with pytest.raises(ValueError, match="needs the option lines_before"):
        split_rows(tmp_path / "a.fastq", 3, True, ["read_id"])


def test_bytes_that_are_no_text(tmp_path):
    (tmp_path / "x").write_bytes(b"@\xff\nAC\n+\nI\xfe\n")
    assert split_rows(tmp_path / "x", 100) == [(0, "�", "AC", "I�")]


def test_stream_takes_new_files_once(spark, tmp_path):
    fastq.register(spark)
    (tmp_path / "in").mkdir()
    found = []

    def run():
        stream = spark.readStream.format("fastq").schema("seq string").option("log", str(tmp_path / "log")).load(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(lambda df, n: found.extend(r.seq for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    for seqs in (["AC", "GT"], ["TTT"]):
        for s in seqs:
            (tmp_path / "in" / f"{s}.fastq").write_text(f"@x\n{s}\n+\n{s}\n")
        run()
    assert sorted(found) == ["AC", "GT", "TTT"]
