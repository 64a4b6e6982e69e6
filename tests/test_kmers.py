import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from strandloom.functions import codec
from strandloom.operators import kmers, lookup, packing, tables
from strandloom.sources import reads as sources
from strandloom.streaming import counts as streaming


def naive(seqs, k, canonical=True):
    out = Counter()
    for s in seqs:
        for i in range(len(s or "") - k + 1):
            w = s[i : i + k]
            if set(w) <= set("ACGT"):
                r = w[::-1].translate(str.maketrans("ACGT", "TGCA"))
                out[min(w, r) if canonical else w] += 1
    return dict(out)


def frame(spark, seqs):
    return spark.createDataFrame([(s,) for s in seqs], "seq string")


def counted(spark, seqs, k, **options):
    return {r.kmer: r.cnt for r in kmers.count(frame(spark, seqs), k, **options).collect()}


GOLDEN = [
    (["AACGTTNAAAAA"], 3, {"AAA": 3, "AAC": 2, "ACG": 2}),
    (["ACGT"], 4, {"ACGT": 1}),
    (["ACG"], 4, {}),
    (["aacgACGT"], 3, {"ACG": 2}),
    (["AC", "GT"], 3, {}),
    (["", None], 1, {}),
    (["TTTTT"], 5, {"AAAAA": 1}),
]


@pytest.mark.parametrize("strategy", ["native", "arrow"])
def test_golden_counts(spark, strategy):
    for seqs, k, want in GOLDEN:
        assert counted(spark, seqs, k, strategy=strategy) == want
    assert counted(spark, ["A" * 70_000], 1, strategy=strategy) == {"A": 70_000}
    assert counted(spark, ["A" * 70_000], 1, strategy=strategy, count_mode="u16") == {"A": 4464}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seqs=st.lists(st.text("ACGTNacgt\r", max_size=60), max_size=6), k=st.integers(1, 31))
def test_any_reads(spark, seqs, k):
    want = naive(seqs, k)
    assert counted(spark, seqs, k) == want
    assert counted(spark, seqs, k, strategy="native") == want
    assert counted(spark, seqs, k, canonical=False) == naive(seqs, k, False)


def test_long_reads_and_both_strands(spark):
    rnd = random.Random(3)
    read = "".join(rnd.choice("ACGT") for _ in range(50_000))
    want = naive([read], 31)
    assert counted(spark, [read], 31) == counted(spark, [read], 31, strategy="native") == want
    turned = read[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert counted(spark, [turned], 31) == want


def test_chunks_of_the_kernel(spark, monkeypatch):
    seqs = ["ACGTTGCANACGATTACA" * 5, "GATTACA"]
    for chunk in (1, 3, 7):
        monkeypatch.setattr(kmers, "CHUNK", chunk)
        assert counted(spark, seqs, 5) == naive(seqs, 5)


def test_k_is_checked(spark):
    for k in (0, 32, -1, "5", True):
        with pytest.raises(ValueError):
            kmers.count(frame(spark, ["ACGT"]), k)
    with pytest.raises(ValueError):
        kmers.count(frame(spark, ["ACGT"]), 3, strategy="x")


def test_codes(spark):
    rows = spark.createDataFrame([("AAC", 3, 1), ("ACG", 3, 6), ("T" * 31, 31, 4611686018427387903)], "kmer string, k int, enc long").collect()
    for r in rows:
        one = spark.createDataFrame([(r.kmer,)], "kmer string")
        got = one.select(codec.encode_kmer(F.col("kmer")).alias("e")).select("e", codec.decode_kmer(F.col("e"), r.k).alias("d"), codec.partition_id(F.col("e"), r.k).alias("p")).first()
        assert (got.e, got.d) == (r.enc, r.kmer)
    parts = spark.createDataFrame([("AAA",), ("AAC",), ("ACG",)], "kmer string").select(codec.partition_id(codec.encode_kmer(F.col("kmer")), 3)).collect()
    assert [p[0] for p in parts] == [0, 0, 3]


def test_both_ways_to_spell_a_kmer(spark):
    rnd = random.Random(8)
    for k in (1, 2, 10, 21, 31):
        encs = [(0,), (4**k - 1,), (None,)] + [(rnd.randrange(4**k),) for _ in range(50)]
        both = spark.createDataFrame(encs, "enc long").select(kmers.spelt(F.col("enc"), k).alias("a"), codec.decode_kmer(F.col("enc"), k).alias("b")).collect()
        assert all(r.a == r.b for r in both) and sum(r.a is None for r in both) == 1


def test_packing(spark):
    seqs = ["ACGTN", "ACGTACGTAC", "ACGTACGTACG", "", "acgt\rACGT", None]
    packed = packing.pack(frame(spark, seqs).withColumn("id", F.monotonically_increasing_id()))
    got = [(r.header, r.blocks) for r in packed.orderBy("id").collect()]
    assert got[0] == (3221225477, [21889024])
    assert got[1][1] == [21763265] and got[2][1] == [21763265, 268435456] and got[3][1] == []
    back = [r.seq for r in packing.unpack(packed).orderBy("id").collect()]
    assert back == ["ACGTN", "ACGTACGTAC", "ACGTACGTACG", "", "NNNNNACGT", None]
    assert packing.packed_size(frame(spark, seqs)).first()["bytes"] == 4 * (2 + 2 + 3 + 1 + 2)


def test_stored_packed_reads(spark, tmp_path):
    path = str(tmp_path / "packed")
    seqs = ["ACGTN", "ACGTACGTACG", "", None]
    packing.save(packing.pack(frame(spark, seqs)), path)
    assert sorted(str(r.seq) for r in packing.unpack(packing.load(spark, path)).collect()) == sorted(map(str, seqs))
    for header, blocks in ((5, [1]), ((3 << 30) + 11, [1]), (None, [1])):
        packing.save(spark.createDataFrame([(header, blocks)], "header long, blocks array<long>"), path)
        with pytest.raises(PySparkException):
            packing.load(spark, path).collect()


def test_lookup(spark):
    counts = spark.createDataFrame([("AAAAA", 5), ("AAAAC", 2), ("AACGT", 3)], "kmer string, cnt long")
    queries = spark.createDataFrame(list(enumerate(["AAAAA", "AAAAC", "ACGTT", "TTTTT", "AAAAA"])), "qid int, kmer string")
    run = lambda **o: [r.cnt for r in lookup.lookup(counts, queries, **o).orderBy("qid").collect()]
    assert run() == [5, 2, 0, 0, 5]
    assert run(mode="canonical") == [5, 2, 3, 5, 5]
    assert run(dup="last") == [0, 2, 0, 0, 5]
    with pytest.raises(ValueError):
        lookup.lookup(counts, queries, mode="x")


def test_tables(spark, tmp_path):
    counts = kmers.count(frame(spark, ["AACGTTNAAAAA", "GATTACAGATTACA"]), 5)
    path = str(tmp_path / "counts")
    tables.save(counts, 5, path)
    want = {(r.kmer, r.cnt) for r in counts.collect()}
    assert {(r.kmer, r.cnt) for r in tables.load(spark, path, 5).collect()} == want
    with pytest.raises(ValueError):
        tables.load(spark, path, 7)
    queries = spark.createDataFrame([(0, "AAAAA"), (1, "GGGGG")], "qid int, kmer string")
    pruned = tables.load(spark, path, 5, lookup.parts_of(queries, 5))
    assert [r.cnt for r in lookup.lookup(pruned, queries).orderBy("qid").collect()] == [1, 0]
    assert "PartitionFilters: [part" in pruned._jdf.queryExecution().toString()
    double = tables.merge(counts, counts)
    assert {(r.kmer, r.cnt) for r in double.collect()} == {(k, 2 * c) for k, c in want}
    stored = tables.partitioned(counts, 5)
    again = tables.from_flat(tables.flat(stored), 5)
    assert {tuple(r) for r in again.collect()} == {(r.enc, r.cnt) for r in stored.collect()}
    stats = tables.partition_stats(counts, 5).agg(F.sum("total"), F.sum("distinct_kmers")).first()
    assert tuple(stats) == (sum(c for _, c in want), len(want)) == tuple(tables.totals(counts).first())[1::-1]
    assert {tuple(r) for r in tables.merge_flat(counts, tables.flat(stored), 5).collect()} == {(k, 2 * c) for k, c in want}
    tables.save(counts, 5, path, mode="append")
    assert {(r.kmer, r.cnt) for r in tables.added_up(tables.load(spark, path, 5)).collect()} == {(k, 2 * c) for k, c in want}
    by_rest = {(r.part, r.enc % 100) for r in tables.partitioned(counts, 5, by="remainder").collect()}
    assert all(a == b for a, b in by_rest)
    with pytest.raises(ValueError):
        tables.partitioned(counts, 5, by="x")
    lookup.write_result(lookup.lookup(counts, queries), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["AAAAA\t1", "GGGGG\t0"]


def test_fastq(spark, tmp_path):
    import gzip

    record = "@{0}\n{1}\n+\n@{0}II\n"
    (tmp_path / "a.fastq").write_text(record.format(1, "ACGT") + record.format(2, "") + "@3\nGATTACA\r\n+\nIIIIIII\n@4\nTTTT")
    (tmp_path / "b.fastq").write_text(record.format(1, "CCCC"))
    with gzip.open(tmp_path / "c.fastq.gz", "wt") as f:
        f.write(record.format(1, "GGGG"))
    got = sorted((r.path.rsplit("/", 1)[1], r.read_id, r.seq) for r in sources.read_fastq(spark, str(tmp_path)).collect())
    assert got == [("a.fastq", 0, "ACGT"), ("a.fastq", 1, ""), ("a.fastq", 2, "GATTACA\r"), ("a.fastq", 3, "TTTT"), ("b.fastq", 0, "CCCC"), ("c.fastq.gz", 0, "GGGG")]


def test_fastq_over_many_splits(spark, tmp_path):
    (tmp_path / "x.fastq").write_text("".join(f"@{i}\n{'ACGT' * (i % 7)}C\n+\nI\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = sources.read_fastq(spark, str(tmp_path)).orderBy("read_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.read_id, r.seq) for r in got] == [(i, "ACGT" * (i % 7) + "C") for i in range(3000)]


def test_query_lists(spark, tmp_path):
    path = tmp_path / "q"
    path.write_text("AAAAAxyz\nACGTA\nCCCCC\n")
    assert [tuple(r) for r in sources.read_queries(spark, str(path), 5, 2).orderBy("qid").collect()] == [(0, "AAAAA"), (1, "ACGTA")]
    with pytest.raises(ValueError):
        sources.read_queries(spark, str(path), 5, 4)
    path.write_text("AANAA\n")
    with pytest.raises(PySparkException):
        sources.read_queries(spark, str(path), 5, 1).collect()
    path.write_text("AAA\n")
    with pytest.raises(PySparkException):
        sources.read_queries(spark, str(path), 5, 1).collect()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.txt").write_text("AACGTT\nGATTACA\n")
    reads = streaming.stream_reads(spark, str(tmp_path / "in"))
    got = streaming.run_available(streaming.stream_counts(reads, 3), str(tmp_path / "out"))
    assert {r.kmer: r.cnt for r in got.collect()} == naive(["AACGTT", "GATTACA"], 3)
