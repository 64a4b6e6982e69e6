import random
import tracemalloc
from collections import Counter
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.types import ArrayType, LongType, StructType
from strandloom.operators import kmers
from strandloom.plans import catalog
from strandloom.sources import packed as packed_source
from strandloom.sources.files import listed
from strandloom.sources.reads import TEXT_FROM, TEXT_TO


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def lines_of(rows):
    """(doc_id, line, bases) of each line, in plain Python."""
    turned = {ord(a): b for a, b in zip(TEXT_FROM, TEXT_TO, strict=True)}
    for doc_id, text in rows:
        for line, raw in enumerate((text or "").split("\n")):
            yield doc_id, line, "".join(c if c in "ACGT" else "N" for c in raw.translate(turned))


def test_windows_of_a_read_are_not_sorted(spark, tmp_path):
    rows = [(1, "Gattaca and more\nabc\n\n1234567"), (2, "x" * 40_000), (1, "Tttttt zz\nccccc"), (None, "words here"), (3, None)]
    want = {}
    for doc_id, line, seq in lines_of(rows):
        want.setdefault((doc_id, line), []).extend(w for i in range(len(seq) - 4) if "N" not in (w := seq[i : i + 5]))
    got = catalog.kmer_extract_k5(spark, documents(spark, tmp_path, rows))
    assert {(r.doc_id, r.line): (r.n_kmers, r.first_kmer, r.last_kmer) for r in got.collect()} == {k: (len(v), min(v), max(v)) for k, v in want.items() if v}
    assert "Sort" not in got._jdf.queryExecution().executedPlan().toString()


def canonical_counts(seqs, k):
    out = Counter()
    for s in seqs:
        for w in (s[i : i + k] for i in range(len(s) - k + 1)):
            if "N" not in w:
                out[min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA")))] += 1
    return dict(out)


@pytest.mark.parametrize("k", [21, 31])
def test_counts_are_shuffled_as_buckets_of_runs(spark, tmp_path, k):
    rand = random.Random(k)
    words = ["".join(rand.choice("abcdefgh") for _ in range(rand.randrange(1, 9))) for _ in range(400)]
    rows = [(i, " ".join(rand.choices(words, k=300)) + rand.choice("\n12")) for i in range(150)] + [(7, None), (8, "short")]
    got = catalog.QUERIES[f"kmer_counts_k{k}"](spark, documents(spark, tmp_path, rows))
    assert {r.kmer: r.cnt for r in got.collect()} == canonical_counts([s for *_, s in lines_of(rows)], k)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "hashpartitioning(bucket" in plan


def test_buckets_of_any_sizes_are_added_up(spark, monkeypatch):
    rand = random.Random(4)
    seqs = ["".join(rand.choice("ACGTN" if n % 2 else "AC") for _ in range(rand.randrange(90))) for n in range(120)]
    reads = spark.createDataFrame([(s,) for s in seqs], "seq string").repartition(5)
    for added, bits, batch in ((3, 2, "4"), (50, 12, "10000"), (1 << 20, 1, "3")):
        monkeypatch.setattr(kmers, "ADDED", added)
        monkeypatch.setattr(kmers, "BUCKET_BITS", bits)
        monkeypatch.setattr(kmers, "BUCKETS", 1)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            for k in (1, 6, 13, 31):
                rows = kmers.count(reads, k, enc=True).collect()
                assert {r.kmer: r.cnt for r in rows} == canonical_counts(seqs, k) and len(rows) == len({r.enc for r in rows})
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_packed_runs_come_back():
    rand = np.random.default_rng(5)
    for k in (1, 2, 9, 21, 31):
        for bits in {1, min(12, 2 * k), min(30, 2 * k)}:
            shift, runs = 2 * k - bits, []
            for m in (1, 3, 5000):
                enc = np.unique(np.append(rand.integers(0, 4**k, m), 4**k - 1))
                keys = np.sort(kmers.spread(enc, k))
                assert (np.sort(kmers.gathered(keys, k)) == enc).all() and 0 <= keys[0] <= keys[-1] < 4**k
                runs.append((keys, rand.integers(1, 1 << int(rand.integers(1, 62)), len(keys))))
            # Runs of different widths in one batch, as the shuffle brings them.
            rows = pa.Table.from_batches([kmers.packed(*r, shift) for r in runs]).combine_chunks().to_batches()[0]
            cut = len(kmers.packed(*runs[0], shift))
            both = [np.concatenate(x) for x in zip(*(kmers.unpacked(rows.slice(a, n), shift) for a, n in ((0, cut), (cut, len(rows) - cut))), strict=True)]
            assert all((a == np.concatenate(b)).all() for a, b in zip(both, zip(*runs, strict=True), strict=True))
    # Text has most of its k-mers near each other; their buckets are of even sizes.
    keys = kmers.spread(np.arange(1 << 16), 21)
    assert np.bincount(keys >> 30, minlength=4096).max() <= 2 * 16


def test_asked_kmers_that_are_too_long_have_no_count(spark):
    reads = spark.createDataFrame([("ACGTTGCAAC",)], "seq string")
    asked = spark.createDataFrame([("AACGT",), ("TTGCA",), ("GGGGG",), ("TACGTA",)], "kmer string")
    assert {(r.kmer, r.cnt) for r in kmers.counts_of(reads, asked, 5, canonical=False).collect()} == {("TTGCA", 1)}


def test_memory_of_packed_reads_is_that_of_a_piece(tmp_path):
    rand = np.random.default_rng(6)
    letters = rand.choice(np.frombuffer(b"ACGTN", np.uint8), 12_000_000)
    seqs = [letters[a : a + 300].tobytes().decode() for a in range(0, len(letters), 300)]
    writer = packed_source.Writer({"path": str(tmp_path)}, StructType().add("seq", "string"), False)

    class Task:
        partitionId = staticmethod(lambda: 0)

    def peak(run):
        tracemalloc.start()
        try:
            return run(), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    batch = pa.RecordBatch.from_arrays([pa.array(seqs)], names=["seq"])
    with mock.patch.object(packed_source.TaskContext, "get", Task):
        message, written = peak(lambda: writer.write(iter([batch])))
    writer.commit([message])
    (part,) = packed_source.ranges(listed(str(tmp_path)), 1 << 30)
    sizes, read = peak(lambda: [len(b) for b in packed_source.records(part, ["header", "seq"])])
    # Before, the writer took 24 bytes for each of the 12 million bases, and the reader 280 MB.
    assert max(written, read) < 120e6 and sum(sizes) == len(seqs) and max(sizes) * 300 <= packed_source.PIECE
    back = [s for b in packed_source.records(part, ["seq"]) for s in b.column(0).to_pylist()]
    assert back == seqs


def test_pieces_of_packed_reads_give_the_same_files(spark, tmp_path, monkeypatch):
    rand = random.Random(7)
    seqs = ["", None, "Aé😀T", "ACGT" * 30] + ["".join(rand.choice("ACGTN") for _ in range(rand.randrange(60))) for _ in range(300)]
    for size in (1, 50, 1 << 20):
        monkeypatch.setattr(packed_source, "PIECE", size)
        assert [i for a, b in packed_source.pieces(np.array([len(s or "") for s in seqs])) for i in range(a, b)] == list(range(len(seqs)))
        writer = packed_source.Writer({"path": f"{tmp_path}/{size}"}, StructType().add("seq", "string"), False)
        with mock.patch.object(packed_source.TaskContext, "get", lambda: mock.Mock(partitionId=lambda: 0)):
            writer.commit([writer.write(iter([pa.RecordBatch.from_arrays([pa.array(seqs, pa.string())], names=["seq"])]))])
        (part,) = packed_source.ranges(listed(f"{tmp_path}/{size}"), 1 << 30)
        rows = [r for b in packed_source.records(part, ["offset", "header", "blocks", "seq"]) for r in b.to_pylist()]
        want = ["".join(c if c in "ACGT" else "N" for c in s) for s in seqs if s is not None]
        assert [r["seq"] for r in rows] == want and [r["header"] for r in rows] == [(3 << 30) + len(s) for s in want]
        packed_batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows] + [None]) for c in ("header", "blocks")], names=["header", "blocks"])
        again = packed_source.Writer({"path": f"{tmp_path}/{size}-again"}, StructType().add("header", "long").add("blocks", ArrayType(LongType())), False)
        with mock.patch.object(packed_source.TaskContext, "get", lambda: mock.Mock(partitionId=lambda: 0)):
            again.commit([again.write(iter([packed_batch.slice(0, 7), packed_batch.slice(7)]))])
        (other,) = packed_source.ranges(listed(f"{tmp_path}/{size}-again"), 1 << 30)
        assert open(part.path, "rb").read() == open(other.path, "rb").read()
