import glob
import json
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandloom.operators import kmers, lookup, tables, versions
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


def reads(seed, n=60, size=80):
    rand = random.Random(seed)
    return ["".join(rand.choice("ACGTN" if rand.random() < 0.02 else "ACGT") for _ in range(rand.randrange(size))) for _ in range(n)]


def frame(spark, seqs):
    return spark.createDataFrame([(s,) for s in seqs], "seq string")


def stored(spark, path, k=7):
    return {r.kmer: r.cnt for r in tables.added_up(tables.load(spark, path, k)).collect()}


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/version=*/part=*/*.parquet")}


def some_parts(spark, seqs, k, keep):
    return kmers.count(frame(spark, seqs), k, enc=True).where(F.col("enc").isNotNull()).transform(lambda d: tables.partitioned(d, k, 10)).where(F.col("part").isin(keep))


def test_upsert_writes_the_touched_parts_alone(spark, tmp_path):
    path, seqs = str(tmp_path / "t"), reads(1, 300)
    tables.save(kmers.count(frame(spark, seqs), 7, enc=True), 7, path, partitions=10)
    before, entry = files(path), tables.latest(spark, path)
    assert len(entry.versions) == 10
    delta = some_parts(spark, reads(2, 200), 7, [7])
    want = Counter(stored(spark, path))
    want.update({r.kmer: r.cnt for r in delta.collect()})
    assert tables.upsert(delta, 7, path) == [7]
    after, now = files(path), tables.latest(spark, path)
    live = {f for f in after if any(f.startswith(d) for d in versions.folders(path, now.versions))}
    assert all(after[f] == before[f] for f in live & set(before))
    assert all("part=7/" in f for f in live - set(before)) and len(live - set(before)) == 1
    assert stored(spark, path) == dict(want)
    assert {r.kmer: r.cnt for r in tables.load(spark, path, 7).collect()} == dict(want)  # one row for each k-mer


def test_upsert_again_after_a_failure_gives_the_same_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    first, second = kmers.count(frame(spark, reads(3)), 7, enc=True), kmers.count(frame(spark, reads(4)), 7, enc=True)
    tables.save(first, 7, path, partitions=10)
    want = Counter({r.kmer: r.cnt for r in first.collect()})
    kept = stored(spark, path)

    def fails(*_):
        raise OSError("the driver was lost")

    with monkeypatch.context() as m:
        m.setattr(versions, "commit", fails)
        with pytest.raises(OSError):
            tables.upsert(second, 7, path, batch=("job", 1))
    assert stored(spark, path) == kept
    want.update({r.kmer: r.cnt for r in second.collect()})
    assert tables.upsert(second, 7, path, batch=("job", 1)) and stored(spark, path) == dict(want)
    assert tables.upsert(second, 7, path, batch=("job", 1)) == [] and stored(spark, path) == dict(want)
    tables.save(second, 7, path, mode="append", batch=("job", 0), partitions=10)
    assert stored(spark, path) == dict(want)
    left = [d for d in os.listdir(path) if d.startswith("version=")]
    assert len(tables.vacuum(spark, path)) >= 2 and len(left) > len([d for d in os.listdir(path) if d.startswith("version=")])
    assert stored(spark, path) == dict(want) and len(glob.glob(f"{path}/_log/*.json")) == 1


def test_an_entry_that_was_not_finished_does_not_count_and_two_changes_do_not_mix(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.save(kmers.count(frame(spark, reads(5)), 7, enc=True), 7, path, partitions=10)
    kept, entry = stored(spark, path), tables.latest(spark, path)
    with open(f"{path}/_log/000000000001.json", "w") as f:
        f.write(json.dumps({"k": 7})[:4])
    assert stored(spark, path) == kept
    tables.save(kmers.count(frame(spark, ["ACGTACG"]), 7, enc=True), 7, path, mode="append", partitions=10)
    with pytest.raises(RuntimeError, match="changed by another job"):
        versions.commit(spark, path, entry, entry)


def test_compaction_after_appends(spark, tmp_path):
    path, batches = str(tmp_path / "t"), [reads(s, 40) for s in range(10, 14)]
    for n, seqs in enumerate(batches):
        tables.save(kmers.count(frame(spark, seqs), 7, enc=True), 7, path, mode="append" if n else "overwrite", partitions=10)
    want = naive(sum(batches, []), 7)
    assert stored(spark, path) == want and tables.load(spark, path, 7).count() > len(want)
    entry = tables.latest(spark, path)
    assert tables.compact(spark, path, 7, least=5) == []
    assert tables.compact(spark, path, 7) == sorted(p for p, v in entry.versions.items() if len(v) > 1)
    assert {len(v) for v in tables.latest(spark, path).versions.values()} == {1}
    assert {r.kmer: r.cnt for r in tables.load(spark, path, 7).collect()} == want


def test_empty_tables_and_wrong_ones(spark, tmp_path):
    path = str(tmp_path / "t")
    none = kmers.count(frame(spark, ["AC"]), 7, enc=True)
    with pytest.raises(ValueError, match="no stored table"):
        tables.load(spark, path, 7)
    tables.save(none, 7, path, partitions=10)
    assert tables.load(spark, path, 7).collect() == [] and tables.upsert(none, 7, path) == [] and tables.compact(spark, path, 7) == []
    queries = spark.createDataFrame([(0, "ACGTACG")], "qid int, kmer string")
    assert [tuple(r) for r in lookup.lookup_stored(spark, path, queries, 7).collect()] == [(0, "ACGTACG", 0)]
    assert [tuple(r) for r in lookup.lookup_stored(spark, path, queries.limit(0), 7).collect()] == []
    for change in (lambda: tables.save(none, 9, path, mode="append", partitions=10), lambda: tables.upsert(none, 9, path), lambda: tables.save(none, 7, path, mode="append", partitions=20), lambda: tables.save(none, 7, path, mode="x")):
        with pytest.raises(ValueError):
            change()


def scanned(df):
    """The rows that the scan of a plan gave out when df was collected."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_lookup_reads_the_pages_that_may_hold_a_query(spark, tmp_path):
    path, k = str(tmp_path / "t"), 15
    everything = spark.range(300_000).select((F.col("id") * 3571).alias("enc"), F.lit(1).cast("long").alias("cnt"), F.lit("").alias("kmer"))
    tables.save(everything, k, path, partitions=1)
    few = np.array([3571 * 7, 3571 * 250_000])
    table = tables.load(spark, path, k, [0])
    assert scanned(table.where(F.col("cnt") > 0).select("enc")) == 300_000
    chosen = table.where(tables.among(F.col("enc"), few)).select("enc", "cnt")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(enc" in plan and scanned(chosen) <= 60_000 and chosen.count() == 2
    many = np.sort(np.concatenate([np.arange(0, 400) * 3571, np.arange(200_000, 200_400) * 3571]))
    ranged = table.where(tables.among(F.col("enc"), many)).select("enc", "cnt")
    assert "PushedFilters: [Or(" in ranged._jdf.queryExecution().executedPlan().toString() and scanned(ranged) <= 60_000
    assert {r.enc for r in ranged.collect()} >= set(many.tolist())


def test_lookups_agree(spark, tmp_path):
    path, seqs, k = str(tmp_path / "t"), reads(20, 200), 6
    for n, some in enumerate((seqs[:150], seqs[150:])):
        tables.save(kmers.count(frame(spark, some), k, enc=True), k, path, mode="append" if n else "overwrite", partitions=10)
    rand, want = random.Random(1), naive(seqs, k)
    asked = [(i, "".join(rand.choice("ACGT") for _ in range(k))) for i in range(300)] + [(300 + i, s) for i, s in enumerate(sorted(want)[:50])]
    queries = spark.createDataFrame(asked, "qid int, kmer string")
    turned = lambda s: min(s, s[::-1].translate(str.maketrans("ACGT", "TGCA")))
    for mode, key in (("exact", str), ("canonical", turned)):
        expected = [(q, s, want.get(key(s), 0)) for q, s in asked]
        assert sorted(map(tuple, lookup.lookup_stored(spark, path, queries, k, mode=mode).collect())) == expected
        assert sorted(map(tuple, lookup.count_and_lookup(frame(spark, seqs), queries, k, mode=mode).collect())) == expected


def test_lists_beyond_the_bound_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lookup, "MOST_BROADCAST", 3)
    monkeypatch.setattr(kmers, "MOST_ASKED", 3)
    test_lookups_agree(spark, tmp_path)


def test_only_hits_leave_the_tasks(spark):
    seqs = reads(30, 400)
    asked = spark.createDataFrame([(s,) for s in sorted(naive(seqs, 9))[:5]], "kmer string")
    found = kmers.counts_of(frame(spark, seqs).repartition(4), asked, 9)
    assert {r.kmer: r.cnt for r in found.collect()} == {s: naive(seqs, 9)[s] for s in sorted(naive(seqs, 9))[:5]}
    assert kmers.counts_of(frame(spark, seqs), asked.limit(0), 9).collect() == []
    task = kmers.Asked(np.array([3, 5, 9]))
    assert all(not list(task.add(found)) for found in (np.array([1, 3, 3, 10]), np.array([], int), np.array([9, 0])))
    assert [(k.tolist(), n.tolist()) for k, n in task.end()] == [([3, 9], [2, 1])]


def test_flat_arrays_have_a_bounded_size_and_their_place(spark):
    counts = kmers.count(frame(spark, reads(40, 300)), 7, enc=True)
    stored_rows = sorted((r.part, r.enc, r.cnt) for r in tables.partitioned(counts, 7, 3).collect())
    for pairs in (1, 7, 1 << 16):
        got = sorted(tables.flat(tables.partitioned(counts, 7, 3), pairs).collect())
        assert all(0 < len(r.pairs) <= 2 * pairs and r.offset == r.chunk * pairs for r in got)
        assert [(r.part, r.pairs[i], r.pairs[i + 1]) for r in got for i in range(0, len(r.pairs), 2)] == stored_rows
    assert tables.flat(tables.partitioned(counts.limit(0), 7)).collect() == []
    with pytest.raises(ValueError):
        tables.flat(counts, 0)


def test_runs_of_a_task_are_merged_up_to_a_bound(monkeypatch):
    rand = np.random.default_rng(1)
    for run, held, dense, spread in ((10, 1000, 0, 50), (10, 40, 0, 50), (10, 60, 0, 10**9), (16, 64, 1 << 22, 4**5)):
        monkeypatch.setattr(kmers, "RUN", run)
        monkeypatch.setattr(kmers, "HELD", held)
        monkeypatch.setattr(kmers, "DENSE", dense)
        runs, want, out = kmers.Runs(5), Counter(), []
        for _ in range(60):
            found = rand.integers(0, spread, rand.integers(0, 15))
            want.update(found.tolist())
            out += list(runs.add(found))
            assert sum(len(k) for k, _ in runs.levels) <= held + 2 * run + 30
        out += list(runs.end())
        got = Counter()
        for keys, n in out:
            assert (np.diff(keys) > 0).all()
            got.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
        assert got == want
        if spread == 50 and held == 1000:
            assert len(out) == 1  # all of it met in the task


def test_stream_into_a_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming, "COMPACT_EVERY", 2)
    (tmp_path / "in").mkdir()
    path, seen = str(tmp_path / "t"), []
    for n in range(3):
        seqs = reads(50 + n, 20)
        (tmp_path / "in" / f"{n}.fastq").write_text("".join(f"@{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(seqs)))
        seen += seqs
        for _ in range(2):  # the second time nothing new is there
            streaming.stream_into_table(streaming.stream_fastq(spark, str(tmp_path / "in"), str(tmp_path / "log")), 7, path, str(tmp_path / "progress"), partitions=10)
            assert stored(spark, path) == naive(seen, 7)
    assert max(len(v) for v in tables.latest(spark, path).versions.values()) <= 2


def test_stream_state_gets_counts_of_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.txt").write_text("AACGTT\nGATTACA\n" * 50)
    counts = streaming.stream_counts(streaming.stream_reads(spark, str(tmp_path / "in")), 3)
    got = streaming.run_available(counts, str(tmp_path / "out"))
    assert {r.kmer: r.cnt for r in got.collect()} == naive(["AACGTT", "GATTACA"] * 50, 3)
