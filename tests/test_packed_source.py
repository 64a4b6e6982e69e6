import glob
import random
import struct

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from strandloom.operators import packing
from strandloom.sources import files, packed


def naive_bytes(seqs):
    out = b""
    for s in seqs:
        codes = [("ACGT".index(c) if c in "ACGT" else 4) for c in s]
        words = [sum(c << 3 * (9 - i) for i, c in enumerate(codes[a : a + 10])) for a in range(0, len(codes), 10)]
        out += struct.pack(f"<{len(words) + 1}I", (3 << 30) + len(s), *words)
    return out


def split_rows(path, split_bytes, columns=("seq",)):
    return [tuple(r.values()) for part in packed.ranges(files.listed(str(path)), split_bytes) for batch in packed.records(part, list(columns)) for r in batch.to_pylist()]


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seqs=st.lists(st.text("ACGTN", max_size=45), max_size=30), split=st.integers(1, 200), block=st.integers(1, 30))
def test_any_ranges_and_blocks_give_the_reads_in_order(tmp_path_factory, seqs, split, block):
    path = tmp_path_factory.mktemp("p") / "x.bin"
    path.write_bytes(naive_bytes(seqs))
    old, packed.BLOCK = packed.BLOCK, 4 * block
    try:
        offsets = np.append(0, np.cumsum([4 + 4 * -(-len(s) // 10) for s in seqs])).tolist()
        assert split_rows(path, split, ("offset", "seq")) == list(zip(offsets, seqs, strict=False))
    finally:
        packed.BLOCK = old
    data, lengths = np.frombuffer("".join(seqs).encode(), np.uint8), np.array([len(s) for s in seqs], np.int64)
    assert packed.pack_words(data, lengths).tobytes() == naive_bytes(seqs)


def test_files_from_bases_and_from_packed_reads(spark, tmp_path):
    rand = random.Random(2)
    seqs = ["", None, "acgt\rACGT", "Aé😀T"] + ["".join(rand.choice("ACGTN") for _ in range(rand.randrange(60))) for _ in range(400)]
    reads = spark.createDataFrame([(s, 1) for s in seqs], "seq string, extra int").repartition(3)
    want = sorted("".join(c if c in "ACGT" else "N" for c in s) for s in seqs if s is not None)
    for n, frame in enumerate((reads, packing.pack(reads))):
        path = f"{tmp_path}/{n}"
        packed.write_packed(frame, path)
        got = packed.read_packed(spark, f"file://{path}", "header long, blocks array<long>, seq string", split_bytes=500)
        assert got.rdd.getNumPartitions() > 10 and sorted(r.seq for r in got.collect()) == want
        assert sorted(r.seq for r in packing.unpack(got.drop("seq")).collect()) == want
        assert all(b"".join(naive_bytes([r[0]]) for r in split_rows(f, 1 << 20)) == open(f, "rb").read() for f in glob.glob(f"{path}/*.bin"))
        packed.write_packed(frame.limit(1), path, mode="overwrite")
        assert packed.read_packed(spark, path).count() <= 1
    packed.write_packed(reads.limit(0), f"{tmp_path}/none")
    assert packed.read_packed(spark, f"{tmp_path}/none").collect() == []


def test_damage_is_an_error_that_names_the_byte(tmp_path):
    good = naive_bytes(["ACGTACGTACGT", "GG", ""])
    path = tmp_path / "x.bin"
    word = lambda i, w: good[: 4 * i] + struct.pack("<I", w) + good[4 * i + 4 :]
    cases = {
        word(0, 5): "no header of a read at byte 0",
        word(0, (3 << 30) + 25): "fit the words after it at byte 0",
        word(3, (3 << 30) + 11): "fit the words after it at byte 12",
        word(1, 1 << 30): "no bases at byte 4",
        word(2, 1 << 31): "no bases at byte 8",
        word(2, 5 << 12): "no bases at byte 8",
        good[:-8]: "fit the words after it at byte 12",
        good[:-1]: "no whole number of words",
    }
    for data, why in cases.items():
        path.write_bytes(data)
        with pytest.raises(ValueError, match=why):
            split_rows(path, 1 << 20)
    path.write_bytes(good)
    assert split_rows(path, 4) == [("ACGTACGTACGT",), ("GG",), ("",)]


def test_lost_attempts_are_not_read_and_columns_are_checked(spark, tmp_path):
    path = str(tmp_path / "p")
    packed.write_packed(spark.createDataFrame([("ACGT",)], "seq string"), path)
    with open(f"{path}/_000000-lost.bin", "wb") as f:
        f.write(b"half")
    assert [r.seq for r in packed.read_packed(spark, path, "seq string").collect()] == ["ACGT"]
    with pytest.raises(Exception, match="have no bases"):
        packed.read_packed(spark, path, "bases string").collect()
    with pytest.raises(Exception, match="from header and blocks, or from seq"):
        spark.range(1).write.format("packed_reads").mode("append").save(path)
