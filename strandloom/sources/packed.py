"""Packed reads in plain binary files: the data source `packed_reads`, after register(spark).

A file is a row of 32-bit words in the order of the machine that wrote it, here little-endian: for each read a header, whose two high bits are set above a length of
30 bits, then a word for each ten bases, three bits each, the first base in the highest. The high bits of these words are never set, so a header is known by its own
bits: a range of bytes starts with the first header in it, and no other task is asked. Headers and the numbers of words between them are compared for a whole
block at once, and a header that doesn't fit the words after it, a word with one high bit or a code above 4 is an error that names file and byte.
Bases are made from words, and words from bases, for some PIECE of them at a time, whole reads each, however large blocks and batches are.

Columns to read, of which a schema chooses: path; offset, the byte of the header; header and blocks; seq, the bases (N for any other character).
Columns to write: header and blocks, or seq. Null reads are not stored. Order within a file is that of the partition; each task writes files of its own,
which get their names when all tasks are done, so what an attempt left that was lost is not read. Options: path and split_bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.codec import BASES_PER_BLOCK
from .fastq import Range, ranges
from .files import file_system, listed

SCHEMA = "path string, offset long, header long, blocks array<long>"
SPLIT_BYTES, BLOCK = 64 << 20, 8 << 20
#: Bases that are packed or unpacked at once, or those of one longer read; the memory is a few bytes for each.
PIECE = 1 << 20
HEADER = np.uint32(3 << 30)
SHIFTS = np.arange(3 * (BASES_PER_BLOCK - 1), -1, -3, dtype=np.uint32)
BASES = np.frombuffer(b"ACGTN???", np.uint8)
CODES = np.full(256, 4, np.uint8)
CODES[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with some PIECE of bases together; a row with more is one by itself."""
    done, a = np.append(0, np.cumsum(sizes)), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(done, done[a] + PIECE, "right")) - 1)
        yield a, b
        a = b


def _filled(lengths: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which places in the words of reads hold a base: each read starts a word, and what its last one has beyond is padding of code 0."""
    ends, padding = np.cumsum(words) * BASES_PER_BLOCK, words * BASES_PER_BLOCK - lengths
    out = np.ones(int(words.sum()) * BASES_PER_BLOCK, bool)
    for j in range(1, BASES_PER_BLOCK):
        out[ends[padding >= j] - j] = False
    return out


def pack_words(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Headers and words of reads whose characters stand one after the other in data."""
    words = -(-lengths // BASES_PER_BLOCK)
    codes = np.zeros(int(words.sum()) * BASES_PER_BLOCK, np.uint8)
    codes[_filled(lengths, words)] = CODES[data]
    packed = np.zeros(len(codes) // BASES_PER_BLOCK, np.uint32)
    for j, shift in enumerate(SHIFTS):
        packed |= codes[j::BASES_PER_BLOCK].astype(np.uint32) << shift
    return with_headers(HEADER + lengths.astype(np.uint32), packed, words)


def with_headers(headers: np.ndarray, blocks: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = np.empty(len(headers) + len(blocks), "<u4")
    at = np.cumsum(words) - words + np.arange(len(words))
    rest = np.ones(len(out), bool)
    rest[at] = False
    out[at], out[rest] = headers, blocks
    return out


def unpack_bases(blocks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The characters of reads whose words stand one after the other."""
    letters = np.empty((len(blocks), BASES_PER_BLOCK), np.uint8)
    for j, shift in enumerate(SHIFTS):
        letters[:, j] = BASES[blocks >> shift & np.uint32(7)]
    return letters.ravel()[_filled(lengths, -(-lengths // BASES_PER_BLOCK))]


def _words(part: Range) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, words) of a range: whole reads, the first at the first header; the last may go on beyond the range."""
    system, inside = file_system(part.path)
    start, stop = -(-part.start // 4) * 4, part.stop
    if part.size % 4:
        raise ValueError(f"{part.path}: {part.size} bytes are no whole number of words")
    with system.open_input_file(inside) as f:
        f.seek(start)
        left, offset, found = np.zeros(0, "<u4"), start, start == 0
        while offset < part.size:
            more = f.read(BLOCK)
            data = np.concatenate([left, np.frombuffer(more, "<u4")])
            heads = np.flatnonzero(data >= HEADER)
            if not found:
                if not len(heads):
                    if not more or offset + 4 * len(data) >= stop:
                        return
                    offset, left = offset + 4 * len(data), data[:0]
                    continue
                data, offset, found = data[heads[0] :], offset + 4 * int(heads[0]), True
                heads = heads - heads[0]
            if offset >= stop:
                return
            # The last read may not be whole yet; what starts beyond the range is left to its own task.
            last = int(heads[-1]) if more and len(heads) else len(data)
            beyond = heads[offset + 4 * heads >= stop]
            if len(beyond):
                last = min(last, int(beyond[0]))
            if last:
                yield offset, data[:last]
            if len(beyond) or not more:
                return
            offset, left = offset + 4 * last, data[last:]


def _checked(path: str, offset: int, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the headers are, the lengths, and the blocks of whole reads."""

    def wrong(at: int, why: str) -> ValueError:
        return ValueError(f"{path}: {why} at byte {offset + 4 * int(at)}")

    heads = np.flatnonzero(data >= HEADER)
    if not len(heads) or heads[0]:
        raise wrong(0, "no header of a read")
    lengths = (data[heads] - HEADER).astype(np.int64)
    there = np.diff(np.append(heads, len(data))) - 1
    if len(bad := np.flatnonzero(there != -(-lengths // BASES_PER_BLOCK))):
        raise wrong(heads[bad[0]], "a header that doesn't fit the words after it")
    rest = np.ones(len(data), bool)
    rest[heads] = False
    blocks = data[rest]
    # A code of 5 to 7 has the high bit of its three set, and another.
    odd = (blocks >> np.uint32(30) != 0) | (blocks >> np.uint32(2) & (blocks | blocks >> np.uint32(1)) & np.uint32(0o1111111111) != 0)
    if len(bad := np.flatnonzero(odd)):
        raise wrong(np.flatnonzero(rest)[bad[0]], "a word that holds no bases")
    return heads, lengths, blocks


def records(part: Range, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The reads whose headers stand in a range."""
    for offset, data in _words(part):
        heads, lengths, blocks = _checked(part.path, offset, data)
        starts = np.append(0, np.cumsum(-(-lengths // BASES_PER_BLOCK)))
        for a, b in pieces(lengths):
            yield _batch(part.path, offset + 4 * heads[a:b], lengths[a:b], blocks[starts[a] : starts[b]], columns)


def _batch(path: str, at: np.ndarray, lengths: np.ndarray, blocks: np.ndarray, columns: list[str]) -> pa.RecordBatch:
    """Reads whose headers stand at some bytes of a file."""

    def offsets(sizes: np.ndarray) -> pa.Buffer:
        return pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32))

    n = len(at)
    make = {
        "path": lambda: pa.array(np.full(n, path, object), pa.string()),
        "offset": lambda: pa.array(at),
        "header": lambda: pa.array(lengths + int(HEADER)),
        "blocks": lambda: pa.Array.from_buffers(pa.list_(pa.int64()), n, [None, offsets(-(-lengths // BASES_PER_BLOCK))], children=[pa.array(blocks.astype(np.int64))]),
        "seq": lambda: pa.Array.from_buffers(pa.string(), n, [None, offsets(lengths), pa.py_buffer(unpack_bases(blocks, lengths))]),
    }
    return pa.RecordBatch.from_arrays([make[c]() for c in columns], names=columns)


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.columns = [f.name for f in schema.fields]
        if unknown := set(self.columns) - {"path", "offset", "header", "blocks", "seq"}:
            raise ValueError(f"packed reads have no {', '.join(sorted(unknown))}")
        self.path, self.split_bytes = options["path"], int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        return ranges(listed(self.path), self.split_bytes) or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return records(partition, self.columns) if isinstance(partition, Range) else iter(())


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        names = {f.name for f in schema.fields}
        if not ({"header", "blocks"} <= names or "seq" in names):
            raise ValueError(f"packed reads are written from header and blocks, or from seq, not from {', '.join(sorted(names))}")
        self.path, self.packed, self.overwrite = options["path"].rstrip("/"), "header" in names, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, inside = file_system(self.path)
        system.create_dir(inside, recursive=True)
        name, size = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin", 0
        with system.open_output_stream(f"{inside}/_{name}") as f:
            for batch in iterator:
                for a, b in pieces(self._bases(batch)):
                    piece = batch.slice(a, b - a)
                    words = self._packed(piece) if self.packed else self._from_seq(piece)
                    f.write(memoryview(words))
                    size += words.nbytes
        return Written(name, size)

    def _bases(self, batch: pa.RecordBatch) -> np.ndarray:
        """Of each row, or its bytes, which are no fewer."""
        sizes = pc.multiply(batch.column("blocks").value_lengths(), BASES_PER_BLOCK) if self.packed else pc.binary_length(batch.column("seq"))
        return sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)

    def _packed(self, batch: pa.RecordBatch) -> np.ndarray:
        kept = batch.filter(batch.column("header").is_valid())
        blocks = kept.column("blocks")
        sizes = np.array([0 if n is None else n for n in blocks.value_lengths().to_pylist()], np.int64)
        return with_headers(kept.column("header").to_numpy(zero_copy_only=False).astype(np.uint32), blocks.flatten().to_numpy(zero_copy_only=False).astype(np.uint32), sizes)

    def _from_seq(self, batch: pa.RecordBatch) -> np.ndarray:
        seq = batch.column("seq").drop_null().cast(pa.large_string())
        # Any other character is one N, however many bytes it has.
        text = "".join(seq.to_pylist()) if len(seq) else ""
        data = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
        return pack_words(data, pc.utf8_length(seq).to_numpy(zero_copy_only=False).astype(np.int64))

    def commit(self, messages: list[Written | None]) -> None:
        system, inside = file_system(self.path)
        system.create_dir(inside, recursive=True)
        old = [file_system(p)[1] for p, _, _ in listed(self.path)] if self.overwrite else []
        for m in (m for m in messages if m):
            if m.size:
                system.move(f"{inside}/_{m.name}", f"{inside}/{m.name}")
            else:
                system.delete_file(f"{inside}/_{m.name}")
        for path in old:
            system.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        system, inside = file_system(self.path)
        for m in (m for m in messages if m):
            system.delete_file(f"{inside}/_{m.name}")


class PackedReads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed_reads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackedReads)


def write_packed(reads: DataFrame, path: str, *, mode: str = "append") -> None:
    """Packed reads (header and blocks, or seq) as binary files; the columns besides are not stored."""
    register(reads.sparkSession)
    columns = ["header", "blocks"] if "header" in reads.columns else ["seq"]
    reads.select(*columns).write.format("packed_reads").mode(mode).save(path)


def read_packed(spark: SparkSession, path: str, columns: str = SCHEMA, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format("packed_reads").schema(columns).option("split_bytes", split_bytes).load(path)
