"""FASTQ as a data source: `spark.read.format("fastq").load(path)` after register(spark).

A record is four lines: `@` and its name, bases, `+`, and as many qualities as bases. Files are cut into ranges of bytes, one partition each. A task
finds the first record that starts in its range by the shape of the lines from there on: one of four phases has `@`, `+` and equal
lengths wherever they belong. A quality line may start with `@` and lines may be empty, so that more than one phase fits, or none in a
damaged file; then the lines before the range are counted. No line moves between tasks, and no pass over the file goes first.

Columns, of which a schema given to the reader chooses: path; offset, the byte of the file at which the record starts; name; seq; quality; and
read_id, the record's number in its file, which needs lines_before.

Options: path, a file or a folder; split_bytes; mode. In mode `strict`, the default, a record of another shape is an error that
names the file and the byte. Mode `lines` takes the second of each four lines whatever they hold, the last record cut short or not; it finds its first
record by counting alone, or by the option `lines_before`: for each file, the lines that end before each of its ranges, as read_fastq() counts them.

Files in .gz are one partition each, as they can't be cut. Lines end in \\n; a \\r before it belongs to the line. Bytes that are no UTF-8 are replaced.
An empty file has no records. Streams (`readStream`) take the files that are new since the last batch; the option `log` names a folder where the
source notes which files belong to which batch. Files must appear whole, by a rename.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .files import file_system, listed

SCHEMA = "path string, offset long, name string, seq string, quality string"
SPLIT_BYTES = 64 << 20
#: Bytes that a task holds at once, and the first look at a range.
BLOCK, PROBE = 4 << 20, 64 << 10
NEWLINE = ord("\n")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int
    size: int
    lines_before: int | None = None


def ranges(files: list[tuple[str, int, int]], split_bytes: int) -> list[Range]:
    """Ranges of all files. A compressed file is one, whatever its size."""
    if split_bytes < 1:
        raise ValueError(f"split_bytes is 1 or more, not {split_bytes}")
    out = []
    for path, size, _ in files:
        step = max(size, 1) if path.endswith(".gz") else split_bytes
        out += [Range(path, a, min(a + step, size), size) for a in range(0, size, step)]
    return out


def _open(part: Range) -> pa.NativeFile:
    system, inside = file_system(part.path)
    if part.path.endswith(".gz"):
        return system.open_input_stream(inside, compression="gzip")
    f = system.open_input_file(inside)
    f.seek(part.start)
    return f


def newlines(part: Range) -> int:
    """The lines that end in a range; of a compressed file none, as no range follows."""
    if part.path.endswith(".gz"):
        return 0
    n, left = 0, part.stop - part.start
    with _open(part) as f:
        while left and (block := f.read(min(BLOCK, left))):
            n += int(np.count_nonzero(np.frombuffer(block, np.uint8) == NEWLINE))
            left -= len(block)
    return n


def _line_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the lines that end within data, and the bytes after their newlines."""
    stops = np.flatnonzero(data == NEWLINE) + 1
    return np.concatenate([[0], stops[:-1]]).astype(np.int64) if len(stops) else stops, stops


def _fits(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, phase: int) -> np.ndarray:
    """Whether each whole record from the line `phase` on has the shape of one."""
    n = (len(starts) - phase) // 4
    s, e = starts[phase : phase + 4 * n].reshape(n, 4), stops[phase : phase + 4 * n].reshape(n, 4)
    # A line has a newline at least, so its first byte is always there.
    return (data[s[:, 0]] == ord("@")) & (data[s[:, 2]] == ord("+")) & (e[:, 1] - s[:, 1] == e[:, 3] - s[:, 3])


def _phase(data: np.ndarray, ended: bool) -> int | None:
    """The line, 0 to 3, at which the first record starts; None if more than one or none can be, or too few lines are there."""
    starts, stops = _line_bounds(data)
    can = []
    for phase in range(4):
        fits = _fits(data, starts, stops, phase)
        # The file's end is a record's end, too.
        if fits.all() and (not ended or (len(starts) - phase) % 4 == 0):
            can.append(phase)
    return can[0] if len(can) == 1 and (ended or len(starts) >= 11) else None


def _first_record(part: Range, strict: bool) -> tuple[int, int | None] | None:
    """The byte at which the first record of a range starts, and its number in the file if lines_before tells; None if there is no record."""
    if part.start == 0 or part.path.endswith(".gz"):
        return 0, 0
    system, inside = file_system(part.path)
    with system.open_input_file(inside) as f:
        # Lines start after a newline; the one before the range counts.
        f.seek(part.start - 1)
        at, block, look = None, b"", PROBE
        while at is None:
            more = f.read(look)
            if not more:
                return None  # no line starts here
            cut = (block + more).find(b"\n")
            block += more
            if cut >= 0:
                at, block = part.start + cut, block[cut + 1 :]
        if at >= part.size or at >= part.stop:
            return None
        phase, ended = None, False
        while strict and part.lines_before is None and phase is None and not ended and look <= 64 * PROBE:
            more = f.read(look)
            ended, look, block = not more, 2 * look, block + more
            text = block + b"\n" * (ended and not block.endswith(b"\n"))
            phase = _phase(np.frombuffer(text, np.uint8), ended)
    number = None
    if phase is None:
        if part.lines_before is not None:
            # Lines that end before the range, and the one that ends in it before `at`, unless the range starts a line.
            before = part.lines_before + (at > part.start)
        else:
            before = newlines(Range(part.path, 0, at, part.size))
        phase, number = -before % 4, (before + 3) // 4
    lines, offset = 0, at
    while lines < phase:
        with system.open_input_file(inside) as f:
            f.seek(offset)
            while lines < phase:
                block = f.read(PROBE)
                if not block:
                    return None
                ends = np.flatnonzero(np.frombuffer(block, np.uint8) == NEWLINE)
                if len(ends) >= phase - lines:
                    offset, lines = offset + int(ends[phase - lines - 1]) + 1, phase
                else:
                    offset, lines = offset + len(block), lines + len(ends)
    return (offset, number) if offset < min(part.stop, part.size) else None


def _text(values: pa.Array) -> pa.Array:
    try:
        return values.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([v.decode("utf-8", "replace") for v in values.to_pylist()], pa.string())


def _blocks(part: Range, first: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) from the first record on: whole records, at their start, until one starts beyond the range."""
    stop = part.stop if not part.path.endswith(".gz") else 1 << 62
    with _open(Range(part.path, first, part.stop, part.size)) as f:
        offset, left = first, b""
        while offset < stop:
            more = f.read(max(BLOCK, len(left)))
            data, ended = left + more, not more
            if ended and not data:
                return
            if ended and not data.endswith(b"\n"):
                data += b"\n"
            lines = np.frombuffer(data, np.uint8)
            ends = np.flatnonzero(lines == NEWLINE)
            if ended:
                yield offset, lines
                return
            if whole := len(ends) // 4 * 4:
                size = int(ends[whole - 1]) + 1
                yield offset, lines[:size]
                offset, left = offset + size, data[size:]
            else:
                left = data


def records(part: Range, columns: list[str], strict: bool) -> Iterator[pa.RecordBatch]:
    """The records that start in a range."""
    found = _first_record(part, strict)
    if found is None:
        return
    first, number = found
    if number is None and "read_id" in columns:
        raise ValueError("read_id needs the option lines_before")
    stop = part.stop if not part.path.endswith(".gz") else 1 << 62
    for offset, data in _blocks(part, first):
        starts, stops = _line_bounds(data)
        if strict:
            fits = _fits(data, starts, stops, 0)
            wrong = np.flatnonzero(~fits)
            bad = int(starts[4 * wrong[0]]) if len(wrong) else int(starts[len(fits) * 4]) if len(starts) % 4 else None
            if bad is not None and offset + bad < stop:
                raise ValueError(f"{part.path}: no FASTQ record at byte {offset + bad}")
        lines = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, stops[-1:]).astype(np.int64)), pa.py_buffer(data)])
        # A record counts if its bases are there and it starts within the range.
        n = min(int(np.count_nonzero(offset + starts[::4] < stop)), (len(starts) + 2) // 4)
        at = 4 * np.arange(n)

        def column(line: int, skip: int = 0) -> pa.Array:
            there = pa.array(np.minimum(at + line, len(starts) - 1), mask=at + line >= len(starts))  # noqa: B023
            return _text(pc.binary_slice(lines.take(there).cast(pa.binary()), skip, -1))  # noqa: B023

        make = {
            "path": lambda: pa.array(np.full(n, part.path, object), pa.string()),  # noqa: B023
            "offset": lambda: pa.array(offset + starts[at]),  # noqa: B023
            "read_id": lambda: pa.array(number + np.arange(n)),  # noqa: B023
            "name": lambda: column(0, 1),  # noqa: B023
            "seq": lambda: column(1),  # noqa: B023
            "quality": lambda: column(3),  # noqa: B023
        }
        if n:
            yield pa.RecordBatch.from_arrays([make[c]() for c in columns], names=columns)
        number = None if number is None else number + n


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.columns = [f.name for f in schema.fields]
        if unknown := set(self.columns) - {"path", "offset", "read_id", "name", "seq", "quality"}:
            raise ValueError(f"FASTQ records have no {', '.join(sorted(unknown))}")
        mode = options.get("mode", "strict")
        if mode not in ("strict", "lines"):
            raise ValueError(f"mode is 'strict' or 'lines', not {mode!r}")
        self.strict, self.path, self.split_bytes = mode == "strict", options["path"], int(options.get("split_bytes", SPLIT_BYTES))
        self.lines_before = json.loads(options.get("lines_before", "{}"))

    def partitions(self) -> list[InputPartition]:
        parts = ranges(listed(self.path), self.split_bytes)
        for p in parts:
            before = self.lines_before.get(p.path, [])
            p.lines_before = before[p.start // self.split_bytes] if p.start // self.split_bytes < len(before) else None
        return parts or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return records(partition, self.columns, self.strict) if isinstance(partition, Range) else iter(())


class StreamReader(DataSourceStreamReader):
    """Batches of new files. The log has one entry for each look that found some, written before its offset is given out."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.batch, self.log = Reader(options, schema), options["log"].rstrip("/")

    def _entries(self) -> list[list]:
        system, inside = file_system(self.log)
        system.create_dir(inside, recursive=True)
        out = []
        for path, _, _ in listed(self.log):
            with system.open_input_stream(file_system(path)[1]) as f:
                out.append(json.loads(f.read()))
        return out

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        entries = self._entries()
        known = {f[0] for e in entries for f in e}
        if new := [f for f in listed(self.batch.path) if f[0] not in known]:
            system, inside = file_system(self.log)
            fresh = f"{inside}/_{uuid.uuid4().hex}"
            with system.open_output_stream(fresh) as f:
                f.write(json.dumps(new).encode())
            system.move(fresh, f"{inside}/{len(entries):012d}.json")
            entries.append(new)
        return {"entries": len(entries)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files = [tuple(f) for e in self._entries()[start["entries"] : end["entries"]] for f in e]
        return ranges(files, self.batch.split_bytes) or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.batch.read(partition)


class Fastq(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options, schema)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options, schema)


class NewlineReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split_bytes = options["path"], int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        return ranges(listed(self.path), self.split_bytes) or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if isinstance(partition, Range):
            yield partition.path, partition.start, newlines(partition)


class Newlines(DataSource):
    """How many lines end in each range of bytes; what read_fastq() numbers reads by."""

    @classmethod
    def name(cls) -> str:
        return "newlines"

    def schema(self) -> str:
        return "path string, start long, n long"

    def reader(self, schema: StructType) -> NewlineReader:
        return NewlineReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Fastq)
    spark.dataSource.register(Newlines)
