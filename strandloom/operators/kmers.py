"""Extracting and counting k-mers.

A window counts if it lies in one read and has bases only. Two strategies give the same rows. `native` is made of
expressions: reads are cut into runs of bases, long runs into overlapping pieces, and each window is a row of
text. `arrow` turns the bytes of a batch of reads into integers with NumPy, all reads at once, and counts within the task: small k in a table
of all k-mers, larger k in sorted runs of (k-mer, count) which are merged by levels until a bound is reached. So a task gives each k-mer once, or
once for each bound where k-mers hardly repeat. It is the one to take for long reads and large k.

What leaves a task goes by buckets: a k-mer is multiplied within its 2 * k bits by an odd number, which can be undone and spreads what text crowds
together; the high bits of the product are the bucket. A row of the shuffle is a bucket of a sorted run, with differences and counts in as few bytes as
the run's largest needs. Each partition sorts these rows, not k-mers, and adds up bucket after bucket, so what it holds is a bucket and not the partition.

counts_of() takes a list of k-mers and counts these alone: windows are compared with the sorted list in the task, and only hits are counted and shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import canonical as canonical_of
from ..functions.codec import check_k, encode_kmer

#: Windows of the pieces that runs are cut into, in turn: a substring is found by walking from the start of its text.
PIECES = (16_384, 128)
#: Up to this k the strategy `native` counts both strands apart before it adds them up: at most 4**k rows are shuffled twice then.
SMALL_K = 12
#: Bases that the kernel takes at once; its memory is some 60 bytes for each.
CHUNK = 1 << 17
#: Tables of all k-mers are held up to this size; beyond it, so many windows make a sorted run, and so many k-mers of runs are held at most.
DENSE, RUN, HELD = 1 << 22, 1 << 20, 1 << 22
#: Bits of buckets at least, and buckets for each shuffle partition at least; so many (k-mer, count) of whole buckets are added up at once.
BUCKET_BITS, BUCKETS, ADDED = 12, 16, 1 << 20
#: Odd, and of mixed bits, as the golden ratio has them.
SPREAD = 0x9E3779B97F4A7C15
#: Lists of k-mers that tasks hold, of eight bytes each.
MOST_ASKED = 1_000_000

CODES = np.full(256, 4, np.uint8)
CODES[[ord(c) for c in "ACGT"]] = range(4)
LETTERS = np.frombuffer(b"ACGT", np.uint8)


def windows(reads: DataFrame, k: int, *, seq: str = "seq") -> DataFrame:
    """reads' other columns, and kmer: one row for each window of k bases, as it stands in the read."""
    check_k(k)
    rest = [c for c in reads.columns if c != seq]
    runs = reads.select(*rest, F.explode(F.regexp_extract_all(F.col(seq), F.lit("[ACGT]+"), F.lit(0))).alias("_run")).where(F.length("_run") >= k)
    pieces = runs
    for size in PIECES:
        starts = F.sequence(F.lit(1), F.length("_run") - k + 1, F.lit(size))
        pieces = pieces.select(*rest, F.explode(F.transform(starts, lambda i: F.substring(F.col("_run"), i, F.lit(size + k - 1)))).alias("_run"))  # noqa: B023
    each = F.transform(F.sequence(F.lit(1), F.length("_run") - k + 1), lambda i: F.substring(F.col("_run"), i, F.lit(k)))
    return pieces.select(*rest, F.explode(each).alias("kmer"))


def _kernel(codes: np.ndarray, k: int, canonical: bool, cut: np.ndarray | None = None) -> np.ndarray:
    """Encoded k-mers of all windows without a code of 4, by doubling the width of what is already joined. No window goes over one of the places in cut."""
    n = len(codes) - k + 1
    if n < 1:
        return np.zeros(0, np.int64)
    bad = np.concatenate([[0], np.cumsum(codes > 3)])
    good = bad[k:] == bad[:-k]
    if cut is not None and len(cut):
        over = np.zeros(n + 1, np.int64)
        np.add.at(over, np.clip(cut - k + 1, 0, n), 1)
        np.add.at(over, np.minimum(cut, n), -1)
        good &= np.cumsum(over)[:n] == 0
    # One base is joined to 2, 4, 8, ... and k is put together from these by its binary digits.
    f, width = codes.astype(np.int64) & 3, 1
    b = 3 - f
    forward, backward, done = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64), 0
    while True:
        if k & width:
            m = len(codes) - done - width + 1
            forward = forward[:m] << 2 * width | f[done : done + m]
            if canonical:
                backward = b[done : done + m] << 2 * done | backward[:m]
            done += width
        if done == k:
            break
        m = len(f) - width
        f, b, width = f[:m] << 2 * width | f[width : width + m], b[width : width + m] << 2 * width | b[:m], 2 * width
    return (np.minimum(forward, backward) if canonical else forward)[good]


def _windows_of(column: pa.Array, k: int, canonical: bool):
    """Encoded k-mers of a batch of reads, some CHUNK at a time."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for a in range(int(ends[0]), int(ends[-1]), CHUNK):
        b = min(a + CHUNK + k - 1, int(ends[-1]))
        within = ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, b)]
        yield _kernel(CODES[data[a:b]], k, canonical, within - a)


def _added(runs: list) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run of all."""
    keys, n = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(keys, kind="stable")  # sorted runs are merged in one go
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


class Runs:
    """Counts of a task's k-mers. add() and end() give the arrays (keys, counts) that are to leave the task."""

    def __init__(self, k: int) -> None:
        self.size = 4**k if 4**k <= DENSE else 0
        self.table = np.zeros(self.size, np.int64)
        self.waiting, self.n_waiting, self.levels, self.repeats = [], 0, [], True

    def add(self, found: np.ndarray):
        self.waiting.append(found)
        self.n_waiting += len(found)
        if self.n_waiting >= (max(self.size, CHUNK) if self.size else RUN):
            yield from self._settle()

    def _settle(self):
        keys, self.waiting, self.n_waiting = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.int64), [], 0
        if self.size:
            self.table += np.bincount(keys, minlength=self.size)
            return
        run = np.unique(keys, return_counts=True)
        if not self.repeats:
            yield run
            return
        self.levels.append(run)
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self._merged(a, b))
        if (held := sum(len(keys) for keys, _ in self.levels)) > HELD:
            # Where k-mers hardly repeat within so many, merging runs saves nothing: the task goes on without.
            self.repeats = held < 0.9 * sum(int(n.sum()) for _, n in self.levels)
            yield from self.levels
            self.levels = []

    @staticmethod
    def _merged(a, b):
        return _added([a, b])

    def end(self):
        yield from self._settle()
        if self.size:
            keys = np.flatnonzero(self.table)
            yield keys, self.table[keys]
        while len(self.levels) > 1:
            self.levels.append(self._merged(self.levels.pop(), self.levels.pop()))
        yield from self.levels


class Asked:
    """Counts of the k-mers of a sorted list alone."""

    def __init__(self, asked: np.ndarray) -> None:
        self.asked, self.n = asked, np.zeros(len(asked), np.int64)

    def add(self, found: np.ndarray):
        if len(self.asked):
            at = np.minimum(np.searchsorted(self.asked, found), len(self.asked) - 1)
            self.n += np.bincount(at[self.asked[at] == found], minlength=len(self.asked))
        return ()

    def end(self):
        hit = np.flatnonzero(self.n)
        yield self.asked[hit], self.n[hit]


def _times(keys: np.ndarray, factor: int, k: int) -> np.ndarray:
    """Products within 2 * k bits. Those with SPREAD are undone by those with its inverse."""
    return (keys.astype(np.uint64) * np.uint64(factor % 4**k) & np.uint64(4**k - 1)).astype(np.int64)


def spread(keys: np.ndarray, k: int) -> np.ndarray:
    return _times(keys, SPREAD, k)


def gathered(keys: np.ndarray, k: int) -> np.ndarray:
    return _times(keys, pow(SPREAD, -1, 4**k), k)


def _narrow(values: np.ndarray) -> tuple[np.ndarray, int]:
    """The low bytes of values, none below 0, and how many the largest needs."""
    width = max(1, -(-int(values.max()).bit_length() // 8))
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]).ravel(), width


def _wide(data: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = data.reshape(-1, width)
    return out.ravel().view("<i8")


PACKED = "bucket int, n int, keys binary, counts binary"


def packed(keys: np.ndarray, counts: np.ndarray, shift: int) -> pa.RecordBatch:
    """The buckets of a sorted run, which is not empty, as rows of PACKED: bits above shift, and differences of the rest."""
    buckets = keys >> shift
    starts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
    steps = np.diff(keys, prepend=0)
    steps[starts] = keys[starts] - (buckets[starts] << shift)
    ends = np.append(starts, len(keys))

    def binary(values: np.ndarray) -> pa.Array:
        data, width = _narrow(values)
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(data)])

    columns = [pa.array(buckets[starts].astype(np.int32)), pa.array(np.diff(ends).astype(np.int32)), binary(steps), binary(counts)]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "n", "keys", "counts"])


def unpacked(rows: pa.RecordBatch, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of rows of PACKED."""
    bucket, n = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bucket", "n"))
    starts = np.cumsum(n) - n

    def values(column: pa.Array) -> np.ndarray:
        sizes, out = pc.binary_length(column).to_numpy(zero_copy_only=False), np.empty(int(n.sum()), np.int64)
        widths = sizes // n
        for width in np.unique(widths).tolist():
            of_width = column.filter(pa.array(widths == width))
            ends = np.frombuffer(of_width.buffers()[1], np.int32, len(of_width) + 1, 4 * of_width.offset)
            found = _wide(np.frombuffer(of_width.buffers()[2], np.uint8)[ends[0] : ends[-1]], width)
            if len(of_width) == len(column):
                return found
            out[np.repeat(widths == width, n)] = found
        return out

    keys, counts = values(rows.column("keys")), values(rows.column("counts"))
    total = np.cumsum(keys)
    before = total[starts] - keys[starts]
    return total + np.repeat((bucket << shift) - before, n), counts


def _letters(codes: np.ndarray, k: int) -> pa.Array:
    letters = np.empty((len(codes), k), np.uint8)
    for j in range(k):
        letters[:, j] = LETTERS[codes >> 2 * (k - 1 - j) & 3]
    ends = np.arange(len(codes) + 1, dtype=np.int32) * np.int32(k)
    return pa.Array.from_buffers(pa.string(), len(codes), [None, pa.py_buffer(ends), pa.py_buffer(letters)])


def spelt(enc: Column, k: int) -> Column:
    """The k-mer as text, as decode_kmer() gives it, by a task's arrays: a fifth of the time for many rows that come from tasks in Python anyway."""

    @F.arrow_udf("string")
    def text(values: pa.Array) -> pa.Array:
        # Nulls, which have no letters here, are put back at the end.
        out = _letters(values.fill_null(0).to_numpy(zero_copy_only=False), k)
        return pc.if_else(values.is_valid(), out, pa.scalar(None, pa.string())) if values.null_count else out

    return text(enc)


def _bucket_bits(spark, k: int) -> int:
    """More shuffle partitions, which larger inputs are given, have more buckets, so that one stays a small part of a partition."""
    return min(2 * k, 30, max(BUCKET_BITS, (BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))


def _counted(reads: DataFrame, k: int, canonical: bool, seq: str, totals, enc: bool) -> DataFrame:
    """(kmer, cnt), and with enc the k-mer as an integer. totals makes what a task counts in; it is given spread k-mers and gives them back sorted."""
    shift = 2 * k - _bucket_bits(reads.sparkSession, k)

    def runs_of(parts):
        runs = totals()
        for part in parts:
            for found in _windows_of(part.column(0), k, canonical):
                yield from runs.add(spread(found, k))
        yield from runs.end()

    def in_rows(parts):
        for keys, n in runs_of(parts):
            for a in range(0, len(keys), 1 << 16):
                both = [pa.array(x) for x in (gathered(keys[a : a + (1 << 16)], k), n[a : a + (1 << 16)].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(both, names=["enc", "cnt"])

    if reads.isStreaming:
        # A stream's state is kept by k-mer.
        counts = reads.select(seq).mapInArrow(in_rows, "enc long, cnt long").groupBy("enc").agg(F.sum("cnt").alias("cnt"))
        return counts.select(spelt(F.col("enc"), k).alias("kmer"), "cnt", *["enc"] * enc)

    def in_buckets(parts):
        for keys, n in runs_of(parts):
            for a in range(0, len(keys), ADDED):
                yield packed(keys[a : a + ADDED], n[a : a + ADDED], shift)

    def add_up(parts):
        def rows(held):
            keys, n = _added(held)
            for a in range(0, len(keys), 1 << 16):
                codes = keys[a : a + (1 << 16)]
                columns = [_letters(codes, k), pa.array(n[a : a + (1 << 16)]), *[pa.array(codes)] * enc]
                yield pa.RecordBatch.from_arrays(columns, names=["kmer", "cnt", "enc"][: len(columns)])

        # Rows come by bucket: what is held is added up where a bucket ends. It leaves in the k-mers' order, which files compress better.
        held, size, last = [], 0, None
        for part in parts:
            buckets = part.column("bucket").to_numpy(zero_copy_only=False)
            ends = np.append(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1, len(buckets))
            sizes = np.cumsum(part.column("n").to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < len(buckets):
                if held and size >= ADDED and buckets[a] != last:
                    yield from rows(held)
                    held, size = [], 0
                # As many whole buckets as are added up at once, or the next one alone.
                done = int(sizes[a - 1]) if a else 0
                fit = ends[(ends > a) & (sizes[ends - 1] - done <= ADDED - size)]
                b = int(fit[-1] if len(fit) else ends[np.searchsorted(ends, a, "right")])
                keys, n = unpacked(part.slice(a, b - a), shift)
                held.append((gathered(keys, k), n))
                size, last, a = size + int(sizes[b - 1]) - done, buckets[b - 1], b
        if held:
            yield from rows(held)

    by_bucket = reads.select(seq).mapInArrow(in_buckets, PACKED).repartition("bucket").sortWithinPartitions("bucket")
    return by_bucket.mapInArrow(add_up, "kmer string, cnt long" + ", enc long" * enc)


def counts_of(reads: DataFrame, asked: DataFrame, k: int, *, canonical: bool = True, seq: str = "seq") -> DataFrame:
    """(kmer, enc, cnt) of those k-mers of asked (kmer) that reads have. canonical: the reads' k-mers are; asked is taken as it is.

    Beyond MOST_ASKED different k-mers, all of reads are counted and joined with asked.
    """
    check_k(k)
    keys = asked.select(encode_kmer(F.col("kmer")).alias("enc")).distinct()
    known = [r[0] for r in keys.limit(MOST_ASKED + 1).collect()]
    if len(known) > MOST_ASKED:
        return count(reads, k, canonical=canonical, seq=seq, enc=True).join(keys, "enc", "left_semi").select("kmer", "enc", "cnt")
    known = np.array(known, np.int64)
    values = reads.sparkSession.sparkContext.broadcast(np.sort(spread(known[(known >= 0) & (known < 4**k)], k)))
    return _counted(reads, k, canonical, seq, lambda: Asked(values.value), True).select("kmer", "enc", "cnt")


def count(reads: DataFrame, k: int, *, canonical: bool = True, strategy: str = "arrow", count_mode: str = "long", seq: str = "seq", enc: bool = False) -> DataFrame:
    """(kmer, cnt), and with enc the k-mer as an integer. count_mode 'u16' gives counts modulo 65,536."""
    check_k(k)
    if count_mode not in ("long", "u16"):
        raise ValueError(f"count_mode is 'long' or 'u16', not {count_mode!r}")
    if strategy == "arrow":
        out = _counted(reads, k, canonical, seq, lambda: Runs(k), enc)
    elif strategy == "native":
        each = windows(reads.select(seq), k, seq=seq)
        # Where k-mers repeat, they are counted as they stand and only the different ones are turned.
        first = canonical and k > SMALL_K
        out = each.groupBy((canonical_of(F.col("kmer")) if first else F.col("kmer")).alias("kmer")).agg(F.count("*").alias("cnt"))
        if canonical and not first:
            out = out.groupBy(canonical_of(F.col("kmer")).alias("kmer")).agg(F.sum("cnt").alias("cnt"))
        out = encoded(out) if enc else out
    else:
        raise ValueError(f"strategy is 'arrow' or 'native', not {strategy!r}")
    return out.withColumn("cnt", wrapped(F.col("cnt"))) if count_mode == "u16" else out


def wrapped(cnt: Column) -> Column:
    return cnt % 65536


def encoded(counts: DataFrame) -> DataFrame:
    return counts.withColumn("enc", encode_kmer(F.col("kmer")))
