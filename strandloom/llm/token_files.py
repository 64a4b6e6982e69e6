"""Token ids of documents in binary files: each document compressed by itself under a shared dictionary, with an index of offsets.

encode() gives the ids of the tokenizers library. write() puts documents into ascending order of doc_id (a range partitioning); the writer of the data
source `token_files` encodes them and writes them. read() reads them back, all or by doc_id.

A folder holds
- dictionary-<SHA-256>.zdict: the zstandard dictionary, trained on serialized ids of a bounded sample of short documents;
- shards, *.tok: 8 bytes of magic; one zstandard frame for each document, of its ids as little-endian unsigned 32-bit integers; the index, which is for
  all documents their ids (signed 64 bits), whether they are null (8 bits), the ends of their frames and their numbers of tokens (unsigned 64 bits
  each); last the dictionary's SHA-256, where the index starts, how many documents there are, the index's CRC-32 and the magic again;
- _manifest.json: the shards in order with their documents, tokens before them, first and last doc_id. It is moved into place when all tasks are done.

A shard is written under a name of its own by each attempt of a task, and only those that the manifest names are read, so an attempt that was lost
or ran twice leaves a file that nobody reads. A short document is read by its range of bytes alone: manifest, index, frame.

The library's cache of words is small, so texts are cut at single blanks between printable ASCII characters or between words without white space at their
ends, where its pattern always ends a piece, and words where their letters end; what was met before is not encoded again.

Null and empty texts are the end id alone. Null doc_ids come first. Rows of one doc_id are in the order of a hash of their texts, then of the input; all stay,
with their own place. Extra columns are not stored, whatever their names. No documents: a folder with a manifest and no shard, which reads as no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..sources.files import file_system
from ._common import small_batches

MAGIC = b"STOKENS1"
#: SHA-256 of the dictionary, start of the index, documents, CRC-32 of the index.
FOOTER = struct.Struct("<32sQQI")
LEVEL = 3
SHARD_BYTES = 128 << 20
#: The dictionary's sample: about this many documents, each of this many bytes of text at most, picked by a hash of their rows.
SAMPLE_DOCUMENTS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 8192, 64 << 10
#: Bytes of text that one task sorts and encodes (some five seconds), and bytes of ids in a batch that is read.
TASK_BYTES, BATCH_BYTES = 16 << 20, 4 << 20
MOST_TOKENIZER_BYTES = 64 << 20
#: Different words, and as many of what else stands in texts, that a worker keeps, of some 150 bytes each; none of more characters.
MOST_PIECES, LONGEST_PIECE = 600_000, 40
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"

CUT = re.compile("(?<=[!-~])(?= [!-~])")


def as_bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


LETTER = np.zeros(256, bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of a large_string array and where each value ends, from where the first starts."""
    ends = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, 8 * values.offset)
    return np.frombuffer(values.buffers()[2] or b"", np.uint8), ends


def _strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Values of given places in data."""
    ends = np.append(0, np.cumsum(sizes))
    chosen = data[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)]
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(chosen)])


class Pieces:
    """The ids of texts as bytes, with a bounded memory of the words and of what follows them."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.words, self.others = tokenizer, {}, {}
        # The names of added tokens are looked for before anything is cut, so they must stay whole.
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def _of(self, known: dict[str, bytes], pieces: list[str], before: str) -> list[bytes]:
        """The ids of different pieces, from memory or by the library."""
        found = list(map(known.get, pieces))
        new = [p for p, ids in zip(pieces, found, strict=True) if ids is None]
        if new:
            learnt = [as_bytes(e.ids) for e in self.tokenizer.encode_batch_fast([before + p for p in new] if before else new, add_special_tokens=False)]
            if len(known) + len(new) > MOST_PIECES and 2 * len(new) > len(pieces):
                known.clear()  # other texts than those that filled it
            short = ((p, ids) for p, ids in zip(new, learnt, strict=True) if len(p) <= LONGEST_PIECE)
            known.update(itertools.islice(short, max(0, MOST_PIECES - len(known))))
            rest = iter(learnt)
            found = [next(rest) if ids is None else ids for ids in found]
        return found

    def _halves(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
        """Pieces in two: the letters that they start with if another printable ASCII character or a new line follows, and the rest; each as different values and a number for each piece."""
        data, ends = _bytes_of(pieces)
        starts, sizes = ends[:-1], np.diff(ends)
        # The first byte that is no letter, from each place on.
        stops = np.append(np.flatnonzero(~LETTER[data]), len(data))
        letters = stops[np.searchsorted(stops, starts)] - starts
        after = data[np.minimum(starts + letters, max(len(data) - 1, 0))] if len(data) else np.zeros(len(starts), np.uint8)
        cut = (letters > 0) & (letters < sizes) & (after < 127) & ((after > ord(" ")) | (after == ord("\n")))
        for name in self.added:
            cut &= ~pc.match_substring(pieces, name).to_numpy(zero_copy_only=False)
        size = np.where(cut, letters, sizes)
        words, rest = (_strings(data, at, n).dictionary_encode() for at, n in ((starts, size), (starts + size, sizes - size)))
        return words.dictionary, words.indices.to_numpy(), rest.dictionary, rest.indices.to_numpy()

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return []
        # A word after a blank is a piece with the blank before it, if it doesn't start or end with white space; other texts are cut with more care.
        split = pc.split_pattern(texts, " ")
        counts = split.value_lengths().to_numpy(zero_copy_only=False)
        stops = np.cumsum(counts, dtype=np.int64)
        once = split.flatten().dictionary_encode()
        different, which = once.dictionary, once.indices.to_numpy()
        odd = self._odd(different)[which]
        plain = np.add.reduceat(odd, stops - counts) == 0
        later = np.repeat(plain, counts)
        later[stops - counts] = False
        asked = np.zeros(len(different), bool)
        asked[which[later]] = True
        words, word_of, rest, rest_of = self._halves(different.filter(pa.array(asked)))
        known = pa.array(self._of(self.words, words.to_pylist(), " ") + self._of(self.others, rest.to_pylist(), ""), pa.large_binary())
        # A word and its rest stand side by side, so that taking them in turn joins them.
        at = (np.cumsum(asked) - 1)[which[later]]
        ids = known.take(pa.array(np.stack([word_of[at], len(words) + rest_of[at]], axis=1).ravel()))
        ends, data = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)[::2], memoryview(ids.buffers()[2] or b"")
        upto = ends[np.append(0, np.cumsum(np.where(plain, counts - 1, 0)))].tolist()
        heads = different.take(pa.array(which[stops - counts])).to_pylist()
        firsts = list({h for h, p in zip(heads, plain, strict=True) if p})
        head = dict(zip(firsts, self._of(self.others, firsts, ""), strict=True))
        return [head[heads[i]] + data[upto[i] : upto[i + 1]] if plain[i] else self._cut(texts[i].as_py()) for i in range(len(texts))]

    def _odd(self, pieces: pa.Array) -> np.ndarray:
        """Empty pieces, and those with white space at an end. Most have ASCII characters at both, which are looked at together."""
        data, ends = _bytes_of(pieces)
        starts, empty = ends[:-1], np.diff(ends) == 0
        first, last = (data[np.clip(at, 0, max(len(data) - 1, 0))] if len(data) else np.zeros(len(empty), np.uint8) for at in (starts, ends[1:] - 1))
        plain = (first > ord(" ")) & (first < 127) & (last > ord(" ")) & (last < 127) & ~empty
        odd = ~plain
        unsure = np.flatnonzero(odd)
        odd[unsure] = [not p or p[0].isspace() or p[-1].isspace() for p in pieces.take(pa.array(unsure)).to_pylist()]
        return odd

    def _cut(self, text: str) -> bytes:
        pieces = CUT.split(text)
        once = list(dict.fromkeys(pieces))
        return b"".join(map(dict(zip(once, self._of(self.others, once, ""), strict=True)).__getitem__, pieces))


@functools.lru_cache(2)
def _pieces(digest: str, load) -> Pieces:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Pieces(Tokenizer.from_str(load.value.decode()))


class _Load:
    """A broadcast that is the same key as any other, as the digest beside it tells them apart."""

    def __init__(self, shared) -> None:
        self.shared = shared

    @property
    def value(self) -> bytes:
        return self.shared.value

    def __eq__(self, other) -> bool:
        return isinstance(other, _Load)

    def __hash__(self) -> int:
        return 0


@dataclass
class _Plain:
    value: bytes


def encode(docs: DataFrame, tokenizer: str, *, text: str = "text", end_id: int | None = None, out: str = "ids") -> DataFrame:
    """docs with out, the ids of a text as little-endian unsigned 32-bit integers, and end_id after them. A column of that name is replaced.

    tokenizer is a file of the tokenizers library with byte-level BPE whose pattern is that of the 50,257-word vocabulary.
    """
    content = _tokenizer_of(tokenizer)
    load, digest = _Load(docs.sparkSession.sparkContext.broadcast(content)), hashlib.sha256(content).hexdigest()
    end = b"" if end_id is None else struct.pack("<I", end_id)

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array([e + end for e in _pieces(digest, load).encode(texts)], pa.binary())

    return docs.withColumn(out, ids(F.col(text)))


def _tokenizer_of(path: str) -> bytes:
    system, inside = file_system(path)
    with system.open_input_stream(inside) as f:
        content = f.read()
    if len(content) > MOST_TOKENIZER_BYTES:
        raise ValueError(f"{path} has more than {MOST_TOKENIZER_BYTES} bytes")
    spec = json.loads(content)
    before = spec.get("pre_tokenizer") or {}
    good = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
    spaced = [t["content"] for t in spec.get("added_tokens", []) if " " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
    if not good or spaced:
        raise ValueError("texts can be cut at blanks only for byte-level BPE with its own pattern, no normalizer, and no added token with blanks")
    return content


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of size bytes at most; from too few samples their own last bytes, from none no bytes."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        raw = b"".join(samples)[-size:]
        return raw if len(raw) >= 8 else b""


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


@dataclass
class Shard(InputPartition):
    """A shard of the manifest; tokens and documents of the shards before it are added when all are known."""

    name: str
    partition: int
    number: int
    documents: int
    tokens: int
    size: int
    null_ids: int
    first_id: int | None
    last_id: int | None
    start: int = 0


@dataclass
class Written(WriterCommitMessage):
    shards: list[Shard]


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, names: set[str]) -> None:
        self.path, self.dictionary, self.shard_bytes = options["path"].rstrip("/"), options["dictionary"], int(options.get("shard_bytes", SHARD_BYTES))
        # Read once, here, and sent to the tasks with the writer.
        self.tokenizer = _tokenizer_of(options["tokenizer"]) if "ids" not in names else None
        self.end = struct.pack("<I", int(options["end_id"])) if "end_id" in options else b""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        content = _dictionary_of(self.path, self.dictionary)
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(content)).compress
        partition, shards, out = TaskContext.get().partitionId(), [], None
        pieces = _pieces(hashlib.sha256(self.tokenizer).hexdigest(), _Load(_Plain(self.tokenizer))) if self.tokenizer else None
        for batch in iterator:
            every = [e + self.end for e in pieces.encode(batch.column("text"))] if pieces else batch.column("ids").to_pylist()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), every, strict=True):
                out = out or _Open(self.path, self.dictionary, partition, len(shards))
                out.add(doc_id, ids, squeeze)
                if out.at >= self.shard_bytes:
                    shards.append(out.close())
                    out = None
        if out:
            shards.append(out.close())
        return Written(shards)

    def commit(self, messages: list[Written | None]) -> None:
        shards = sorted((s for m in messages if m for s in m.shards), key=lambda s: (s.partition, s.number))
        start = 0
        for s in shards:
            s.start, start = start, start + s.tokens
        system, inside = file_system(self.path)
        manifest = {"format": MAGIC.decode(), "dictionary": self.dictionary, "documents": sum(s.documents for s in shards), "tokens": start, "shards": [vars(s) for s in shards]}
        fresh = f"{inside}/_manifest-{uuid.uuid4().hex}"
        with system.open_output_stream(fresh) as f:
            f.write(json.dumps(manifest).encode())
        system.move(fresh, f"{inside}/_manifest.json")

    def abort(self, messages: list[Written | None]) -> None:
        system, inside = file_system(self.path)
        for s in (s for m in messages if m for s in m.shards):
            system.delete_file(f"{inside}/{s.name}")


class _Open:
    """A shard that is being written."""

    def __init__(self, path: str, dictionary: str, partition: int, number: int) -> None:
        system, inside = file_system(path)
        self.name, self.dictionary, self.partition, self.number = f"{partition:06d}-{number:04d}-{uuid.uuid4().hex}.tok", dictionary, partition, number
        self.out = system.open_output_stream(f"{inside}/{self.name}")
        self.out.write(MAGIC)
        self.at, self.ids, self.ends, self.tokens = len(MAGIC), [], [], []

    def add(self, doc_id: int | None, ids: bytes, squeeze) -> None:
        frame = squeeze(ids)
        self.out.write(frame)
        self.at += len(frame)
        self.ids.append(doc_id)
        self.ends.append(self.at)
        self.tokens.append(len(ids) // 4)

    def close(self) -> Shard:
        known = [i for i in self.ids if i is not None]
        index = b"".join(
            np.array(x, t).tobytes()
            for x, t in (([i or 0 for i in self.ids], "<i8"), ([i is None for i in self.ids], "u1"), (self.ends, "<u8"), (self.tokens, "<u8"))
        )
        self.out.write(index)
        self.out.write(FOOTER.pack(bytes.fromhex(self.dictionary), self.at, len(self.ids), zlib.crc32(index)) + MAGIC)
        self.out.close()
        size = self.at + len(index) + FOOTER.size + len(MAGIC)
        return Shard(self.name, self.partition, self.number, len(self.ids), sum(self.tokens), size, len(self.ids) - len(known), min(known, default=None), max(known, default=None))


def _dictionary_of(path: str, sha256: str) -> bytes:
    system, inside = file_system(path)
    with system.open_input_stream(f"{inside}/dictionary-{sha256}.zdict") as f:
        content = f.read()
    if hashlib.sha256(content).hexdigest() != sha256:
        raise ValueError(f"{path}: the dictionary is not the one with the hash {sha256}")
    return content


def manifest_of(path: str) -> dict:
    system, inside = file_system(path)
    with system.open_input_stream(f"{inside.rstrip('/')}/_manifest.json") as f:
        found = json.loads(f.read())
    if found.get("format") != MAGIC.decode():
        raise ValueError(f"{path} holds no token files of the format {MAGIC.decode()}")
    return found


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.wanted = sorted({int(i) for i in options["doc_ids"].split(",") if i}) if "doc_ids" in options else None
        manifest = manifest_of(self.path)
        self.dictionary = manifest["dictionary"]
        self.shards = [Shard(**s) for s in manifest["shards"]]

    def partitions(self) -> list[InputPartition]:
        def has(s: Shard) -> bool:
            at = np.searchsorted(self.wanted, s.first_id) if s.first_id is not None else len(self.wanted)
            return at < len(self.wanted) and self.wanted[at] <= s.last_id

        return [s for s in self.shards if self.wanted is None or has(s)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Shard):
            return
        system, inside = file_system(self.path)
        with system.open_input_file(f"{inside}/{partition.name}") as f:
            yield from _documents(f, partition, self.dictionary, self.wanted, _dictionary_of(self.path, self.dictionary))


def _documents(f: pa.NativeFile, shard: Shard, dictionary: str, wanted: list[int] | None, content: bytes) -> Iterator[pa.RecordBatch]:
    def wrong(why: str) -> ValueError:
        return ValueError(f"{shard.name}: {why}")

    f.seek(shard.size - FOOTER.size - len(MAGIC))
    footer = f.read(FOOTER.size + len(MAGIC))
    if f.size() != shard.size or footer[FOOTER.size :] != MAGIC:
        raise wrong("cut short, or no token file")
    digest, at, n, crc = FOOTER.unpack(footer[: FOOTER.size])
    if digest.hex() != dictionary:
        raise wrong("made with another dictionary")
    f.seek(at)
    index = f.read(n * 25)
    if zlib.crc32(index) != crc or n != shard.documents:
        raise wrong("the index is damaged")
    doc_ids, null, ends, tokens = np.frombuffer(index, "<i8", n), np.frombuffer(index, "u1", n, 8 * n), np.frombuffer(index, "<u8", n, 9 * n).astype(np.int64), np.frombuffer(index, "<u8", n, 17 * n).astype(np.int64)
    begins, starts = np.concatenate([[len(MAGIC)], ends[:-1]]), shard.start + np.concatenate([[0], np.cumsum(tokens)[:-1]])
    expand = zstandard.ZstdDecompressor(dict_data=_dictionary(content))
    rows = np.arange(n) if wanted is None else np.flatnonzero(np.isin(doc_ids, wanted) & (null == 0))
    a = 0
    while a < len(rows):
        # Documents that lie side by side are read at once, up to a bound of bytes when expanded.
        b, size = a + 1, 4 * tokens[rows[a]]
        while b < len(rows) and rows[b] == rows[b - 1] + 1 and b - a < 1000 and size + 4 * tokens[rows[b]] <= BATCH_BYTES:
            size += 4 * tokens[rows[b]]
            b += 1
        few, low = rows[a:b], begins[rows[a]]
        f.seek(int(low))
        block = f.read(int(ends[rows[b - 1]] - low))
        ids = [expand.decompress(block[begins[r] - low : ends[r] - low], max_output_size=4 * int(tokens[r])) for r in few]
        if any(len(i) != 4 * tokens[r] for i, r in zip(ids, few, strict=True)):
            raise wrong("a document has another length than the index says")
        columns = [pa.array(doc_ids[few], mask=null[few] == 1), pa.array(starts[few]), pa.array(tokens[few]), pa.array(ids, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])
        a = b


class TokenFiles(DataSource):
    """The data source `token_files`. Options: path; dictionary, shard_bytes and, for rows of text instead of ids, tokenizer and end_id to write; doc_ids, parted by commas, to read some documents."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, {f.name for f in schema.fields})


def sample_for_dictionary(docs: DataFrame, n: int) -> DataFrame:
    """Some SAMPLE_DOCUMENTS of n documents, the short ones of those that a hash of their rows picks."""
    # Rows are told apart by their place, so that repeated ones are not all picked together.
    h = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1 << 40))
    return docs.where(h <= int(min(1.0, SAMPLE_DOCUMENTS / n) * (1 << 40))).where(F.octet_length("text") <= SAMPLE_BYTES)


def write(docs: DataFrame, path: str, tokenizer: str, *, end_id: int | None = None, shard_bytes: int = SHARD_BYTES) -> None:
    """Token files of docs (doc_id, text) under path, in ascending order of doc_id."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample, text_bytes = [], 0
    if n := docs.count():
        # The pass that takes the sample measures the texts, too.
        size = Observation()
        seen = docs.observe(size, F.sum(F.octet_length("text")).alias("bytes"))
        sample = [bytes(r.ids) for r in encode(sample_for_dictionary(seen, n), tokenizer, end_id=end_id).select("ids").collect()]
        text_bytes = size.get["bytes"] or 0
    content = train_dictionary(sample)
    digest = hashlib.sha256(content).hexdigest()
    system, inside = file_system(path.rstrip("/"))
    system.create_dir(inside, recursive=True)
    with system.open_output_stream(f"{inside}/dictionary-{digest}.zdict") as f:
        f.write(content)
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-text_bytes // TASK_BYTES))
    # Rows of one doc_id are told apart, so that many of them are no single task.
    keyed = docs.withColumn("_tie", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), "_tie", "_row"]
    ordered = keyed.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    end = {} if end_id is None else {"end_id": end_id}
    ordered.select("doc_id", "text").write.format("token_files").mode("append").options(dictionary=digest, tokenizer=tokenizer, shard_bytes=shard_bytes, **end).save(path)


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of stored documents, start being the number of ids of all documents before; of some documents only by their ranges of bytes."""
    spark.dataSource.register(TokenFiles)
    small_batches(spark)
    some = {} if doc_ids is None else {"doc_ids": ",".join(map(str, doc_ids))}
    return spark.read.format("token_files").options(**some).load(path)


def decode(docs: DataFrame, tokenizer: str, *, ids: str = "ids", end_id: int | None = None, out: str = "text") -> DataFrame:
    """docs with out, the text of its ids; an end_id at their end is no part of it. A column of that name is replaced."""
    system, inside = file_system(tokenizer)
    with system.open_input_stream(inside) as f:
        content = f.read()
    load, digest, end = _Load(docs.sparkSession.sparkContext.broadcast(content)), hashlib.sha256(content).hexdigest(), end_id

    @F.arrow_udf("string")
    def text(values: pa.Array) -> pa.Array:
        lists = [np.frombuffer(v.as_py() or b"", "<u4").tolist() for v in values]
        lists = [x[:-1] if end is not None and x[-1:] == [end] else x for x in lists]
        return pa.array(_pieces(digest, load).tokenizer.decode_batch(lists, skip_special_tokens=False), pa.string())

    return docs.withColumn(out, text(F.col(ids)))
