"""Byte-level BPE encoding and decoding.

Each match of the split pattern is merged by itself. A segment tree over its byte positions holds, at each
leaf, the rank of the pair that starts there, and at each inner node the leftmost minimum below it. A merge takes
the root and makes three point updates: the merged pair, the live neighbour on its left, and the position that
died. Pieces of up to SHORT bytes are merged many at a time, one tree in each row of a matrix; longer ones singly,
in n log n steps, so a piece of a megabyte is no special case.

Defined results: a null text counts as empty; empty texts have no ids; special tokens are ordinary text; repeated
rows each get their row; an empty table gives an empty one; extra columns pass through encode(), but
one of a name that it is given for its own columns, ids by default, is replaced.
"""

from __future__ import annotations

import base64
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import give_back

NONE = 1 << 30
SHORT = 64
#: Slots of the table of pairs: some times as many as a vocabulary has pairs.
SLOT_BITS = 20
#: Bytes of short pieces that are merged at once; their trees take some 60 bytes for each.
ROW_BYTES = 1 << 16
#: Characters of texts that are split at once, but for a longer text by itself; a piece and its place take some 15 bytes for each.
SPLIT_CHARS = 1 << 18
#: Pieces whose ids a task keeps, about 200 bytes each. Beyond it the memory starts anew; results don't depend on it.
KEPT_PIECES = 200_000
#: Rank files above this size are refused, as the ranks are broadcast.
MOST_RANK_BYTES = 64 << 20


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank."""
    with open(path, "rb") as f:
        lines = f.read(MOST_RANK_BYTES + 1)
    if len(lines) > MOST_RANK_BYTES:
        raise ValueError(f"{path}: rank files over {MOST_RANK_BYTES} bytes are not broadcast")
    pairs = [line.split() for line in lines.splitlines() if line]
    out = [b""] * (max(int(rank) for _, rank in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class Merges:
    """Ranks of single bytes and of all pairs of tokens that make a token."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        rank = {t: i for i, t in enumerate(tokens) if t}
        self.byte_rank = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        pair: dict[int, int] = {}
        for t, i in rank.items():
            for cut in range(1, len(t)):
                a, b = rank.get(t[:cut]), rank.get(t[cut:])
                if a is not None and b is not None:
                    pair[a << 32 | b] = i
        keys = np.fromiter(pair.keys(), np.int64, len(pair))
        values = np.fromiter(pair.values(), np.int64, len(pair))
        # A pair stands in the slot of its hash, or among the others where that slot is taken.
        slot = self._slot(keys)
        self.slot_key, self.slot_value = np.full(1 << SLOT_BITS, np.iinfo(np.int64).min), np.full(1 << SLOT_BITS, NONE, np.int32)
        self.slot_key[slot], self.slot_value[slot] = keys, values
        late = self.slot_key[slot] != keys
        self.shared = np.zeros(1 << SLOT_BITS, bool)
        self.shared[slot[late]] = True
        order = np.argsort(keys[late])
        self.late_key = np.append(keys[late][order], np.iinfo(np.int64).max)
        self.late_value = np.append(values[late][order], NONE)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).view(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NONE; ids under 0 stand for no token."""
        key = (left << 32) | right
        slot = self._slot(key)
        same = self.slot_key[slot] == key
        out = np.where(same, self.slot_value[slot], NONE).astype(np.int64)
        other = np.flatnonzero(self.shared[slot] & ~same)
        if len(other):
            at = np.searchsorted(self.late_key, key[other])
            out[other] = np.where(self.late_key[at] == key[other], self.late_value[at], NONE)
        return out

    @cached_property
    def pair(self) -> dict[int, int]:
        """The ranks of all pairs for pieces that are merged singly."""
        used = self.slot_value < NONE
        return dict(zip(self.slot_key[used].tolist(), self.slot_value[used].tolist(), strict=True)) | dict(zip(self.late_key[:-1].tolist(), self.late_value[:-1].tolist(), strict=True))

    def encode_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids, as little-endian 32-bit integers, of pieces of at most width bytes, a power of two."""
        n = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, n)
        column = np.arange(width)
        inside = column < length[:, None]
        # One more column stands right of the last position, where there is no token.
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :width][inside] = self.byte_rank[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.where(column + 1 < length[:, None], column + 1, width)
        before = np.tile(np.append(column - 1, 0), (n, 1))
        tree = np.full((n, 2 * width), NONE * width, np.int64)
        leaf = np.full((n, width), NONE, np.int64)
        pairs = inside.copy()
        pairs[:, :-1] &= inside[:, 1:]
        pairs[:, -1] = False
        rows, cols = np.nonzero(pairs)
        leaf[rows, cols] = self.ranks(ids[rows, cols], ids[rows, cols + 1])
        tree[:, width:] = leaf * width + column
        node = width
        while node > 1:
            node >>= 1
            tree[:, node : 2 * node] = np.minimum(tree[:, 2 * node : 4 * node : 2], tree[:, 2 * node + 1 : 4 * node : 2])
        after = np.concatenate([after, np.full((n, 1), width)], 1)
        ids_f, after_f, before_f, tree_f = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
        live = np.arange(n)
        while True:
            root = tree_f[live * 2 * width + 1]
            going = root < NONE * width
            if not going.all():
                live, root = live[going], root[going]
            if not len(live):
                break
            rank, at = root // width, root % width
            row, top = live * (width + 1), live * 2 * width
            dead = after_f[row + at]
            right = after_f[row + dead]
            left = before_f[row + at]
            ids_f[row + at] = rank
            ids_f[row + dead] = -1
            after_f[row + at] = right
            before_f[row + right] = at
            joins = left >= 0
            tree_f[top + width + dead] = NONE * width + dead
            tree_f[top + width + at] = self.ranks(rank, ids_f[row + right]) * width + at
            some = np.flatnonzero(joins)
            tree_f[top[some] + width + left[some]] = self.ranks(ids_f[row[some] + left[some]], rank[some]) * width + left[some]
            for place in (dead, at, np.where(joins, left, at)):
                node = (place + width) >> 1
                while node[0]:
                    under = top + 2 * node
                    tree_f[top + node] = np.minimum(tree_f[under], tree_f[under + 1])
                    node >>= 1
        kept = ids[:, :width] >= 0
        flat = ids[:, :width][kept].astype("<u4").tobytes()
        ends = (np.cumsum(kept.sum(1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_long(self, piece: bytes) -> bytes:
        """The same for one piece of any length."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        ids = self.byte_rank[np.frombuffer(piece, np.uint8)]
        first = np.full(width, NONE, np.int64)
        first[: n - 1] = self.ranks(ids[:-1], ids[1:])
        levels = [first * width + np.arange(width)]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [NONE * width, *np.concatenate(levels[::-1]).tolist()]
        ids, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n))
        pair = self.pair.get

        def put(place: int, rank: int) -> None:
            node = place + width
            tree[node] = rank * width + place
            while node > 1:
                low, sibling = tree[node], tree[node ^ 1]
                node >>= 1
                if sibling < low:
                    low = sibling
                if tree[node] == low:
                    break
                tree[node] = low

        while tree[1] < NONE * width:
            rank, at = divmod(tree[1], width)
            dead = after[at]
            right, left = after[dead], before[at]
            ids[at], ids[dead] = rank, -1
            after[at] = right
            put(dead, NONE)
            if right < n:
                before[right] = at
                put(at, pair(rank << 32 | ids[right], NONE))
            else:
                put(at, NONE)
            if left >= 0:
                put(left, pair(ids[left] << 32 | rank, NONE))
        ids = np.array(ids, np.int64)
        return ids[ids >= 0].astype("<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_width.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, which in by_width.items():
            if width > SHORT:
                for i in which:
                    out[i] = self.encode_long(pieces[i])
            else:
                step = ROW_BYTES // width
                for a in range(0, len(which), step):
                    part = which[a : a + step]
                    for i, x in zip(part, self.encode_rows([pieces[i] for i in part], width), strict=True):
                        out[i] = x
        return out


def _parts(texts: list[str], chars: int):
    """texts in turn, of some chars characters together or one by itself."""
    a, size = 0, 0
    for b, t in enumerate(texts):
        if a < b and size + len(t) > chars:
            yield texts[a:b]
            a, size = b, 0
        size += len(t)
    if a < len(texts):
        yield texts[a:]


class Encoder:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.merges = Merges(tokens)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for part in _parts(texts, SPLIT_CHARS):
            pieces = [self.split(t) for t in part]
            new = list(set().union(*pieces).difference(self.known))
            if len(self.known) + len(new) > KEPT_PIECES:
                self.known.clear()
                new = list(set().union(*pieces))
            self.known.update(zip(new, self.merges.encode_pieces([p.encode() for p in new]), strict=True))
            out += [b"".join(map(self.known.__getitem__, p)) for p in pieces]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.merges.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(1)
def _encoder(shared, pattern: str) -> Encoder:
    return Encoder(shared.value, pattern)


class _Shared:
    """A broadcast that compares by its id, so a worker builds its tables once."""

    def __init__(self, broadcast):
        self.broadcast, self.key = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "key": self.key}

    def __hash__(self):
        return hash(self.key)

    def __eq__(self, other):
        return self.key == other.key

    @property
    def value(self):
        return self.broadcast.value


class Codec:
    """encode and decode columns by one rank file, which the driver reads and broadcasts once."""

    def __init__(self, spark, path: str, pattern: str):
        shared = _Shared(spark.sparkContext.broadcast(read_ranks(path)))

        @F.pandas_udf("binary")
        def to_ids(texts: pd.Series) -> pd.Series:
            give_back()
            return pd.Series(_encoder(shared, pattern).encode(texts.fillna("").tolist()), dtype=object)

        @F.pandas_udf("binary")
        def to_bytes(ids: pd.Series) -> pd.Series:
            give_back()
            decode = _encoder(shared, pattern).decode
            return pd.Series([decode(x or b"") for x in ids], dtype=object)

        self._to_ids, self._to_bytes = to_ids, to_bytes

    def ids(self, text: Column | str) -> Column:
        """Binary: the ids as little-endian unsigned 32-bit integers; empty for a null text."""
        return self._to_ids(text)

    def bytes(self, ids: Column | str) -> Column:
        """Binary: the bytes that the ids stand for."""
        return self._to_bytes(ids)


def encode(docs: DataFrame, path: str, pattern: str, *, text="text", ids="ids", decoded: str | None = None) -> DataFrame:
    """docs with the binary column ids, and if named, the bytes decoded from it again."""
    codec = Codec(docs.sparkSession, path, pattern)
    out = docs.withColumn(ids, codec.ids(text))
    return out.withColumn(decoded, codec.bytes(ids)) if decoded else out


def n_tokens(ids: Column | str) -> Column:
    return (F.length(ids) / 4).cast("long")
