"""Word shingles as 64-bit hashes, for whole batches of bytes at a time."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
STEP = 1 << 16


def byte_table(separators: bytes) -> np.ndarray:
    """For each byte its value in a word, in lower case and from 1 up; 0 for separators."""
    table = np.arange(1, 257, dtype=np.uint64)
    table[ord("A") + 0 : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    table[list(separators)] = 0
    return table


#: Words are what stands between blanks and the control characters 9 to 13.
BY_SPACE = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are runs of ASCII letters and digits and of all characters beyond ASCII.
BY_LETTER = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    up = np.cumprod(np.full(STEP, BASE, np.uint64))
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    return up, np.cumprod(np.full(STEP, inverse, np.uint64))


UP, DOWN = _powers()


def _segment(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of at most STEP byte values, of which the last is a separator, and their lengths.

    A word's hash is a polynomial over its bytes; it comes from one running sum.
    """
    word = values != 0
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * UP[: len(values)])])
    return mix((sums[end] - sums[start]) * DOWN[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), end - start


def words(text: bytes, table: np.ndarray) -> np.ndarray:
    """The hash of each word of a text, in order; memory beyond the text's own is bounded but for these."""
    out, at, n = [], 0, len(text)
    raw = np.frombuffer(text, np.uint8)
    while at < n:
        values = table[raw[at : at + STEP]]
        if at + STEP <= n:
            gaps = np.flatnonzero(values == 0)
            if not len(gaps):  # one word of over STEP bytes
                rest = table[raw[at:]]
                stop = np.flatnonzero(rest == 0)
                stop = int(stop[0]) if len(stop) else len(rest)
                out.append(np.array([_long(rest[:stop])], np.uint64))
                at += stop
                continue
            values = values[: gaps[-1] + 1]
        out.append(_segment(values)[0])
        at += len(values)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _long(values: np.ndarray) -> np.uint64:
    parts = [np.cumsum(values[a : a + STEP] * UP[: len(values[a : a + STEP])])[-1] for a in range(0, len(values), STEP)]
    total = np.uint64(len(values))
    for p in parts:
        total = mix(np.array([total ^ p], np.uint64))[0]
    return total


def shingles(word: np.ndarray, width: int) -> np.ndarray:
    """The distinct hashes of width consecutive words, ascending; all words as one if they are fewer; none without words."""
    if not len(word):
        return np.zeros(0, np.uint64)
    width = min(width, len(word))
    out = np.full(len(word) - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + word[i : len(word) - width + 1 + i])
    return np.unique(out)


def of_text(text: str | None, width: int, table: np.ndarray = BY_SPACE) -> np.ndarray:
    return shingles(words((text or "").encode("utf-8", "surrogatepass"), table), width)
