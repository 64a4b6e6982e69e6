"""Conversions between bases, k-mers, integers and packed reads, as column expressions.

A, C, G, T are 0 to 3; this order is also that of the letters, so the smaller of two k-mers is the same as text and as
integer. Any other character has no code and ends a window.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES_PER_BLOCK = 10
PARTITIONS = 100
MOST_K = 31


def check_k(k: int) -> int:
    if not isinstance(k, int) or isinstance(k, bool) or not 1 <= k <= MOST_K:
        raise ValueError(f"k must be an integer from 1 to {MOST_K}, not {k!r}")
    return k


def reverse_complement(kmer: Column) -> Column:
    return F.reverse(F.translate(kmer, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def encode_kmer(kmer: Column) -> Column:
    """Two bits for each base, the first base in the highest."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def decode_kmer(enc: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(enc.cast("string"), 10, 4), check_k(k), "0"), "0123", "ACGT")


def checked_query(kmer: Column, k: int) -> Column:
    """The first k characters; an error unless they are k bases."""
    first = F.substring(kmer, 1, check_k(k))
    return F.when(first.rlike(f"^[ACGT]{{{k}}}$"), first).otherwise(F.raise_error(F.concat(F.lit("not a k-mer of bases: "), F.coalesce(kmer, F.lit("null")))))


def partition_id(enc: Column, k: int, partitions: int = PARTITIONS, by: str = "middle") -> Column:
    """by 'middle' takes the k-mer's bits from k / 2 up, 'remainder' the k-mer itself."""
    if by not in ("middle", "remainder"):
        raise ValueError(f"by is 'middle' or 'remainder', not {by!r}")
    return ((F.shiftright(enc, check_k(k) // 2) if by == "middle" else enc) % partitions).cast("int")


def normalised(seq: Column) -> Column:
    """Every character that is no base as N."""
    return F.regexp_replace(seq, "[^ACGT]", "N")


def read_header(seq: Column) -> Column:
    """Two set bits above a length of 30 bits."""
    return (F.lit(3 << 30) + F.length(seq)).cast("long")


def pack_read(seq: Column) -> Column:
    """Blocks of ten bases, three bits each, the first base in the highest; N is 4 and padding 0."""
    digits = F.translate(normalised(seq), "ACGTN", "01234")
    padded = F.concat(digits, F.substring(F.lit("0" * BASES_PER_BLOCK), F.lit(1), F.pmod(-F.length(seq), F.lit(BASES_PER_BLOCK))))
    # An octal digit is three bits.
    return F.transform(F.regexp_extract_all(padded, F.lit(f".{{{BASES_PER_BLOCK}}}"), F.lit(0)), lambda b: F.conv(b, 8, 10).cast("long"))


def unpack_read(header: Column, blocks: Column) -> Column:
    octal = F.array_join(F.transform(blocks, lambda b: F.lpad(F.conv(b.cast("string"), 10, 8), BASES_PER_BLOCK, "0")), "")
    return F.substring(F.translate(octal, "01234", "ACGTN"), F.lit(1), (header - (3 << 30)).cast("int"))


def words_of(blocks: Column) -> Column:
    """32-bit words of an encoded read, the header included."""
    return F.size(blocks) + 1


def words_for(seq: Column) -> Column:
    """The same for a read that is not packed."""
    return F.ceil(F.length(seq) / BASES_PER_BLOCK) + 1


def checked_header(header: Column, blocks: Column) -> Column:
    """header; an error unless its two high bits are set and its length fits the number of blocks."""
    length = header - (3 << 30)
    good = (length >= 0) & (length < 1 << 30) & (F.ceil(length / BASES_PER_BLOCK) == F.size(blocks))
    return F.when(good, header).otherwise(F.raise_error(F.concat(F.lit("not the header of a packed read: "), F.coalesce(header.cast("string"), F.lit("null")))))
