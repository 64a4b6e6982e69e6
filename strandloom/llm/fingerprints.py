"""Document fingerprints: a canonical exact digest, by DataFrame functions alone.

with_canonical() folds a text: full case folding, canonical Unicode equivalence, white space. The digest is two xxhash64
values of different seeds, 128 bits. Within equal digests the canonical bytes are compared; should different texts
share a digest, each gets its place in byte order as a suffix. So equal canonical texts have equal fingerprints and
different ones different fingerprints.

Canonical equivalence without a normaliser: characters that fall apart into characters without a combining class are
always replaced by those; a cluster (a character and its combining marks) is taken apart, its marks are put in
canonical order, and if the whole is one character in another form, it becomes that character; Hangul syllables fall apart by
arithmetic. The tables come from unicodedata by rule. Texts under U+0300 skip all this.

Defined results: a null text counts as empty; empty texts share one fingerprint; repeated rows get equal ones;
an empty table gives an empty one; extra columns pass through fingerprint(). In compare_edited() rows without a doc_id
are ordered among themselves and the last of them has no next.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, unused

#: White space by Unicode but for the blank.
OTHER_SPACE = r"\t-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LATIN_SPACE = r"\t-\r\x85\xa0"
SEED = "fingerprint"
#: Rows of a block of neighbouring ids, and how many blocks there may be: their bounds stand in the plan.
BLOCK_ROWS = 20_000
MOST_BLOCKS = 10_000
# Fixed values of Unicode: the first of the Hangul syllables, and the numbers of their vowels and finals.
HANGUL, VOWELS, FINALS = 0xAC00, 21, 28
#: Shared digests are broadcast up to this number (a row has 32 digits), else joined by a shuffle.
MOST_BROADCAST = 200_000


@lru_cache(1)
def _tables() -> tuple[dict[str, str], dict[str, str], dict[str, str], dict[str, str], dict[str, int]]:
    """(expanded, single, apart, whole, classes), all by canonical equivalence; Hangul syllables stay as they are."""
    apart = {}
    classes = {}
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if not (0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF):
            if k := unicodedata.combining(c):
                classes[c] = k
            if (d := unicodedata.normalize("NFD", c)) != c:
                apart[c] = d
    # A character whose parts after the first have no class can't be found as a cluster, so it is always taken apart.
    expanded = {c: d for c, d in apart.items() if any(x not in classes for x in d[1:])}
    whole: dict[str, str] = {}
    for c in sorted(apart.keys() - expanded.keys(), key=lambda c: (unicodedata.normalize("NFC", c) != c, c)):
        whole.setdefault(apart[c], c if len(apart[c]) > 1 else apart[c])
    single = {c: whole[d] for c, d in apart.items() if c not in expanded and whole[d] != c}
    return expanded, single, apart, whole, classes


def _lookup(pairs: dict, key: Column) -> Column:
    """The value of key in a table that stands in the plan as one text literal."""
    table = F.str_to_map(F.lit("\2".join(f"{k}\1{v}" for k, v in pairs.items())), F.lit("\2"), F.lit("\1"))
    return F.try_element_at(table, key)


def _class(chars) -> str:
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in _ranges(chars))


def _mapped(text: Column, pairs: dict[str, str]) -> Column:
    """text with each character in pairs replaced."""
    kind = _class(pairs)
    pieces = F.regexp_extract_all(text, F.lit(f"[^{kind}]+|[{kind}]"), F.lit(0))
    return F.when(text.rlike(f"[{kind}]"), F.array_join(F.transform(pieces, lambda x: F.coalesce(_lookup(pairs, x), x)), "")).otherwise(text)


def _clustered(text: Column) -> Column:
    """text with each cluster in its canonical form."""
    expanded, _, apart, whole, classes = _tables()
    multi = {c: d for c, d in apart.items() if c not in expanded}

    def cluster(x: Column) -> Column:
        chars = F.split(F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(_lookup(multi, c), c)), ""), "")
        keyed = F.transform(chars, lambda c, i: F.struct(F.coalesce(_lookup(classes, c).cast("int"), F.lit(0)).alias("k"), i.alias("i"), c.alias("c")))
        ordered = F.array_join(F.transform(F.array_sort(keyed), lambda y: y["c"]), "")
        return F.element_at(F.transform(F.array(ordered), lambda o: F.coalesce(_lookup(whole, o), o)), 1)

    marks = _class(classes)
    pieces = F.regexp_extract_all(text, F.lit(f"[^{marks}]+(?![{marks}])|[^{marks}]?[{marks}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(f"[{marks}]"), cluster(x)).otherwise(x)), "")


def _hangul(text: Column) -> Column:
    """text with each Hangul syllable taken apart into its letters."""
    kind = r"\x{ac00}-\x{d7a3}"
    leads, vowels, finals = ("".join(map(chr, range(a, b))) for a, b in ((0x1100, 0x1113), (0x1161, 0x1176), (0x11A8, 0x11C3)))

    def apart(c: Column) -> Column:
        k = F.ascii(c) - HANGUL
        lead, vowel, final = F.floor(k / (VOWELS * FINALS)), F.floor(k / FINALS) % VOWELS, k % FINALS
        of = lambda table, i: F.substring(F.lit(table), i.cast("int"), F.lit(1))
        return F.concat(of(leads, lead + 1), of(vowels, vowel + 1), F.when(final > 0, of(finals, final)).otherwise(F.lit("")))

    pieces = F.regexp_extract_all(text, F.lit(f"[^{kind}]+|[{kind}]"), F.lit(0))
    return F.when(text.rlike(f"[{kind}]"), F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(f"^[{kind}]"), apart(x)).otherwise(x)), "")).otherwise(text)


def _ranges(chars) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for code in sorted(map(ord, chars)):
        if out and out[-1][1] == code - 1:
            out[-1] = (out[-1][0], code)
        else:
            out.append((code, code))
    return out


@lru_cache(1)
def _foldings() -> dict[str, str]:
    """Full case folding where lower case alone is not yet it."""
    every = (chr(code) for code in range(sys.maxunicode + 1) if not 0xD800 <= code <= 0xDFFF)
    return {c: c.casefold() for c in every if c == c.lower() != c.casefold()}


def with_canonical(rows: DataFrame, text: str, out: str) -> DataFrame:
    """rows with the canonical form of text as the column out; null becomes empty.

    One projection for each step, so that no step stands in the plan, or runs, more than once. Texts of Latin-1
    characters only need no more than the first and the last.
    """
    expanded, single, *_ = _tables()
    name = unused(rows.select("*", F.lit(0).alias(out)), "_wide")
    c, wide = F.col(out), F.col(name)
    far = {x: y for x, y in _foldings().items() if x > "\xff"}
    folded = F.lower(F.coalesce(F.col(text), F.lit("")))
    for x, y in _foldings().items():
        if x <= "\xff":
            folded = F.replace(folded, F.lit(x), F.lit(y))
    squeezed = lambda other: F.regexp_replace(c, f"[{other}][ {other}]*| [ {other}]+", " ")
    return (
        rows.withColumn(out, folded)
        .withColumn(name, c.rlike(r"[\x{100}-\x{10ffff}]"))
        .withColumn(out, F.when(wide, _mapped(c, far)).otherwise(c))
        .withColumn(out, F.when(wide, _mapped(c, expanded | single)).otherwise(c))
        .withColumn(out, F.when(wide, _hangul(c)).otherwise(c))
        .withColumn(out, F.when(wide & c.rlike(r"\p{M}"), _clustered(c)).otherwise(c))
        .withColumn(out, F.btrim(F.when(wide, squeezed(OTHER_SPACE)).otherwise(squeezed(LATIN_SPACE))))
        .drop(name)
    )


def digest(canon: Column) -> Column:
    """128 bits as 32 hexadecimal digits."""
    part = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(part(F.xxhash64(canon)), part(F.xxhash64(F.lit(SEED), canon)))


def collisions(texts: DataFrame, make=digest) -> DataFrame:
    """texts: (_canon). (_fp, _canon, _place) of the different canonical texts that share a digest, mostly none.

    Only texts of digests that occur more than once are compared; the group keys are the texts themselves, so Spark
    compares their bytes, and copies meet before the shuffle.
    """
    keyed = texts.select("_canon", make(F.col("_canon")).alias("_fp"))
    often = cut(keyed.groupBy("_fp").count().where("count > 1").select("_fp"), "fingerprint-buckets")
    if often.count() <= MOST_BROADCAST:
        often = F.broadcast(often)
    different = keyed.join(often, "_fp", "left_semi").groupBy("_fp", "_canon").agg(F.lit(1).alias("_one")).drop("_one")
    # The texts of a bucket are counted without gathering them.
    clash = cut(different.groupBy("_fp").count().where("count > 1").select("_fp"), "fingerprint-clashes")
    if clash.isEmpty():
        return clash.select("_fp", F.lit("").alias("_canon"), F.lit(0).alias("_place"))
    place = F.row_number().over(Window.partitionBy("_fp").orderBy("_canon"))
    return cut(different.join(clash, "_fp", "left_semi").select("_fp", "_canon", place.alias("_place")), "fingerprint-places")


def resolved(rows: DataFrame, fp: str, canon: str, clash: DataFrame) -> DataFrame:
    """rows with the suffix added to fp where its digest is shared by different texts."""
    if clash.isEmpty():
        return rows
    k, t, place = (unused(rows, x) for x in ("_k", "_t", "_place"))
    keyed = clash.select(F.col("_fp").alias(k), F.col("_canon").alias(t), F.col("_place").alias(place))
    joined = rows.join(keyed, (F.col(fp) == F.col(k)) & (F.col(canon) == F.col(t)), "left")
    return joined.withColumn(fp, F.concat(fp, F.coalesce(F.concat(F.lit("-"), F.col(place).cast("string")), F.lit("")))).drop(k, t, place)


def fingerprint(docs: DataFrame, *, text="text", out="fingerprint", make=digest) -> DataFrame:
    """docs with the column out."""
    canon = unused(docs, "_canon")
    rows = with_canonical(docs, text, canon)
    clash = collisions(rows.select(F.col(canon).alias("_canon")), make)
    return resolved(rows.withColumn(out, make(F.col(canon))), out, canon, clash).drop(canon)


def _number_of(x: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most x, by halving; null for null."""
    if not bounds:
        return F.when(x.isNotNull(), F.lit(0).cast("long"))
    table = F.array(*map(F.lit, bounds)).cast("array<long>")

    def halve(acc: Column, step: Column) -> Column:
        return F.when(F.coalesce(F.get(table, acc + step - 1) <= x, F.lit(False)), acc + step).otherwise(acc)

    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.when(x.isNotNull(), F.aggregate(steps, F.lit(0), halve).cast("long"))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs (doc_id, ...) with next_<column> of the next row by descending doc_id; after the last comes the first.

    Ids are cut into blocks of some BLOCK_ROWS rows, each ordered by itself; the top row of a block is also a guest, ordered last, in the next
    block above that has rows, and that of the highest block in the lowest: the order is a ring.
    Rows that share a doc_id are ordered by the other columns. A row alone is its own next.
    """
    n_blocks = min(MOST_BLOCKS, -(-docs.count() // BLOCK_ROWS))
    bounds = docs.agg(F.percentile_approx("doc_id", [k / n_blocks for k in range(1, n_blocks)], 100 * n_blocks)).first()[0] if n_blocks > 1 else []
    block = _number_of(F.col("doc_id"), sorted(set(bounds or [])))
    every = Window.orderBy("_b")  # over at most MOST_BLOCKS rows
    lowest = F.first("_b").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    blocks = docs.groupBy(block.alias("_b")).agg(F.max("doc_id").alias("_top")).withColumn("_above", F.coalesce(F.lead("_b").over(every), lowest))
    rest = [c for c in docs.columns if c != "doc_id"]
    tops = docs.join(F.broadcast(blocks), F.col("doc_id") == F.col("_top"))
    guests = tops.groupBy("_above").agg(F.min(F.struct(*rest, "doc_id")).alias("_t")).select(*[F.col(f"_t.{c}").alias(c) for c in docs.columns], F.col("_above").alias("_b"), F.lit(True).alias("_guest"))
    order = Window.partitionBy("_b").orderBy("_guest", F.desc("doc_id"), *rest)
    rows = docs.select("*", block.alias("_b"), F.lit(False).alias("_guest")).unionByName(guests)
    return rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where(~F.col("_guest")).drop("_b", "_guest")


def compare_edited(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): each text's fingerprint against that of its edited text and of the next document.

    The edited text has the last half of the code points replaced by as many first ones of the next document.
    An exact digest is all or nothing, so likeness is 1 or 0. An edited text's bytes are compared with its own document's.
    """
    texts = with_canonical(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "_canon")
    clash = collisions(texts.select("_canon"))
    own = resolved(texts.withColumn("fingerprint", digest(F.col("_canon"))), "fingerprint", "_canon", clash).drop("_canon")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(own, ["text", "fingerprint"]).withColumn("n_chars", n.cast("long"))
    rows = rows.withColumn("_edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)))
    rows = with_canonical(rows, "_edited", "_other").withColumn("edited_fingerprint", digest(F.col("_other")))
    rows = resolved(rows, "edited_fingerprint", "_other", clash)
    # Bytes are compared where the digests are equal; the place behind a digest is not part of it.
    alike = F.substring("edited_fingerprint", 1, 32) == F.substring("fingerprint", 1, 32)
    rows = with_canonical(rows.withColumn("_own", F.when(alike, F.col("text"))), "_own", "_canon").withColumn("_same", alike & (F.col("_canon") == F.col("_other")))
    # An edited text that has no place of its own and only shares the digest is no document's text.
    other = alike & ~F.col("_same") & (F.col("edited_fingerprint") == F.col("fingerprint"))
    rows = rows.withColumn("edited_fingerprint", F.when(other, F.concat("edited_fingerprint", F.lit("-edited"))).otherwise(F.col("edited_fingerprint")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        F.col("_same").cast("double").alias("near_edited"),
        F.col("fingerprint").eqNullSafe(F.col("next_fingerprint")).cast("double").alias("near_next"),
    )
