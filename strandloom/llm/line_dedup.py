"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate. One HyperLogLog sketch of sites is kept for each
line hash and merged by aggregation. Estimates far from the threshold decide at once; lines near it
are counted exactly. A boilerplate line stays where it occurs first (smallest doc_id, then position)
and goes everywhere else.

Defined results: a null text has no lines and stays null; an empty text has no line worth comparing;
blank lines are never removed; rows with a null site add no site; rows that repeat a doc_id count as
the same place, so a line's first place may stay in each of them; rows without a doc_id lose no line; an empty table
gives an empty one.
Extra columns pass through untouched, whatever their names; columns n_lines and n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, unused

#: ASCII white space that is stripped from both ends of a line before lines are compared.
STRIPPED = " \t\r\x0b\x0c"
MIN_SITES = 5
#: Estimates at or above SURE times the threshold need no exact count, those under 1/SURE of it neither.
#: At 2^12 registers the error is under 2 %, so this band is wide.
SURE = 1.5
LG_K = 12
#: Boilerplate lines that are broadcast (some 50 bytes each). Beyond it they are joined by a shuffle, but for those that
#: stand more than HOT times: there are at most as many of them as lines by HOT.
MOST_BROADCAST = 200_000
HOT = 1_000_000


def _lines(docs: DataFrame, text: str, doc_id: str, site: str) -> DataFrame:
    exploded = docs.select(
        F.col(doc_id).alias("_id"),
        F.col(site).cast("string").alias("_site"),
        F.posexplode(F.split(F.col(text), "\n", -1)).alias("_pos", "_line"),
    )
    key: Column = F.btrim("_line", F.lit(STRIPPED))
    return (
        exploded.withColumn("_key", key)
        .where(F.length("_key") > 0)
        .select("_id", "_site", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("line"), "_key").alias("_h2"))
    )


def boilerplate(docs: DataFrame, *, text="text", doc_id="doc_id", site="source", min_sites: int = MIN_SITES) -> DataFrame:
    """(_h1, _h2, _first, _n): hashes of the lines on at least min_sites sites, each one's first place and number."""
    lines = _lines(docs, text, doc_id, site)
    spread = lines.groupBy("_h1", "_h2").agg(
        F.hll_sketch_agg("_site", F.lit(LG_K)).alias("_sketch"),
        F.min(F.struct("_id", "_pos")).alias("_first"),
        F.count("*").alias("_n"),
    )
    estimated = cut(
        spread.select("_h1", "_h2", "_first", "_n", F.hll_sketch_estimate("_sketch").alias("_sites")).where(
            F.col("_sites") >= min_sites / SURE
        ),
        "line-spread",
    )
    sure = F.col("_sites") >= min_sites * SURE
    near = estimated.where(~sure)
    # One row for each line and site at most goes into the exact count.
    exact = (
        lines.join(near.select("_h1", "_h2"), ["_h1", "_h2"], "left_semi")
        .groupBy("_h1", "_h2", "_site").count()
        .groupBy("_h1", "_h2").agg(F.count("_site").alias("_exact"))
        .where(F.col("_exact") >= min_sites)
    )
    counted = near.join(exact, ["_h1", "_h2"]).select("_h1", "_h2", "_first", "_n")
    return cut(estimated.where(sure).select("_h1", "_h2", "_first", "_n").unionByName(counted), "line-boilerplate")


def dedup_lines(docs: DataFrame, *, text="text", doc_id="doc_id", site="source", min_sites: int = MIN_SITES, spare_emptied: bool = False) -> DataFrame:
    """docs with the text freed of repeated boilerplate, and the columns n_lines and n_removed.

    n_lines is 0 for a null text. n_removed counts removed lines. With spare_emptied a text that would be left without
    a line worth comparing keeps all its lines.
    """
    found = boilerplate(docs, text=text, doc_id=doc_id, site=site, min_sites=min_sites)
    lines = _lines(docs, text, doc_id, site)
    key = ["_h1", "_h2"]
    if found.count() <= MOST_BROADCAST:
        hits = lines.join(F.broadcast(found), key)
    else:
        hot = F.broadcast(found.where(F.col("_n") > HOT))
        rest = lines.join(hot, key, "left_anti").join(found.where(F.col("_n") <= HOT).hint("merge"), key)
        hits = lines.join(hot, key).unionByName(rest)
    gone = hits.where(F.struct("_id", "_pos") != F.col("_first")).select("_id", "_pos")
    own, drop = (unused(docs, x) for x in ("_id", "_drop"))
    drops = cut(gone, "line-drops").groupBy(F.col("_id").alias(own)).agg(F.array_sort(F.collect_set("_pos")).alias(drop))
    lines = F.split(F.col(text), "\n", -1)
    # The lines between one drop and the next are slices of the one array of lines, which an array of its own keeps from being split again.
    after = F.concat(F.array(F.lit(1)), F.transform(drop, lambda i: i + 2))
    until = F.concat(F.transform(drop, lambda i: i + 1), F.array(F.size(lines) + 1))
    between = F.zip_with(after, until, lambda a, b: F.struct(a.alias("a"), (b - a).alias("n")))
    slices = lambda every: F.flatten(F.transform(between, lambda x: F.slice(every, x["a"], x["n"])))
    kept = F.transform(F.array(lines), lambda every: F.array_join(slices(every), "\n"))
    # The same plan at every size: texts are dealt out by id, whether or not the drops happen to be few.
    joined = docs.join(drops.hint("merge"), docs[doc_id] == drops[own], "left")
    clean = F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.get(kept, F.lit(0)))
    n_removed = F.coalesce(F.size(drop), F.lit(0))
    if spare_emptied:
        emptied = F.col(drop).isNotNull() & (F.length(F.btrim(clean, F.lit(STRIPPED + "\n"))) == 0)
        clean, n_removed = F.when(emptied, F.col(text)).otherwise(clean), F.when(emptied, 0).otherwise(n_removed)
    return (
        joined.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long"))
        .withColumn("n_removed", n_removed.cast("long"))
        .withColumn(text, clean)
        .drop(own, drop)
    )


#: The same in DuckDB SQL, with exact counts for all lines.
ORACLE = f"""
WITH l AS (
  SELECT doc_id, source, u.pos - 1 AS pos, u.line AS line,
         trim(u.line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS key
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS a FROM documents),
       LATERAL (SELECT unnest(a) AS line, unnest(range(1, len(a) + 1)) AS pos) u),
b AS (SELECT key, min({{'d': doc_id, 'p': pos}}) AS f FROM l WHERE key <> '' GROUP BY key
      HAVING count(DISTINCT source) >= {MIN_SITES}),
k AS (SELECT l.doc_id, l.pos, l.line, b.key IS NOT NULL AND (l.doc_id <> b.f.d OR l.pos <> b.f.p) AS gone
      FROM l LEFT JOIN b ON l.key = b.key AND l.key <> ''),
d AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
      FROM k GROUP BY doc_id)
SELECT s.doc_id, CASE WHEN s.text IS NULL THEN NULL ELSE d.text END AS text,
       coalesce(d.n_lines, 0)::BIGINT AS n_lines, coalesce(d.n_removed, 0)::BIGINT AS n_removed
FROM documents s LEFT JOIN d USING (doc_id)
"""
