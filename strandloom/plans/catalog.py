"""The queries of this library over the driver's tables, and their SQL.

The tables hold no reads, so each line of documents.text is projected to one; see sources.reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import canonical, decode_kmer, encode_kmer
from ..operators import kmers, lookup, packing, tables
from ..sources.files import fresh, shared_dir
from ..sources.packed import read_packed, write_packed
from ..sources.reads import TEXT_FROM, TEXT_TO, numbered_lines, read_queries, reads_from_text, scan_fastq
from ..streaming import counts as streaming

LOOKUP_K = 9


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads_from_text(_documents(spark, sf_dir), "doc_id")


def fastq_sequence_filter(spark, sf_dir):
    """Document lines taken as lines of records: the second of each four."""
    lines = _documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "seq"))
    return lines.where(F.col("line") % 4 == 1).select("doc_id", F.col("line").cast("long").alias("line"), "seq")


def reads_projection(spark, sf_dir):
    return _reads(spark, sf_dir)


def encode_reads(spark, sf_dir):
    packed = packing.pack(_reads(spark, sf_dir))
    return packed.select("doc_id", "line", "header", F.posexplode("blocks").alias("block_i", "block")).withColumn("block_i", F.col("block_i").cast("long"))


def decode_roundtrip(spark, sf_dir):
    return packing.unpack(packing.pack(_reads(spark, sf_dir))).select("doc_id", "line", "seq")


def kmer_extract_k5(spark, sf_dir):
    """Windows of each read: how many, the first and the last in the order of text."""
    # K-mers of one length are in the same order as integers, whose least and greatest are kept in place; those of text have each window sorted.
    found = kmers.windows(_reads(spark, sf_dir), 5).withColumn("enc", encode_kmer(F.col("kmer")))
    of_read = found.groupBy("doc_id", "line").agg(F.count("*").alias("n_kmers"), F.min("enc").alias("first"), F.max("enc").alias("last"))
    return of_read.select("doc_id", "line", "n_kmers", decode_kmer(F.col("first"), 5).alias("first_kmer"), decode_kmer(F.col("last"), 5).alias("last_kmer"))


def _counts(k: int, **options):
    def query(spark, sf_dir):
        return kmers.count(_reads(spark, sf_dir), k, **options)

    return query


kmer_counts_k5 = _counts(5)
kmer_counts_k9 = _counts(9)
kmer_counts_k21 = _counts(21)
kmer_counts_k31 = _counts(31)
kmer_counts_native_k9 = _counts(9, strategy="native")
kmer_counts_forward_k9 = _counts(9, canonical=False)
kmer_counts_u16_k2 = _counts(2, count_mode="u16")


def kmer_encoded_k9(spark, sf_dir):
    rows = kmers.encoded(kmer_counts_k9(spark, sf_dir))
    return rows.select("kmer", "enc", decode_kmer(F.col("enc"), 9).alias("decoded"), "cnt")


def kmer_partition_stats(spark, sf_dir):
    return tables.partition_stats(kmers.count(_reads(spark, sf_dir), 9, enc=True), 9)


def kmer_partition_remainder(spark, sf_dir):
    """The same with parts by the k-mer's remainder."""
    return tables.partition_stats(kmers.count(_reads(spark, sf_dir), 9, enc=True), 9, by="remainder")


def kmer_distinct_total(spark, sf_dir):
    return tables.totals(kmer_counts_k9(spark, sf_dir))


def kmer_merge(spark, sf_dir):
    """Counts of documents with even and with odd ids, merged."""
    reads = _reads(spark, sf_dir)
    half = lambda r: kmers.count(reads.where(F.col("doc_id") % 2 == r), 9)
    return tables.merge(half(0), half(1))


def _asked(spark, sf_dir) -> DataFrame:
    """(qid, kmer): the first k-mer in the first line of each document whose id is divisible by 100."""
    first = _reads(spark, sf_dir).where((F.col("doc_id") % 100 == 0) & (F.col("line") == 0))
    kmer = F.regexp_extract("seq", f"[ACGT]{{{LOOKUP_K}}}", 0)
    return first.select((F.col("doc_id") / 100).cast("int").alias("qid"), kmer.alias("kmer")).where("kmer <> ''")


def _lookup(**options):
    def query(spark, sf_dir):
        return lookup.count_and_lookup(_reads(spark, sf_dir).select("seq"), _asked(spark, sf_dir), LOOKUP_K, **options)

    return query


kmer_lookup_exact = _lookup()
kmer_lookup_canonical = _lookup(mode="canonical")
kmer_lookup_dup_last = _lookup(dup="last")


def _stored(spark, sf_dir, k: int = LOOKUP_K, where: str = "TRUE") -> str:
    path = fresh(spark, "kmer-table")
    tables.save(kmers.count(_reads(spark, sf_dir).where(where), k, enc=True), k, path)
    return path


def kmer_lookup_stored(spark, sf_dir):
    """The canonical lookup in a stored table of which only the parts and pages that the queries need are read."""
    return lookup.lookup_stored(spark, _stored(spark, sf_dir), _asked(spark, sf_dir), LOOKUP_K, mode="canonical")


def kmer_appended(spark, sf_dir):
    """A stored table of the documents with even ids, to which the others' counts are appended."""
    path = _stored(spark, sf_dir, 9, "doc_id % 2 = 0")
    tables.save(kmers.count(_reads(spark, sf_dir).where("doc_id % 2 = 1"), 9, enc=True), 9, path, mode="append")
    return tables.added_up(tables.load(spark, path, 9)).select("kmer", "enc", "cnt", F.col("part").cast("int").alias("part"))


def kmer_upsert(spark, sf_dir):
    """The same, the others' counts merged into the stored table in place, one row for each k-mer."""
    path = _stored(spark, sf_dir, 9, "doc_id % 2 = 0")
    tables.upsert(kmers.count(_reads(spark, sf_dir).where("doc_id % 2 = 1"), 9, enc=True), 9, path)
    return tables.load(spark, path, 9).select("kmer", "enc", "cnt", "part")


def kmer_compacted(spark, sf_dir):
    """The same, appended and then put together: one version of each part."""
    path = _stored(spark, sf_dir, 9, "doc_id % 2 = 0")
    tables.save(kmers.count(_reads(spark, sf_dir).where("doc_id % 2 = 1"), 9, enc=True), 9, path, mode="append")
    tables.compact(spark, path, 9)
    return tables.load(spark, path, 9).select("kmer", "enc", "cnt", "part")


def kmer_merge_flat(spark, sf_dir):
    """Counts of documents with even ids, merged with those of the others as flat arrays."""
    reads = _reads(spark, sf_dir)
    half = lambda r: kmers.count(reads.where(F.col("doc_id") % 2 == r), 9, enc=True)
    return tables.merge_flat(half(0), tables.flat(tables.partitioned(half(1), 9)), 9)


def kmer_flat(spark, sf_dir):
    """The count table as flat arrays: for each part their numbers, the first and the last."""
    arrays = tables.flat(tables.partitioned(kmers.count(_reads(spark, sf_dir), 9, enc=True), 9))
    first, last = F.min_by(F.get("pairs", F.lit(0)), "chunk"), F.max_by(F.element_at("pairs", -1), "chunk")
    return arrays.groupBy("part").agg(F.sum(F.size("pairs")).alias("n"), first.alias("first_enc"), last.alias("last_cnt"))


def kmer_flat_chunks(spark, sf_dir):
    """The count table as flat arrays of 500 pairs at most: each one's place, size, first and last key and sum of counts."""
    arrays = tables.flat(tables.partitioned(kmers.count(_reads(spark, sf_dir), 9, enc=True), 9), 500)
    n = F.size("pairs")
    counts = F.aggregate(F.filter("pairs", lambda x, i: i % 2 == 1), F.lit(0).cast("long"), lambda a, x: a + x)
    return arrays.select("part", "chunk", "offset", n.cast("long").alias("n"), F.get("pairs", F.lit(0)).alias("first_enc"), F.element_at("pairs", -2).alias("last_enc"), counts.alias("total"))


def fastq_scan(spark, sf_dir):
    """Document lines written as compressed FASTQ files and read back; how often each sequence stands there."""
    return scan_fastq(spark, _as_fastq(spark, sf_dir, "gzip")).groupBy("seq").agg(F.count("*").alias("n_reads"))


def fastq_records(spark, sf_dir):
    """The same records from plain files, in ranges of bytes, with their names, which say where each sequence came from, and the length of their qualities."""
    name = F.split("name", ":")
    rows = scan_fastq(spark, _as_fastq(spark, sf_dir), "name string, seq string, quality string")
    return rows.select(name[0].cast("long").alias("doc_id"), name[1].cast("long").alias("line"), "seq", F.length("quality").cast("long").alias("n_quality"))


def _as_fastq(spark, sf_dir, compression: str = "none") -> str:
    path = fresh(spark, "fastq")
    record = F.concat_ws("\n", F.format_string("@%d:%d", "doc_id", "line"), "seq", F.lit("+"), F.repeat(F.lit("I"), F.length("seq")))
    _reads(spark, sf_dir).select(record.alias("value")).write.text(path, compression=compression)
    return path


def kmer_lookup_file(spark, sf_dir):
    """A query list from a text file, looked up, and the result file read back: its lines in query order."""
    asked, listed, found = _asked(spark, sf_dir), fresh(spark, "kmer-queries"), fresh(spark, "kmer-result")
    # A list of queries is one file, as its lines are numbered.
    asked.orderBy("qid").select("kmer").coalesce(1).write.text(listed)
    queries = read_queries(spark, listed, LOOKUP_K, asked.count())
    lookup.write_result(lookup.lookup(kmers.count(_reads(spark, sf_dir), LOOKUP_K), queries), found, one_file=True)
    row = F.split("text", "\t")
    return numbered_lines(spark, found).select("line", row[0].alias("kmer"), row[1].cast("long").alias("cnt"))


def encoded_store(spark, sf_dir):
    """Packed reads stored, read with their headers checked, and unpacked."""
    path = fresh(spark, "packed-reads")
    packing.save(packing.pack(_reads(spark, sf_dir)), path)
    return packing.unpack(packing.load(spark, path)).select("doc_id", "line", "seq")


def encoded_files(spark, sf_dir):
    """Reads in binary files of headers and words, read back; how often each stands there, with its header."""
    path = fresh(spark, "packed-files")
    write_packed(_reads(spark, sf_dir).select("seq"), path)
    return read_packed(spark, path, "header long, seq string").groupBy("header", "seq").agg(F.count("*").alias("n_reads"))


def encoded_size(spark, sf_dir):
    return packing.packed_size(_reads(spark, sf_dir))


def stream_counts(spark, sf_dir):
    path = f"{sf_dir}/documents.parquet"
    # A pattern, as a stream reads folders or patterns, and the table may be one file.
    docs = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return streaming.run_available(streaming.stream_counts(reads_from_text(docs), 5), shared_dir(spark))


def stream_table(spark, sf_dir):
    """Counts of document lines that arrive as FASTQ files, streamed into a stored table."""
    path, progress = fresh(spark, "kmer-table"), fresh(spark, "stream")
    reads = streaming.stream_fastq(spark, _as_fastq(spark, sf_dir), f"{progress}/log")
    streaming.stream_into_table(reads, 9, path, f"{progress}/progress")
    return tables.added_up(tables.load(spark, path, 9)).select("kmer", "cnt")


QUERIES = {
    f: globals()[f]
    for f in (
        "fastq_sequence_filter", "reads_projection", "encode_reads", "decode_roundtrip", "kmer_extract_k5",
        "kmer_counts_k5", "kmer_counts_k9", "kmer_counts_k21", "kmer_counts_k31", "kmer_counts_native_k9", "kmer_counts_forward_k9", "kmer_counts_u16_k2",
        "kmer_encoded_k9", "kmer_partition_stats", "kmer_distinct_total", "kmer_merge",
        "kmer_lookup_exact", "kmer_lookup_canonical", "kmer_lookup_dup_last", "encoded_size", "stream_counts",
        "kmer_partition_remainder", "kmer_lookup_stored", "kmer_appended", "kmer_merge_flat", "kmer_flat", "kmer_flat_chunks", "kmer_upsert", "kmer_compacted", "stream_table", "fastq_scan", "fastq_records", "kmer_lookup_file", "encoded_store", "encoded_files",
    )
}

READS = f"""reads AS (
  SELECT doc_id, line - 1 AS line, regexp_replace(translate(raw, '{TEXT_FROM}', '{TEXT_TO}'), '[^ACGT]', 'N', 'g') AS seq, raw
  FROM (SELECT doc_id, unnest(a) AS raw, unnest(range(1, len(a) + 1)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)))"""


def _windows(k: int, where: str = "TRUE") -> str:
    return f"""w AS (SELECT doc_id, line, substr(seq, i, {k}) AS w FROM (SELECT doc_id, line, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM reads WHERE {where})),
v AS (SELECT doc_id, line, w, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS c FROM w WHERE NOT contains(w, 'N'))"""


def _count_sql(k: int, column: str = "c", value: str = "count(*)") -> str:
    return f"WITH {READS}, {_windows(k)} SELECT {column} AS kmer, {value} AS cnt FROM v GROUP BY 1"


ENC = "list_reduce(list_transform(string_split({}, ''), lambda x: (strpos('ACGT', x) - 1)::BIGINT), lambda x, y: x * 4 + y)"
BLOCKS = """p AS (SELECT doc_id, line, 3221225472 + length(seq) AS header, unnest(range(0, (length(seq) + 9) // 10)) AS block_i, seq FROM reads),
b AS (SELECT doc_id, line, header, block_i, list_reduce(list_transform(string_split(rpad(translate(substr(seq, block_i * 10 + 1, 10), 'ACGTN', '01234'), 10, '0'), ''), lambda x: x::BIGINT), lambda x, y: x * 8 + y) AS block FROM p)"""
COUNTS9 = f"{READS}, {_windows(9)}, k AS (SELECT c AS kmer, count(*) AS cnt FROM v GROUP BY 1)"

APPENDED = f"WITH {COUNTS9}, e AS (SELECT kmer, {ENC.format('kmer')} AS enc, cnt FROM k) SELECT kmer, enc, cnt, ((enc >> 4) % 100)::INT AS part FROM e"


def _lookup_sql(key: str, value: str) -> str:
    return f"""WITH {COUNTS9},
q AS (SELECT (doc_id // 100)::INT AS qid, regexp_extract(seq, '[ACGT]{{{LOOKUP_K}}}') AS kmer FROM reads WHERE doc_id % 100 = 0 AND line = 0),
a AS (SELECT qid, kmer, {key} AS key, max(qid) OVER (PARTITION BY kmer) AS last FROM q WHERE kmer <> '')
SELECT qid, a.kmer AS kmer, ({value})::BIGINT AS cnt FROM a LEFT JOIN k ON k.kmer = a.key"""


ORACLE_SQL = {
    "fastq_sequence_filter": f"WITH {READS} SELECT doc_id, line, raw AS seq FROM reads WHERE line % 4 = 1",
    "reads_projection": f"WITH {READS} SELECT doc_id, line, seq FROM reads",
    "encode_reads": f"WITH {READS}, {BLOCKS} SELECT doc_id, line, header, block_i, block FROM b",
    "decode_roundtrip": f"WITH {READS} SELECT doc_id, line, seq FROM reads",
    "kmer_extract_k5": f"WITH {READS}, {_windows(5)} SELECT doc_id, line, count(*) AS n_kmers, min(w) AS first_kmer, max(w) AS last_kmer FROM v GROUP BY 1, 2",
    "kmer_counts_k5": _count_sql(5),
    "kmer_counts_k9": _count_sql(9),
    "kmer_counts_k21": _count_sql(21),
    "kmer_counts_k31": _count_sql(31),
    "kmer_counts_native_k9": _count_sql(9),
    "kmer_counts_forward_k9": _count_sql(9, "w"),
    "kmer_counts_u16_k2": _count_sql(2, value="count(*) % 65536"),
    "kmer_encoded_k9": f"WITH {COUNTS9} SELECT kmer, {ENC.format('kmer')} AS enc, kmer AS decoded, cnt FROM k",
    "kmer_partition_stats": f"WITH {COUNTS9} SELECT (({ENC.format('kmer')}) >> 4) % 100 AS part, count(*) AS distinct_kmers, sum(cnt)::BIGINT AS total FROM k GROUP BY 1",
    "kmer_distinct_total": f"WITH {COUNTS9} SELECT count(*) AS distinct_kmers, coalesce(sum(cnt), 0)::BIGINT AS total, coalesce(max(cnt), 0) AS largest FROM k",
    "kmer_merge": _count_sql(9),
    "kmer_lookup_exact": _lookup_sql("kmer", "coalesce(cnt, 0)"),
    "kmer_lookup_canonical": _lookup_sql("least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA')))", "coalesce(cnt, 0)"),
    "kmer_lookup_dup_last": _lookup_sql("kmer", "CASE WHEN qid = last THEN coalesce(cnt, 0) ELSE 0 END"),
    "encoded_size": f"WITH {READS} SELECT count(*) AS reads, (sum(1 + (length(seq) + 9) // 10) * 4)::BIGINT AS bytes FROM reads",
    "stream_counts": _count_sql(5),
    "kmer_partition_remainder": f"WITH {COUNTS9} SELECT ({ENC.format('kmer')}) % 100 AS part, count(*) AS distinct_kmers, sum(cnt)::BIGINT AS total FROM k GROUP BY 1",
    "kmer_lookup_stored": _lookup_sql("least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA')))", "coalesce(cnt, 0)"),
    "kmer_appended": APPENDED,
    "kmer_upsert": APPENDED,
    "kmer_compacted": APPENDED,
    "stream_table": _count_sql(9),
    "kmer_merge_flat": _count_sql(9),
    "kmer_flat_chunks": f"""WITH {COUNTS9}, e AS (SELECT {ENC.format('kmer')} AS enc, cnt FROM k),
p AS (SELECT ((enc >> 4) % 100)::INT AS part, enc, cnt, row_number() OVER (PARTITION BY (enc >> 4) % 100 ORDER BY enc) - 1 AS i FROM e)
SELECT part, i // 500 AS chunk, i // 500 * 500 AS "offset", 2 * count(*) AS n, min(enc) AS first_enc, max(enc) AS last_enc, sum(cnt)::BIGINT AS total FROM p GROUP BY 1, 2, 3""",
    "kmer_flat": f"WITH {COUNTS9}, e AS (SELECT {ENC.format('kmer')} AS enc, cnt FROM k) SELECT ((enc >> 4) % 100)::INT AS part, 2 * count(*) AS n, min(enc) AS first_enc, arg_max(cnt, enc) AS last_cnt FROM e GROUP BY 1",
    "fastq_scan": f"WITH {READS} SELECT seq, count(*) AS n_reads FROM reads GROUP BY 1",
    "fastq_records": f"WITH {READS} SELECT doc_id, line, seq, length(seq) AS n_quality FROM reads",
    "kmer_lookup_file": f"WITH x AS ({_lookup_sql('kmer', 'coalesce(cnt, 0)')}) SELECT row_number() OVER (ORDER BY qid) - 1 AS line, kmer, cnt FROM x",
    "encoded_files": f"WITH {READS} SELECT 3221225472 + length(seq) AS header, seq, count(*) AS n_reads FROM reads GROUP BY 1, 2",
    "encoded_store": f"WITH {READS} SELECT doc_id, line, seq FROM reads",
}
