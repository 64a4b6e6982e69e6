"""From raw documents to token ids: toxicity, line dedup, n-gram Jaccard join, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which run()
writes as Parquet to the shared folder and reads again. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from strandloom.llm._common import cut, table

#: The last stage returns ids, so no SQL expresses the whole; it is tested stage by stage against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.7 or more go; labels serve for learning only."""
    return toxicity.keep_ordinary(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites stay where they stand first. Every row stays: a document of nothing but such lines keeps them.
    n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, spare_emptied=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the one with the smallest doc_id stays."""
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item of benchmark go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, the token ids as bytes, their number, and whether decoding them gives the text again."""
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded="_decoded")
    same = F.sha2("_decoded", 256) == F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "lang", "source", "n_chars", "ids", bpe.n_tokens("ids").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
