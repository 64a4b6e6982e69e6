"""The queries opN_<name> over the driver's tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, decontaminate, filter_audit, fingerprints, html_extract, licenses, line_dedup, ngram_join, periodic_runs, pii, secret_scan, token_files, toxicity
from ._common import fresh, table


def op1_ngram_join(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


def op3_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded="decoded")
    return out.select("doc_id", bpe.n_tokens("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_secret_scan(spark, sf_dir):
    out = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, secret_scan.KINDS), F.sha2(secret_scan.spelt("base"), 256).alias("base_sha256"), secret_scan.spelt("spans").alias("spans"))


def op5_html_extract(spark, sf_dir):
    out = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op6_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find(docs, table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    out = toxicity.score(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), usable=remainder != 1)
    return out.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_fingerprint(spark, sf_dir):
    return fingerprints.compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_pii(spark, sf_dir):
    out = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))


def op11_filter_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.filter_audit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


def op12_periodic_runs(spark, sf_dir):
    docs = periodic_runs.with_periodic_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = periodic_runs.find_runs(docs).select("doc_id", F.col("periodic.runs").alias("runs"), F.col("periodic.collapsed").alias("collapsed"))
    lines, best = F.concat(periodic_runs.spelt("runs"), F.when(F.size("runs") > 0, "\n").otherwise("")), periodic_runs.strongest(F.col("runs"))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    run = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    return out.select("doc_id", "n_runs", *run, F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_token_files(spark, sf_dir):
    path, docs = fresh(spark, "token-files"), table(spark, sf_dir, "documents").select("doc_id", "text")
    token_files.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_line_dedup, op3_bpe, op4_secret_scan, op5_html_extract, op6_decontaminate, op7_license_scan, op8_toxicity, op9_fingerprint, op10_pii, op11_filter_audit, op12_periodic_runs, op13_token_files)}
ORACLE_SQL = {"op2_line_dedup": line_dedup.ORACLE, "op6_decontaminate": decontaminate.ORACLE, "op7_license_scan": licenses.ORACLE, "op11_filter_audit": filter_audit.ORACLE}
