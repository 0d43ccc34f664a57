"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import leaks, licenses, lines, packing, quality, secrets, similar, spans, syncmers, urls
from .common import read
from .oracles import ORACLE_SQL  # noqa: F401


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item found in it; clean documents have none."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks.find_leaks(docs, read(spark, sf_dir, "benchmark"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = syncmers.fingerprint_documents(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        syncmers.as_string(F.col("print")).alias("fingerprint"),
        syncmers.as_string(F.col("edited_print")).alias("edited_fingerprint"),
        syncmers.likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        syncmers.likeness(F.col("print"), F.col("next_print")).alias("near_next"),
        # Positional matching: of the anchors that both have, the share that stands at the same place.
        syncmers.aligned(F.col("print"), F.col("edited_print")).alias("aligned_edited"),
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).drop("text")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = spans.drop_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    n = lambda test: F.size(F.filter("spans", test)).cast("long")
    named = lambda k: lambda s: s["name"] == k
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id",
        *[F.size(F.filter("spans", named(k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
        n(lambda s: s["verdict"] == "live").alias("n_live"),
        n(lambda s: s["verdict"] == "example").alias("n_example"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["owners"])), F.lit(0)).alias("most_owners"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["repositories"])), F.lit(0)).alias("most_repositories"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_shared_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents kept, with their evidence, their site's and the joint probability of being bad."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    judged = quality.classify(docs, read(spark, sf_dir, "labels"))
    return judged.where("keep").select("doc_id", "source", "lang", "evidence", "site", "p_bad")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "n_links", "component_id")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_fingerprints, op3_url_filters, op4_license_scan, op5_substring_dedup, op6_packing, op7_secret_scan, op8_line_dedup, op9_quality, op10_jaccard_join)}
