"""The registered queries of this package: thin uses of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, language, licenses, manifest, mixing, neardup, quality, runs, scoring, substrings, tokens, urls, warc
from .oracles import oracle_sql  # noqa: F401  registered beside the queries
from .texts import remainder, table


def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents").select("doc_id", "text")).drop("text", "spans")


def suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))


def mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    liked = docs.withColumn("preference", mixing.brevity(F.col("size")))
    return mixing.mix(liked, preference="preference").select("doc_id", "size", "source_size", "target", "taken", "copies")


def warc_captures(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages").select("page_id", "url", "html")).select(
        "page_id", "capture.payload_bytes", "capture.payload_digest", "capture.record_type",
        F.col("origin.page_id").alias("refers_to"),
    )


def lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 7) == 2
    scored = scoring.score_texts(docs.withColumn("held_out", held_out), docs.where(~held_out).select("text"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    judged = urls.filter_urls(pages, urls.repeated_keys(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return neardup.link_documents(docs).select("doc_id", "fingerprint", "component_id")


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rules = quality.fit_decision_list(docs, table(spark, folder, "labels"))
    return quality.judge(docs, rules).drop("text")


def benchmark_hits(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = contamination.find_contamination(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def fitted_languages(docs: DataFrame) -> language.Dictionaries:
    """Dictionaries from the documents that are not held out."""
    return language.fit_dictionaries(docs.where(remainder(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang"))


def language_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    judged = language.identify(docs.select("doc_id", "text"), fitted_languages(docs))
    held_out = (remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    return judged.select("doc_id", held_out, "lang_pred", "score", "rejected")


def row_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.verify_documents(table(spark, folder, "documents").select(*manifest.FIELDS))


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.describe_runs(table(spark, folder, "documents").select("doc_id", "text"), plant_by="doc_id")
    return found.drop("text", "n_words")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": license_scan,
        "op2_suffix_dedup": suffix_dedup,
        "op3_mixing": mixture,
        "op4_warc": warc_captures,
        "op5_lm_scores": lm_scores,
        "op6_url_filter": url_verdicts,
        "op7_simhash": simhash_components,
        "op8_quality_rules": quality_rules,
        "op9_contamination": benchmark_hits,
        "op10_language": language_ids,
        "op11_manifest": row_manifest,
        "op12_token_counts": token_counts,
        "op13_periodic_runs": periodic_runs,
    }

