"""The operators' queries over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from clauseworks.llm import bpe, html_text, language, licenses, mixing, near_duplicates, nearest, quality, repeats, resampling, sessions, token_files, url_filter
from clauseworks.llm.common import table, vocabulary_file


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_file("byte_bpe_50k.json"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.documents_with_components(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


def op6_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_file("byte_bpe_50k.json"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"))


def op9_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))


def op12_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions(table(spark, sf_dir, "clicks", "click_id", "ts", "arrived_at", "client_id", "kind", "value"))


def op13_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_html_text,
        op3_token_files,
        op4_nearest,
        op5_ngram_jaccard,
        op6_host_quality,
        op7_bpe_round_trip,
        op8_url_filter,
        op9_fair_mix,
        op10_license_scan,
        op11_resampling,
        op12_sessions,
        op13_suffix_repeats,
    )
} | {"pipeline": corpus_pipeline.run}
ORACLES = {"op6_host_quality": quality.SQL, "op8_url_filter": url_filter.SQL, "op9_fair_mix": mixing.SQL, "op11_resampling": resampling.SQL, "op12_sessions": sessions.SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
