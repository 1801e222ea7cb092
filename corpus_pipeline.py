"""From raw documents to token ids: five stages, each over all that the stage before it kept.

Each stage's result is written as Parquet to the shared folder and read again, so that a lost executor never costs
more than a stage; then what the stage itself wrote, and the result before, are deleted. All stages but the last return the columns of ``documents``.

Defined cases, beside those of the operators' modules: a null or empty text fails the quality rules and goes; repeated rows
are near duplicates, of which one stays; rows of one id stay apart by their texts; a null source is a source of its own; a
table without labels keeps all texts with letters; texts of any length go through whole; columns of any name pass through;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clauseworks.llm import bpe, language, mixing, near_duplicates, quality
from clauseworks.llm.common import drop_since, drop_written, table, vocabulary_file, written, written_so_far


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules themselves, from hosts that pass."""
    return quality.kept(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that are learned; those in others, or without letters, go."""
    return language.known_language(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near duplicates."""
    return near_duplicates.one_of_each(docs)


def fair_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document."""
    return mixing.mixed(docs)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.digests(docs, vocabulary_file("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("fair_mix", fair_mix),
    ("bpe_round_trip", bpe_round_trip),
]

#: SQL can't express language identification or byte-level BPE; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    *before, (_, last) = STAGES
    for i, (name, stage) in enumerate(before):
        mark = written_so_far()
        kept = written(stage(spark, docs, sf_dir), name)
        drop_since(spark, mark, kept)
        if i:
            drop_written(docs)
        docs = kept
    return last(spark, docs, sf_dir)
