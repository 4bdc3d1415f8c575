"""The corpus pipeline: five stages over the documents, each the whole of what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atrium.llm import jaccard, language, lines, mixing, segmentations
from atrium.llm.common import materialise, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or with no language in most of their letters, go."""
    return language.keep_identified(docs, language.learn(docs))


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents that hold nothing else."""
    return lines.drop_repeated_lines(docs)


def dedupe_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with similar word shingles the smallest doc_id stays."""
    return jaccard.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each pass over a document."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of each text, ready to train on."""
    return segmentations.sample_segmentations(docs, keep=("doc_id", "lang", "source", "n_chars"))


STAGES = [
    ("language", identify_language),
    ("lines", dedupe_lines),
    ("near_duplicates", dedupe_documents),
    ("mix", mix_sources),
    ("segmentations", encode),
]

#: SQL can express neither the language model nor the sampler: the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
