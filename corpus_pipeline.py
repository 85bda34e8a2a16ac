"""From raw documents to token ids, in five stages.

Each stage takes all that its predecessor kept, written as Parquet and read again.
All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import decontaminate, lines, ngram_join, pieces, quality
from quadrille.llm.cluster import Shelf

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule on repetition or symbols go; a null or blank text is one that does."""
    return quality.passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur earlier in the corpus go, and n_chars follows; documents left without a line go."""
    return lines.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by similar n-gram sets the one with the smallest id stays."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one, go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return pieces.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir. What is between two stages is kept in the shared folder until the later one is written, the last of it until the session's end."""
    docs, shelf = spark.read.parquet(f"{sf_dir}/documents.parquet"), Shelf(spark)
    before: DataFrame | None = None
    for _, stage in STAGES[:-1]:
        docs = shelf.keep(stage(spark, docs, sf_dir))
        if before is not None:
            shelf.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Rolling hashes aside, alignment, connected components and merges are not for SQL; the tests have each stage's rows by brute force.
ORACLE_SQL: str | None = None
