"""A training-corpus pipeline of five stages over documents: each works on all that the one before kept, and its decisions take effect.

Every stage stands nulls in any column, empty and very long texts, repeated rows, empty tables and extra columns, and says what becomes of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetframe.llm import decontam, minhash, mixing, pii, toxicity
from fleetframe.llm.scratch import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score one half or more against the labelled examples go. Null and empty texts score as texts without a known word do: the share of
    toxic labels. Rows with equal texts, repeated ones too, go or stay together."""
    index = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, index)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more; the one with the smallest doc_id. Texts without
    words and rows without doc_id stay; of rows that repeat a doc_id one stays."""
    return minhash.one_of_each(docs, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts stay; rows with equal texts go or stay together; an empty benchmark keeps all."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets. All rows stay; null texts stay null, empty ones empty."""
    return pii.masked(docs, pii.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the proportions of their weights; adds epoch and n_words, in place of columns of these names. A null source is one of its own; texts
    without words give no row, and repeated rows their share each."""
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
]

#: Votes of neighbours and the random field have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet and read again by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
