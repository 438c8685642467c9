"""The corpus pipeline: STAGES, each over all rows that the one before kept.

Every stage but the last returns the columns of documents, whatever further columns these have and whatever their
names. Edge cases, for all stages: no rows give no rows (``mixed`` and ``sharded`` included); a null language or source
is a value of its own; a null, empty or blank text has no words, so it is scored by the classifier's biases, has no
near-duplicates, isn't contaminated and is taken once by the mix; rows without doc_id are never near-duplicates, and
the mix takes them once; repeated rows (equal in doc_id and text) are one document for near-duplicates, and one of
them stays; very long texts are taken whole. Without labels nothing is toxic; without benchmark nothing is contaminated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import decontaminate, hilbert, mixing, near_dups, toxicity
from panelspark.llm.common import fresh_dir, remove_dir, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose score reaches their language's threshold; the classifier is fitted on the labels."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest id."""
    return near_dups.drop_near_duplicates(docs, width=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the contamination rule rejects."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.apply_mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document."""
    return hilbert.shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]
ORACLE_SQL = None  # neither a trained classifier nor a knapsack can be put in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written to the shared folder, read again, and removed once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        where = fresh_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
        if before:
            remove_dir(spark, before)
        before = where
    return STAGES[-1][1](spark, docs, sf_dir)
