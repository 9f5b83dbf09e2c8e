"""The corpus pipeline: quality, exact copies, near copies, source mix, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftlake.llm import exact_dedup, mixing, packing, quality, simhash
from siftlake.llm.common import settle, table, tidy, tidy_executors


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    tidy(spark)
    tidy_executors(spark, workers=True)
    good = quality.keep_good(docs, quality.train_model(docs, table(spark, sf_dir, "labels")))
    tidy_executors(spark, workers=True)  # here, as the next stage runs no Python on executors
    return good


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tidy(spark)
    tidy_executors(spark)
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tidy(spark)
    tidy_executors(spark)
    alone = simhash.drop_near_copies(docs, simhash.NEAR)
    tidy_executors(spark, workers=True)  # here, as the next stage runs no Python on executors
    return alone


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    tidy(spark)
    tidy_executors(spark)
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a sequence, with its ids."""
    tidy(spark)
    tidy_executors(spark)
    return packing.pack(docs, keep_ids=True)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", without_exact_copies),
    ("SimHash near-dedup", without_near_copies),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]

#: A trained network, hash order and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; every stage's result but the last is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
