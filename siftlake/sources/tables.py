"""Scans of the standard tables, as DataFrames or as views for SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str, args: dict | None = None) -> DataFrame:
    """Spark SQL over views of the tables that the text names; values are bound, never formatted in."""
    for name in NAMES:
        if re.search(rf"\b{name}\b", text):
            scan(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text, args=args) if args else spark.sql(text)
