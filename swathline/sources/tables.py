"""Access to the columnar input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One input table, with the schema that it has now."""
    if name not in NAMES:
        raise ValueError(f"unknown table {name}")
    return spark.read.parquet(f"{folder}/{name}.parquet")
