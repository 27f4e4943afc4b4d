"""File listings as tables, and JDBC access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_sizes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path and length of the files below a folder; the content column is never read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path", "length")
    )


def footprint(files: DataFrame, prefix: int = 1) -> DataFrame:
    """Bytes and files per folder, ``prefix`` levels above the file."""
    folder = F.substring_index(F.col("path"), "/", -(prefix + 1))
    return files.groupBy(F.substring_index(folder, "/", 1).alias("folder")).agg(
        F.sum("length").alias("bytes"), F.count("*").alias("files")
    )


def read_jdbc(spark: SparkSession, url: str, query: str, properties: dict[str, str], split: dict | None = None) -> DataFrame:
    """A pushed-down query over JDBC; ``split`` (column, lower, upper, parts) reads in parallel."""
    source = f"({query}) as t"
    if split:
        return spark.read.jdbc(
            url, source, column=split["column"], lowerBound=split["lower"], upperBound=split["upper"],
            numPartitions=split["parts"], properties=properties,
        )
    return spark.read.jdbc(url, source, properties=properties)


def append_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str], writers: int = 4) -> None:
    """Append rows over ``writers`` connections; what makes the rows keeps its own number of tasks."""
    df.repartition(writers).write.jdbc(url, table, mode="append", properties=properties)
