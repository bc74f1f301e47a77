"""Tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A CSV file with a header; without a schema all columns are strings."""
    r = spark.read.option("header", True)
    return (r.schema(schema) if schema is not None else r).csv(path)
