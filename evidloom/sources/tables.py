"""Readers for the Parquet tables of a data folder."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidloom.bounds import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Only the columns a text job needs, over all cores when the file has few splits."""
    return spread(table(spark, folder, name).select(*columns))
