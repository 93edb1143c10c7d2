"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`, one Parquet file or directory."""
    return spark.read.parquet(table_path(folder, name))
