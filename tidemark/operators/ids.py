"""Surrogate ids and vocabularies as dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize


class UnknownIdError(ValueError):
    """An object or id that the dimension doesn't hold."""


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds dense numbers from 0 in the given order without one task sorting all rows.

    Range partitioned and sorted; the offset of a partition is the rows of those before it, one number a partition.
    The sorted rows are written once: sampled range bounds may differ between two runs, and both the offsets and the
    rows must come from the same one.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    local = materialize(ordered.withColumn("__r", F.monotonically_increasing_id() - F.shiftleft(F.col("__p").cast("long"), 33)), "numbered")
    sizes = local.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__o"))
    return local.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__r") + F.col("__o")).drop("__p", "__r", "__o", "__n")


def dictionary(df: DataFrame, column: str, seq: str) -> DataFrame:
    """(obj, id): dense ids from 0 in the order of first arrival. Null objects have none."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("obj")).agg(F.min(seq).alias("first"))
    return numbered(first, ["first", "obj"], "id").select("obj", "id")


def pass_through(df: DataFrame, column: str) -> bool:
    """Whole numbers are their own ids."""
    return isinstance(df.schema[column].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))


def encode(df: DataFrame, column: str, ids: DataFrame, name: str) -> DataFrame:
    """Adds the id of the column's object, null where unknown."""
    return df.join(ids.select(F.col("obj").alias(column), F.col("id").alias(name)), column, "left")


def decode(df: DataFrame, column: str, ids: DataFrame, name: str, default=None) -> DataFrame:
    """Adds the object of the column's id, the default where unknown."""
    out = df.join(ids.select(F.col("id").alias(column), F.col("obj").alias(name)), column, "left")
    return out if default is None else out.withColumn(name, F.coalesce(name, F.lit(default)))


def decode_strict(df: DataFrame, column: str, ids: DataFrame, name: str) -> DataFrame:
    """As decode, but a query fails on an unknown id."""
    out = decode(df, column, ids, name)
    return out.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.concat(F.lit(f"unknown id in {column}: "), F.col(column).cast("string")))).otherwise(F.col(name)))
