"""Splits into train and test rows, and the n-core filter. Ties in time are ordered by seq."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ids import numbered


def leave_last_out(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test): each user's last row is the test row."""
    w = Window.partitionBy("user").orderBy(F.desc("tstamp"), F.desc("seq"))
    ranked = df.withColumn("__r", F.row_number().over(w))
    return ranked.where("__r > 1").drop("__r"), ranked.where("__r = 1").drop("__r")


def temporal(df: DataFrame, test_frac: float = 0.2, timestamp: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test): before and from a timestamp on, or the first int((1 - test_frac) n) rows by time and the rest."""
    if timestamp is not None:
        return df.where(F.col("tstamp") < timestamp), df.where(F.col("tstamp") >= timestamp)
    cut = int((1 - test_frac) * df.count())
    placed = numbered(df, ["tstamp", "seq"], "__r")
    return placed.where(F.col("__r") < cut).drop("__r"), placed.where(F.col("__r") >= cut).drop("__r")


def temporal_by_user(df: DataFrame, test_frac: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(train, test): of each user's n rows by time the first int((1 - test_frac) n), and the rest."""
    w = Window.partitionBy("user").orderBy("tstamp", "seq")
    n = F.count(F.lit(1)).over(Window.partitionBy("user"))
    placed = df.withColumn("__train", F.row_number().over(w) - 1 < F.floor(F.lit(1 - test_frac) * n))
    return placed.where("__train").drop("__train"), placed.where("not __train").drop("__train")


def random(df: DataFrame, test_frac: float = 0.2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test): exactly int(test_frac n) test rows, drawn by a hash of seq and seed."""
    cut = int(test_frac * df.count())
    placed = numbered(df.withColumn("__h", F.xxhash64(F.lit(seed), "seq")), ["__h", "seq"], "__r").drop("__h")
    return placed.where(F.col("__r") >= cut).drop("__r"), placed.where(F.col("__r") < cut).drop("__r")


def sample(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """The rows whose hash of seq and seed falls into the fraction; the same rows however they are partitioned."""
    if not 0 <= fraction <= 1:
        raise ValueError("the fraction lies between 0 and 1")
    parts = 1 << 32
    return df.where(F.pmod(F.xxhash64(F.lit(seed), "seq"), F.lit(parts)) < int(fraction * parts))


def n_core(df: DataFrame, columns: Sequence[str], min_count: int = 10) -> DataFrame:
    """Rows of which any listed column's value occurs at least min_count times; one pass, nulls don't count.

    The frequent values are found with partial aggregation and joined back, so that a frequent value isn't gathered.
    """
    out, hits = df, []
    for i, c in enumerate(columns):
        often = df.where(F.col(c).isNotNull()).groupBy(c).count().where(F.col("count") >= min_count).select(c, F.lit(True).alias(f"__ok{i}"))
        out = out.join(often, c, "left")
        hits.append(F.coalesce(F.col(f"__ok{i}"), F.lit(False)))
    keep = F.greatest(*hits) if len(hits) > 1 else hits[0]
    return out.where(keep).select(*df.columns)
