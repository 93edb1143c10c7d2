"""Score normalisation, rank fusion and top k. A scored list is (user, item, score); ties go to the smaller item."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import contact_weight


def top_k(scored: DataFrame, k: int, by: str = "user", item: str = "item", score: str = "score") -> DataFrame:
    """The k best rows of each group with their rank from 1."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(item))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def min_max(scored: DataFrame, by: str = "user") -> DataFrame:
    """Scores as (s - min) / (max - min + 1e-8) within each group."""
    w = Window.partitionBy(by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scored.withColumn("score", (F.col("score") - low) / (high - low + 1e-8))


def rank_scores(ranked: DataFrame, by: str = "user") -> DataFrame:
    """score = 1 - place / (n - 1) of ranked(user, item, rank), 1 for a single item."""
    w = Window.partitionBy(by)
    n = F.count(F.lit(1)).over(w)
    place = F.row_number().over(w.orderBy("rank", "item")) - 1
    return ranked.withColumn("score", F.when(n > 1, 1 - place / (n - 1)).otherwise(1.0))


def _stacked(lists: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [x.select("user", "item", "score") for x in lists])


def comb_sum(lists: Sequence[DataFrame]) -> DataFrame:
    return _stacked(lists).groupBy("user", "item").agg(F.sum("score").alias("score"))


def comb_mnz(lists: Sequence[DataFrame]) -> DataFrame:
    """Sum of scores times the number of lists that hold the item."""
    return _stacked(lists).groupBy("user", "item").agg((F.sum("score") * F.count(F.lit(1))).alias("score"))


def weighted_borda(rankings: Sequence[DataFrame], weights: Sequence[float]) -> DataFrame:
    if len(rankings) != len(weights):
        raise ValueError("as many weights as rankings are needed")
    return comb_sum([rank_scores(r).withColumn("score", F.col("score") * F.lit(float(w))) for r, w in zip(rankings, weights)])


def ensemble(fm: DataFrame, linear: DataFrame, contacts: DataFrame, k: int, similarity_weight: float = 2.0) -> DataFrame:
    """The k best of minmax(fm) + w(contacts) minmax(linear), w by the contacts of the user with the item itself."""
    a, b = min_max(fm), min_max(linear)
    weighted = b.join(contacts.select("user", "item", "contacts"), ["user", "item"], "left")
    weighted = weighted.withColumn("score", F.col("score") * contact_weight(F.coalesce("contacts", F.lit(0)), k=similarity_weight))
    return top_k(comb_sum([a, weighted]), k)


def exclude_seen(scored: DataFrame, state: DataFrame) -> DataFrame:
    return scored.join(state.select("user", "item"), ["user", "item"], "left_anti")


def restrict(scored: DataFrame, candidates: DataFrame | None, known: DataFrame) -> DataFrame:
    """Rows of candidate items; no restriction if there are none or none of them is known(item)."""
    if candidates is None:
        return scored
    usable = candidates.select("item").distinct().join(known.select("item").distinct(), "item", "left_semi")
    return scored if usable.isEmpty() else scored.join(usable, "item", "left_semi")


def intersect_ranked(hot: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The first k of hot(item, rank) that are candidates, in order: (item, rank)."""
    both = hot.join(candidates.select("item").distinct(), "item", "left_semi")
    return both.select("item", F.row_number().over(Window.orderBy("rank")).alias("rank")).where(F.col("rank") <= k)
