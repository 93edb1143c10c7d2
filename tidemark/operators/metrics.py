"""Ranking metrics per query and over all queries.

`ranked` is (user, item, rank) with rank from 1; `truth` is (user, item), repeated items counting each in the size of
the truth. Lists that are empty have no rows: give `users` to have them evaluated as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAMES = ("precision", "recall", "f1", "ndcg", "hit_rate", "mrr", "map", "auc")


def per_query(ranked: DataFrame, truth: DataFrame, k: int, users: DataFrame | None = None) -> DataFrame:
    """(user, n_ranked, n_truth, tp, precision, recall, f1, ndcg, hit, rr, ap, auc) at k."""
    sizes = truth.groupBy("user").agg(F.count(F.lit(1)).alias("n_truth"))
    asked = users.select("user").distinct() if users is not None else sizes.select("user").union(ranked.select("user")).distinct()
    relevant = truth.select("user", "item", F.lit(1).alias("hit")).distinct()
    top = ranked.where(F.col("rank") <= k).select("user", "item", "rank").join(relevant, ["user", "item"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    w = Window.partitionBy("user").orderBy("rank", "item")
    top = top.withColumn("r", F.row_number().over(w)).withColumn("tp_here", F.sum("hit").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    agg = top.groupBy("user").agg(
        F.count(F.lit(1)).alias("n"), F.sum("hit").alias("tp"), F.sum(F.when(F.col("hit") == 1, 1 / F.log2(F.col("r") + 1.0))).alias("dcg"),
        F.min(F.when(F.col("hit") == 1, F.col("r"))).alias("first"), F.sum(F.when(F.col("hit") == 1, F.col("tp_here") / F.col("r"))).alias("ap_sum"),
        F.sum(F.when(F.col("hit") == 0, F.col("tp_here"))).alias("pairs"),
    )
    q = asked.join(sizes, "user", "left").join(agg, "user", "left").na.fill(0, ["n_truth", "n", "tp", "pairs"]).na.fill(0.0, ["dcg", "ap_sum"])
    n, t, tp = F.col("n"), F.col("n_truth"), F.col("tp")
    none = F.when(t == 0, F.when(n == 0, 1.0).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(t, F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    precision = none.when(n == 0, 0.0).otherwise(tp / n)
    recall = F.when(t == 0, F.when(n == 0, 1.0).otherwise(0.0)).otherwise(tp / t)
    q = q.withColumn("precision", precision).withColumn("recall", recall)
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when((t == 0) & (n == 0), 1.0).when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    auc = none.when(tp == 0, 0.0).when(tp == n, 1.0).otherwise(F.col("pairs") / (tp * (n - tp)))
    return q.select(
        "user", n.alias("n_ranked"), t.alias("n_truth"), "tp", "precision", "recall", f1.alias("f1"), F.when(t == 0, 0.0).otherwise(F.col("dcg") / ideal).alias("ndcg"),
        F.when(tp > 0, 1.0).otherwise(0.0).alias("hit"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
        none.otherwise(F.col("ap_sum") / F.least(t, F.lit(k))).alias("ap"), auc.alias("auc"),
    )


def summary(queries: DataFrame) -> DataFrame:
    """One row: the averages of all queries, and tp as a sum; no row without queries."""
    means = {"precision": "precision", "recall": "recall", "f1": "f1", "ndcg": "ndcg", "hit": "hit_rate", "rr": "mrr", "ap": "map", "auc": "auc"}
    out = queries.agg(*(F.avg(c).alias(n) for c, n in means.items()), F.sum("tp").alias("tp"), F.count(F.lit(1)).alias("__n"))
    return out.where("__n > 0").drop("__n")
