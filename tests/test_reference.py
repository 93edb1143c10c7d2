"""Operators of the recommendation engine: brute force, golden values and defined edges."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.models import factors, linear
from tidemark.models.solvers import elastic_net, elastic_net_columns, elastic_net_sgd
from tidemark.operators import interactions as ops
from tidemark.operators import metrics, ranking, shared, splits, tags
from tidemark.operators.gram import gram, nearest_items, neighbours
from tidemark.operators.ids import dictionary, numbered

SCHEMA = "user long, item long, tstamp double, rating double, seq long"


def sequential(data, config, state=None, clock=None):
    """The fold, one row after another."""
    out, clk = dict(state or {}), clock or -math.inf
    for u, i, t, r, _ in sorted(data, key=lambda x: x[4]):
        clk = max(clk, t + 1)
        v, last = out.get((u, i), (0.0, None))
        if last is not None and config.rate is not None:
            v *= config.rate ** ((clk - last) / 86400)
        out[u, i] = (min(max(v + r, config.min_value), config.max_value), t)
    return out


def folded(df):
    return {(r["user"], r["item"]): (r["value"], r["tstamp"]) for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == pytest.approx(b[k][0], abs=1e-9) and a[k][1] == b[k][1]


@pytest.mark.parametrize("chunk", [3, 50, 10**6])
@pytest.mark.parametrize("days", [None, 7.0])
def test_fold_equals_sequential(spark, monkeypatch, chunk, days):
    monkeypatch.setattr(ops, "CHUNK", chunk)
    rng = random.Random(4)
    data = [(rng.choice([1, 1, 1, 2]), rng.choice([1, 2]), rng.uniform(0, 30 * 86400), rng.uniform(-6, 9), i) for i in range(200)]
    config = ops.StateConfig(decay_in_days=days)
    close(folded(ops.fold(spark.createDataFrame(data, SCHEMA), config)), sequential(data, config))


def test_fold_golden(spark):
    day = 86400.0
    data = [(1, 10, 0.0, 5.0, 0), (2, 10, 3 * day, 4.0, 1), (1, 10, 2 * day, 8.0, 2), (1, 10, 9 * day, -3.0, 3), (2, 20, 9 * day, -9.0, 4)]
    got = folded(ops.fold(spark.createDataFrame([(u, i, t, r, s) for u, i, t, r, s in data], SCHEMA), ops.StateConfig(decay_in_days=7)))
    assert got[2, 10][0] == 4.0 and got[2, 20][0] == -5.0
    assert got[1, 10][0] == pytest.approx(sequential(data, ops.StateConfig(decay_in_days=7))[1, 10][0])


def test_upsert_popularity_and_lookups(spark, rows):
    data = [(1, 1, 1.0, 5.0, 0), (1, 1, 0.5, 20.0, 1), (1, 2, 2.0, -1.0, 2), (2, 2, 3.0, 1.0, 3), (2, 3, 4.0, 1.0, 4)]
    df = spark.createDataFrame(data, SCHEMA)
    state = ops.upsert(df)
    assert rows(state) == [(1, 1, 20.0, 0.5), (1, 2, -1.0, 2.0), (2, 2, 1.0, 3.0), (2, 3, 1.0, 4.0)]
    assert rows(ops.hot_items(ops.popularity(df), 2)) == [(1, 2, 1), (2, 1, 2)]
    users = spark.createDataFrame([(1,), (2,)], "user long")
    assert rows(ops.hot_items_for(state, ops.popularity(df), users, 5)) == [(1, 3, 1), (2, 1, 1)]
    assert rows(ops.non_interacted(state, users)) == [(1, 3), (2, 1)]
    assert rows(ops.non_negative(state, users, ops.StateConfig(), 5.0)) == [(1, 1), (1, 3), (2, 1), (2, 2), (2, 3)]
    assert rows(ops.recent_items(state, 1).select("user", "item")) == [(1, 2), (2, 3)]
    assert ops.matrix(state, users=users.where("false")).count() == 0 and ops.matrix(state).count() == 4


def test_validation_and_schema(spark):
    with pytest.raises(ValueError):
        ops.standard(spark.createDataFrame([(1,)], "user long"))
    with pytest.raises(ValueError):
        ops.StateConfig(min_value=1, max_value=1)
    good, bad = ops.split_valid(spark.createDataFrame([(1, 1, 1.0, float("nan"), 0), (1, None, 1.0, 1.0, 1), (1, 1, 1.0, 1.0, 2)], SCHEMA))
    assert good.count() == 1 and bad.count() == 2


def test_empty_interactions(spark):
    df = spark.createDataFrame([], SCHEMA)
    for out in (ops.fold(df), ops.fold(df, ops.StateConfig(decay_in_days=1.0)), ops.upsert(df), ops.popularity(df), gram(df.select("user", "item", F.col("rating").alias("weight"))), *splits.temporal(df), *splits.leave_last_out(df), *splits.temporal_by_user(df)):
        assert out.count() == 0
    assert ops.clock(df) is None


# -- metrics: golden values -------------------------------------------------------------------------------------------


def measured(spark, ranked, truth, k):
    r = spark.createDataFrame([(1, x, n + 1) for n, x in enumerate(ranked)], "user long, item long, rank int")
    t = spark.createDataFrame([(1, x) for x in truth], "user long, item long")
    return metrics.per_query(r, t, k, spark.createDataFrame([(1,)], "user long")).first()


def test_metric_goldens(spark):
    m = measured(spark, [1, 3, 2, 6], [1, 2, 4], 4)
    assert m["ndcg"] == pytest.approx(0.7039, rel=1e-4) and m["ap"] == pytest.approx((1 + 2 / 3) / 3) and m["auc"] == 0.75
    assert (m["precision"], m["recall"], m["tp"], m["hit"], m["rr"]) == (0.5, pytest.approx(2 / 3), 2, 1.0, 1.0)


@pytest.mark.parametrize("ranked, truth, want", [([], [], (1, 1, 1, 0, 0, 0, 1, 1)), ([1], [], (0, 0, 0, 0, 0, 0, 0, 0)), ([], [1], (0, 0, 0, 0, 0, 0, 0, 0)), ([1, 2], [1, 2], (1, 1, 1, 1, 1, 1, 1, 1)), ([3, 4], [1], (0, 0, 0, 0, 0, 0, 0, 0))])
def test_metric_edges(spark, ranked, truth, want):
    m = measured(spark, ranked, truth, 10)
    assert tuple(float(m[c]) for c in ("precision", "recall", "f1", "ndcg", "hit", "rr", "ap", "auc")) == pytest.approx(want)


def test_summary_without_queries(spark):
    none = spark.createDataFrame([], "user long, item long, rank int")
    assert metrics.summary(metrics.per_query(none, none.select("user", "item"), 5)).count() == 0


# -- ranking, ids, tags, splits -----------------------------------------------------------------------------------------


def test_fusion(spark, rows):
    a = spark.createDataFrame([(1, 1, 3.0), (1, 2, 1.0)], "user long, item long, score double")
    b = spark.createDataFrame([(1, 2, 5.0), (1, 3, 5.0)], "user long, item long, score double")
    assert [r[2] for r in rows(ranking.min_max(a))] == [pytest.approx(1.0), 0.0]
    assert rows(ranking.comb_sum([a, b])) == [(1, 1, 3.0), (1, 2, 6.0), (1, 3, 5.0)]
    assert rows(ranking.comb_mnz([a, b])) == [(1, 1, 3.0), (1, 2, 12.0), (1, 3, 5.0)]
    r = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (1, 9, 3)], "user long, item long, rank int")
    assert rows(ranking.weighted_borda([r, r.where("item = 9")], [0.5, 2.0])) == [(1, 7, 0.5), (1, 8, 0.25), (1, 9, 2.0)]
    with pytest.raises(ValueError):
        ranking.weighted_borda([r], [1.0, 2.0])
    contacts = spark.createDataFrame([(1, 2, 2)], "user long, item long, contacts long")
    got = {x[1]: x[2] for x in rows(ranking.ensemble(a, b, contacts, 5).select("user", "item", "score"))}
    assert got == {1: pytest.approx(1.0), 2: 0.0, 3: 0.0}
    assert ranking.top_k(a.where("false"), 3).count() == 0


def test_candidates_of_unknown_items_restrict_nothing(spark):
    a = spark.createDataFrame([(1, 1, 3.0)], "user long, item long, score double")
    unknown = spark.createDataFrame([(99,)], "item long")
    assert ranking.restrict(a, unknown, a).count() == 1 and ranking.restrict(a, a.select("item"), a).count() == 1


def test_numbering_is_dense_and_ordered(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"))
    assert [r["n"] for r in numbered(df, ["x"], "n").orderBy("x").collect()] == list(range(1000))
    ids = dictionary(spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 0)], "o string, seq long"), "o", "seq")
    assert {r["obj"]: r["id"] for r in ids.collect()} == {"b": 0, "a": 1}


def test_tags(spark, rows):
    stored = spark.createDataFrame([(1, ["x", "y"]), (2, ["y"])], "entity long, tags array<string>")
    new = spark.createDataFrame([(1, ["z", "x"])], "entity long, tags array<string>")
    assert rows(tags.put(stored, new)) == [(1, ["z", "x"]), (2, ["y"])]
    assert rows(tags.put(stored, new, append=True)) == [(1, ["x", "y", "z"]), (2, ["y"])]
    vocab = tags.vocabulary(stored)
    assert rows(vocab) == [("x", 0), ("y", 1)] and tags.clear(stored).count() == 0
    assert rows(tags.multi_hot(spark.createDataFrame([(5, ["y", "y", "unknown"])], "entity long, tags array<string>"), vocab)) == [(5, 1, 2.0)]
    assert rows(tags.cold_features(stored, spark.createDataFrame([("tag:y",)], "feature string"))) == [(1, "tag:y", 1.0), (2, "tag:y", 1.0)]


def test_splits(spark):
    df = spark.createDataFrame([(u, i, float(i % 5), 1.0, u * 100 + i) for u in (1, 2, 3) for i in range(u * 4)], SCHEMA)
    n = df.count()
    for train, test, want in ((*splits.temporal(df, 0.25), n - int(0.75 * n)), (*splits.random(df, 0.3, 1), int(0.3 * n)), (*splits.leave_last_out(df), 3)):
        assert test.count() == want and train.count() == n - want
    train, test = splits.temporal_by_user(df, 0.5)
    assert {r["user"]: r["count"] for r in train.groupBy("user").count().collect()} == {1: 2, 2: 4, 3: 6}
    assert splits.random(df, 0.3, 1)[1].subtract(splits.random(df, 0.3, 1)[1]).count() == 0
    assert splits.n_core(df, ["user", "item"], 12).count() == 12
    many = spark.range(20_000).withColumnRenamed("id", "seq")
    some = splits.sample(many, 0.1, 3)
    assert 1800 < some.count() < 2200 and some.subtract(splits.sample(many.repartition(7), 0.1, 3)).count() == 0
    assert splits.sample(many, 0.0).count() == 0 and splits.sample(many, 1.0).count() == 20_000


def test_scalars(spark):
    one = spark.range(1)
    got = one.select(
        S.sigmoid(F.lit(1e9)).alias("a"), S.hour_period(F.lit(13)).alias("b"), S.hour_period(F.lit(24)).alias("c"), S.age_bin(F.lit(-1)).alias("d"), S.hex_to_id(F.lit("00ffffffffffffffff")).alias("e"),
        S.property_tags(F.lit("790"), F.lit("12 n5.0 ab")).alias("f"), S.property_tags(F.lit("available"), F.lit("1")).alias("g"), S.one_hot_names(["id"]).alias("h"), S.contact_weight(F.lit(2)).alias("i"),
        S.tag("age", F.lit(None).cast("string"), "unknown").alias("j"), *(c.alias(n) for c, n in zip(S.title_year(F.lit("Kettle, The (1960)")), "kl")),
    ).first()
    assert got["a"] <= 1 and tuple(got)[1:] == ("noon", "unknown", "invalid", (1 << 63) - 1, ["790#12", "790#ab"], [], "", 1.0, "age#unknown", "The Kettle", 1960)
    assert dict(S.downcast(spark.createDataFrame([(1, 70000)], "a long, b long")).dtypes) == {"a": "tinyint", "b": "int"}


# -- models -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [2, 512])
def test_gram_by_blocks(spark, block):
    rng = np.random.default_rng(0)
    dense = rng.integers(0, 3, (6, 9)).astype(float)
    x = spark.createDataFrame([(u, i, float(dense[u, i])) for u in range(6) for i in range(9) if dense[u, i]], "user long, item long, weight double")
    got = np.zeros((9, 9))
    for r in gram(x, block).collect():
        assert got[r["i"], r["j"]] == 0
        got[r["i"], r["j"]] = r["g"]
    assert np.allclose(got, dense.T @ dense)
    near = neighbours(gram(x), 3)
    assert near.where("src = dst").count() == 0 and near.groupBy("dst").count().agg(F.max("count")).first()[0] <= 3


@pytest.mark.parametrize("sizes", [{}, {"PART": 50, "FETCH": 10, "CHUNK": 7, "KEEP": 1}])
def test_nearest_items_equal_neighbours_without_writing_products(spark, rows, monkeypatch, sizes):
    rng = np.random.default_rng(3)
    many = [rng.integers(-2, 5, 4).astype(float), rng.random(1000)][bool(sizes)]
    data = [(u, f"i{i}", float(rng.choice(many))) for u in range(60) for i in range(40) if rng.random() < 0.2] + [(None, "i1", 1.0), (3, None, 1.0), (99, "i77", None), (98, "alone", 1.0)]
    x = spark.createDataFrame(data, "user long, item string, weight double")
    for name, value in sizes.items():
        monkeypatch.setattr(shared, name, value)
    want = rows(neighbours(gram(x).withColumn("g", F.round("g", 6)), 5).select("dst", "src", "g", "rank"))
    monkeypatch.setattr("tidemark.operators.gram.gram_half", None)  # the products of pairs are not a table
    assert rows(nearest_items(x, 5, 6)) == want and want
    assert nearest_items(x.where("false"), 5).count() == 0


@pytest.mark.parametrize("solve", [elastic_net, elastic_net_sgd])
def test_solver_meets_optimality_conditions(solve):
    rng = np.random.default_rng(1)
    x, n, alpha, l1 = rng.random((40, 6)), 40, 0.05, 0.5
    y = x @ np.array([0.8, 0, 0.3, 0, 0, 0.1]) + 0.01 * rng.random(40)
    g, t = (x.T @ x)[None], (x.T @ y)[None]
    w = solve(g, t, n, alpha, l1, True, 5000, tol=1e-10)[0]
    slope = (t[0] - g[0] @ w) / n - alpha * (1 - l1) * w
    assert np.all(slope[w == 0] <= alpha * l1 + 1e-3) and np.allclose(slope[w > 0], alpha * l1, atol=1e-3)


def test_solver_on_columns_equals_solver_on_products():
    rng = np.random.default_rng(2)
    x = rng.random((30, 12)) * (rng.random((30, 12)) < 0.4)
    for positive in (True, False):
        g = x[:, 1:].T @ x[:, 1:]
        want = elastic_net(g[None], (x[:, 1:].T @ x[:, 0])[None], 30, 0.01, 0.3, positive, 3000, tol=1e-12)[0]
        columns = [(np.flatnonzero(c), c[c != 0]) for c in x.T]
        got = elastic_net_columns(columns[1:], columns[0], 30, 0.01, 0.3, positive, 3000, tol=1e-12)
        assert np.allclose(got, want, atol=1e-8) and got.any()


@pytest.mark.parametrize("n, dense", [(None, 10**6), (None, 2), (4, 10**6)])
def test_linear_by_shared_matrix_equals_tables(spark, monkeypatch, n, dense):
    rng = np.random.default_rng(6)
    data = [(int(u), f"i{i}", float(rng.normal(1, 2))) for u in range(40) for i in range(15) if rng.random() < 0.3] + [(None, "i1", 1.0), (3, None, 1.0), (99, "i77", None)]
    x = spark.createDataFrame(data, "user long, item string, weight double")
    config = linear.LinearConfig(alpha=0.01, neighbours=n, tol=1e-10, max_iter=2000)
    weights = lambda df: {(r["src"], r["dst"]): r["weight"] for r in df.collect()}
    want = weights(linear._fit_by_tables(x.dropna(), linear.LinearConfig(alpha=0.01, neighbours=n or 1000, tol=1e-10, max_iter=2000), 41, None))
    monkeypatch.setattr(linear, "DENSE", dense)
    got = weights(linear.fit(x, config, 41))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-7) for k in got)
    some = spark.createDataFrame([("i1",), ("i3",), ("nowhere",)], "item string")
    assert weights(linear.fit(x, config, 41, some)) == {k: v for k, v in got.items() if k[1] in ("i1", "i3")}
    monkeypatch.setattr(linear, "SHARED_ENTRIES", 5)
    if n is None:
        with pytest.raises(ValueError):
            linear.fit(x, config, 41)
    else:
        assert weights(linear.fit(x, config, 41)).keys() == got.keys()
    assert linear.fit(x.where("false"), config).count() == 0


@pytest.mark.parametrize("hot, block", [(4, 4_000_000), (0, 60)])
def test_large_linear_fit_writes_no_products(spark, monkeypatch, hot, block):
    rng = np.random.default_rng(8)
    data = [(int(u), int(i), float(rng.integers(0, 5))) for u in range(60) for i in range(18) if rng.random() < 0.5 / (1 + i % 6)]
    x = spark.createDataFrame(data, "user long, item long, weight double")
    config = linear.LinearConfig(alpha=0.05, neighbours=5, tol=1e-11, max_iter=3000)
    weights = lambda df: {(r["src"], r["dst"]): r["weight"] for r in df.collect()}
    want = weights(linear.fit(x, config, 60))
    monkeypatch.setattr(linear, "SHARED_ENTRIES", 5)
    monkeypatch.setattr(linear, "HOT", hot)
    monkeypatch.setattr(linear, "BATCH_NUMBERS", block)
    for f in ("gram_half", "both_orders", "neighbours"):  # the ways that write a row for every pair of items
        monkeypatch.setattr(linear, f, None, raising=False)
    sim = linear.fit(x, config, 60)
    got = weights(sim)
    assert got.keys() == want.keys() and len(got) > 30 and all(got[k] == pytest.approx(want[k], abs=1e-7) for k in got)
    off = {r["dst"]: r["violation"] for r in linear.violations(x, sim, config, 60).collect()}
    assert len(off) == 18 and max(off.values()) < 1e-4
    other = sim.withColumn("weight", F.when(F.col("dst") == 3, F.col("weight") * 2).otherwise(F.col("weight")))
    assert {r["dst"] for r in linear.violations(x, other, config, 60).where("violation > 0.1").collect()} == {3}
    assert weights(linear.fit(x, linear.LinearConfig(alpha=50.0, neighbours=5), 60)) == {}


def test_judging_a_large_fit_makes_no_products_again(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = [(int(u), int(i), float(rng.integers(1, 5))) for u in range(40) for i in range(12) if rng.random() < 0.5] + [(50, 70, 3.0), (51, 0, 0.5), (51, 71, 0.01)]
    x = spark.createDataFrame(data, "user long, item long, weight double")
    config = linear.LinearConfig(alpha=0.05, neighbours=5, tol=1e-11, max_iter=3000)
    monkeypatch.setattr(linear, "SHARED_ENTRIES", 5)
    passes, jobs = [], linear._nearest_jobs
    monkeypatch.setattr(linear, "_nearest_jobs", lambda *given: passes.append(1) or jobs(*given))
    matrix = linear.LargeMatrix(x)
    sim = linear.fit(x, config, 60, matrix=matrix).cache()
    off = lambda sim, matrix: {r["dst"]: round(r["violation"], 3) for r in linear.violations(x, sim, config, 60, matrix).collect()}
    # 70 has no neighbour; the product of 71 can't reach the penalty
    assert off(sim, matrix) == dict.fromkeys([*range(12), 71], 0.0) and len(passes) == 1
    # weights that are missing, or where there should be none
    less = off(sim.where("dst <> 3"), matrix)
    assert {d for d, v in less.items() if v} == {3} and less == off(sim.where("dst <> 3"), None)
    more = off(sim.union(spark.createDataFrame([(0, 71, 0.5)], sim.schema)), matrix)
    assert {d for d, v in more.items() if v} == {71}
    matrix.discard()


@pytest.mark.parametrize("options", [{}, {"exclude_seen": False}, {"pad_zero": True}, {"pad_zero": True, "exclude_seen": False}, {"candidates": [2, 3, 77]}, {"candidates": [77]}])
def test_recommend_by_shared_weights_equals_join(spark, rows, monkeypatch, options):
    rng = np.random.default_rng(8)
    x = spark.createDataFrame([(u, i, float(rng.integers(1, 6))) for u in range(12) for i in range(14) if rng.random() < 0.3] + [(5, 60, 2.0)], "user long, item long, weight double")
    sim = spark.createDataFrame([(i, j, float(rng.integers(-2, 5))) for i in range(14) for j in range(14) if i != j and rng.random() < 0.2], "src long, dst long, weight double")
    users = spark.createDataFrame([(u,) for u in (*range(9), 500)], "user long")
    given = {**options, **({"candidates": spark.createDataFrame([(c,) for c in options["candidates"]], "item long")} if "candidates" in options else {})}
    shared = rows(linear.recommend(x, sim, users, 5, **given).select("user", "item", "score", "rank"))
    monkeypatch.setattr(linear, "SHARED_ENTRIES", 0)
    assert rows(linear.recommend(x, sim, users, 5, **given).select("user", "item", "score", "rank")) == shared and shared


@pytest.mark.parametrize("exclude_seen, digits", [(True, 4), (False, None)])
def test_recommend_in_parts_joins_nothing_by_pairs(spark, rows, monkeypatch, exclude_seen, digits):
    rng = np.random.default_rng(9)
    x = spark.createDataFrame([(f"u{u}", f"i{i}", float(rng.random())) for u in range(30) for i in range(25) if rng.random() < 0.3], "user string, item string, weight double")
    sim = spark.createDataFrame([(f"i{i}", f"i{j}", float(rng.normal())) for i in range(22) for j in range(30) if i != j and rng.random() < 0.4], "src string, dst string, weight double")
    users = x.select("user").distinct().where("user <> 'u3'")
    of = lambda: [(r[0], r[1], round(r[2], 9), r[3]) for r in rows(linear.recommend(x, sim, users, 4, exclude_seen=exclude_seen, digits=digits).select("user", "item", "score", "rank"))]
    want = of()
    monkeypatch.setattr(linear, "SHARED_ENTRIES", 0)
    monkeypatch.setattr(linear, "scores", None)  # the join of users' items with weights
    monkeypatch.setattr(shared, "PART", 40)
    monkeypatch.setattr(shared, "FETCH", 9)
    assert of() == want and len(want) == 29 * 4


@pytest.mark.parametrize("mapped, values", [(True, 5), (True, 1000), (False, 5)])
def test_shared_rows_leave_one_copy_and_pass_no_driver(spark, monkeypatch, mapped, values):
    rng = np.random.default_rng(4)
    dense = rng.integers(0, values, (30, 20)) * (rng.random((30, 20)) < 0.4) * 1.0
    r, c = np.nonzero(dense)
    entries = spark.createDataFrame(list(zip(r.tolist(), c.tolist(), dense[r, c].tolist())), "r long, c int, v double")
    monkeypatch.setattr(shared, "PART", 60)
    monkeypatch.setattr(shared, "FETCH", 25)
    if mapped:
        monkeypatch.setattr(type(spark.sparkContext), "broadcast", None)  # a copy for the driver and each executor
    else:
        monkeypatch.setattr(shared, "shared_path", lambda *_: None)
    held = shared.SharedRows(entries, 20)
    asked = np.array([3, 29, 3, 0, 7])
    place, column, value = held.entries(asked)
    got = np.zeros((5, 20))
    got[place, column] = value
    assert len(held.parts) > (2 if mapped else 0) and (got == dense[asked]).all()
    totals = np.zeros((2, 20))
    for first, of, column, total in held.products(np.array([0, 2, 5]), asked, np.array([1.0, 2.0, 3.0, 4.0, 5.0])):
        totals[first + np.repeat(np.arange(len(of) - 1), np.diff(of)), column] = total
    assert np.allclose(totals, [dense[3] + 2 * dense[29], 3 * dense[3] + 4 * dense[0] + 5 * dense[7]])
    held.discard()
    assert held.parts == [] and not (mapped and os.path.exists(held.folder))
    assert shared.SharedRows(entries.where("false"), 20).parts == []


NINE = [("u1", "i1", 5.0), ("u1", "i3", 4.0), ("u1", "i4", 5.0), ("u2", "i1", 4.0), ("u2", "i2", 3.0), ("u2", "i4", 4.0), ("u3", "i2", 4.0), ("u3", "i3", 2.0), ("u3", "i4", 1.0)]


def test_linear_model(spark, rows):
    x = spark.createDataFrame(NINE, "user string, item string, weight double")
    sim = linear.fit(x, n_users=3)
    assert sim.where("src = dst").count() == 0
    near = rows(linear.similar_items(sim, spark.createDataFrame([("i1",), ("nope",)], "item string"), 5))
    assert [r[1] for r in near][0] == "i4" and {r[0] for r in near} == {"i1"}
    recs = linear.recommend(x, sim, spark.createDataFrame([("u1",), ("u2",)], "user string"), 5)
    assert {(r["user"], r["item"]) for r in recs.collect()} <= {("u1", "i2"), ("u2", "i3")}
    padded = linear.recommend(x, sim, spark.createDataFrame([("u1",)], "user string"), 5, pad_zero=True)
    assert [r["item"] for r in padded.collect()] == ["i2"]
    fresh = linear.refit(sim, x, spark.createDataFrame([("i1",)], "item string"), n_users=3)
    assert {(r["src"], r["dst"], round(r["weight"], 9)) for r in fresh.collect()} == {(r["src"], r["dst"], round(r["weight"], 9)) for r in sim.collect()}
    with pytest.raises(ValueError):
        linear.LinearConfig(optim="lbfgs")


def test_disjoint_users_have_no_similar_items(spark):
    x = spark.createDataFrame([("a", "i1", 5.0), ("b", "i2", 4.0)], "user string, item string, weight double")
    assert linear.similar_items(linear.fit(x, n_users=2), x.select("item"), 5).count() == 0


@pytest.mark.parametrize("shards, schedule", [(1, "adagrad"), (3, "adagrad"), (1, "adadelta")])
def test_factors_learn_blocks(spark, shards, schedule):
    data = [(u, i, 1.0) for u in range(20) for i in range(10) if (u < 10) == (i < 5) and (u + i) % 4]
    x = spark.createDataFrame(data, "user long, item long, weight double")
    users, items = (tags.entity_features(x.select(F.col(c).alias("entity")).distinct()) for c in ("user", "item"))
    config = factors.FactorConfig(dim=4, epochs=25 if schedule == "adagrad" else 50, seed=1, shards=shards, schedule=schedule, block=4)
    params = factors.fit(x, users, items, config)
    recs = factors.recommend(params, users, items, x, 2).collect()
    seen = {(u, i) for u, i, _ in data}
    assert all((r["user"], r["item"]) not in seen for r in recs)
    top = [r for r in recs if r["rank"] == 1]
    assert np.mean([(r["user"] < 10) == (r["item"] < 5) for r in top]) >= 0.8
    alike = factors.similar_items(params, items, x.select("item"), 2).collect()
    assert all(r["query"] != r["item"] and r["score"] <= 1.0001 for r in alike)
    with pytest.raises(ValueError):
        factors.FactorConfig(loss="warp-kos")


def test_factor_parameters_reach_the_driver_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = spark.createDataFrame([(u, i, 1.0) for u in range(30) for i in range(12) if rng.random() < 0.3], "user long, item long, weight double")
    of = lambda n: tags.entity_features(spark.range(n).select(F.col("id").alias("entity")))
    config = factors.FactorConfig(dim=3, epochs=2, shards=4)
    values = lambda df: sorted((r["side"], r["feature"], r["bias"], *r["vec"]) for r in df.collect())
    whole = values(factors.fit(x, of(30), of(12), config))
    held, shared = [], []
    to_arrow, broadcast = type(x).toArrow, type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(x), "toArrow", lambda df: [t := to_arrow(df), "vec" in t.column_names and held.append(t.num_rows)][0])
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, v: [b := broadcast(sc, v), shared.append(b)][0])
    monkeypatch.setattr(factors, "FETCH", 5)
    assert values(factors.fit(x, of(30), of(12), config)) == whole
    assert held and max(held) <= 5
    assert len(shared) == 2 and not any(os.path.exists(b._path) for b in shared)


def test_factors_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    data = [(int(u), int(i), float(rng.integers(1, 5))) for u in range(30) for i in range(12) if rng.random() < 0.3 or u == 0] + [(None, 1, 1.0), (1, None, 1.0), (500, 1, 1.0)]
    x = spark.createDataFrame(data, "user long, item long, weight double")
    of = lambda n: tags.entity_features(spark.range(n).withColumnRenamed("id", "entity"))
    config = factors.FactorConfig(dim=3, epochs=2, shards=4)
    values = lambda df: sorted((r["side"], r["feature"], round(r["bias"], 4), *(round(v, 4) for v in r["vec"])) for r in df.collect())
    first = values(factors.fit(x, of(30), of(12), config))
    assert values(factors.fit(x.repartition(7, "item"), of(30).repartition(3), of(12), config)) == first and len(first) == 42
    assert len(values(factors.fit(x.where("false"), of(30), of(12), config))) == 42
    # what an increment doesn't touch stays as it is
    start = factors.fit(x, of(30), of(12), config)
    after = {r[:2]: r for r in values(factors.fit(x.where("user < 3"), of(3), of(12), config, start))}
    assert len(after) == 42 and all(after[r[:2]] == r for r in values(start) if r[0] == "user" and int(r[1][3:]) >= 3)


def test_top_by_product_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    t, q = rng.random((50, 4)), rng.random((5, 4))
    to = lambda m: spark.createDataFrame([(n, 0.5 * n, v.tolist()) for n, v in enumerate(m)], "entity long, bias double, vec array<double>")
    got = factors.top_by_product(to(q), to(t), 3, block=8)
    s = q @ t.T + 0.5 * np.arange(50) + 0.5 * np.arange(5)[:, None]
    want = {(u, int(i)) for u in range(5) for i in np.argsort(-s[u])[:3]}
    assert {(r["user"], r["item"]) for r in got.collect()} == want


def test_factor_queries_train_in_full(spark, monkeypatch):
    from tidemark.plans import reference

    seen = []
    monkeypatch.setattr(factors, "fit", lambda x, users, items, config=None: seen.append(config))
    reference._fm(spark, "/root/testdata/sf0.001")
    assert seen == [factors.FactorConfig()]


@pytest.mark.parametrize("name", ["non_interacted_all", "non_negative_all"])
def test_items_of_all_users_equal_sql(spark, name):
    import duckdb

    from tidemark.plans import reference

    con = duckdb.connect()
    con.execute("create view events as select * from '/root/testdata/sf0.001/events.parquet'")
    want = set(con.execute(reference.ORACLE[name]).fetchall())
    assert want and {(r["user"], r["item"]) for r in reference.QUERIES[name](spark, "/root/testdata/sf0.001").collect()} == want


def test_hybrid_query_hears_its_linear_model(spark, monkeypatch):
    from tidemark.plans import reference

    small, d = factors.FactorConfig(dim=3, epochs=1, shards=2), "/root/testdata/sf0.001"
    monkeypatch.setattr(factors, "FactorConfig", lambda: small)
    x, users, items, params = trained = reference._fm(spark, d)
    monkeypatch.setattr(reference, "_fm", lambda *_: trained)
    got = {}
    for r in reference.hybrid_recommend(spark, d).orderBy("user", "rank").collect():
        got.setdefault(r["user"], []).append((r["item"], r["score"]))
    by_user, weights, contacts = {}, {}, {(r["user"], r["item"]): r["contacts"] for r in ops.contact_counts(reference._ix(spark, d)).collect()}
    for r in x.collect():
        by_user.setdefault(r["user"], {})[r["item"]] = r["weight"]
    for r in linear.fit(x, reference.SLIM, len(by_user)).collect():
        weights.setdefault(r["src"], []).append((r["dst"], r["weight"]))
    want, heard = {}, 0
    for r in ranking.min_max(factors.recommend(params, users, items, None, 10)).collect():
        want.setdefault(r["user"], {})[r["item"]] = r["score"]
    for u, own in by_user.items():
        s = {}
        for i, v in own.items():
            for j, w in weights.get(i, []):
                s[j] = s.get(j, 0) + v * w
        best = dict(sorted(s.items(), key=lambda e: (-round(e[1], 9), e[0]))[:10])
        for j, v in best.items():
            n = contacts.get((u, j), 0)
            heard += n > 0
            want[u][j] = want[u].get(j, 0) + 2 * n / (n + 2) * (v - min(best.values())) / (max(best.values()) - min(best.values()) + 1e-8)
    assert got.keys() == want.keys() and heard > 100
    for u, found in got.items():
        assert [v for _, v in found] == pytest.approx(sorted(want[u].values(), reverse=True)[:10], abs=1e-6)
        assert [v for _, v in found] == pytest.approx([want[u][i] for i, _ in found], abs=1e-6)
