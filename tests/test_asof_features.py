import random

import pytest

from tidemark.operators import asof, feature_table
from tidemark.operators.feature_table import event_types, long_table, unpivot_features


def brute(events, versions, props):
    out = set()
    for seq, e, t in events:
        for p in props:
            ok = [(vt, s) for s, ve, vp, vt in versions if ve == e and vp == p and e is not None and vt is not None and t is not None and vt <= t]
            if ok:
                out.add((seq, p, max(ok)[1]))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_versions_in_force(spark, hot, monkeypatch):
    rng = random.Random(2)
    ids = [1] * 6 + [2, 3, None]
    events = [(i, rng.choice(ids), rng.choice([None, *range(40)])) for i in range(3000)]
    versions = [(i, rng.choice(ids), rng.choice(["a", "b", "c", None]), rng.choice([None, *range(40)])) for i in range(600)]
    e = spark.createDataFrame(events, "seq long, itemid long, timestamp long")
    v = spark.createDataFrame(versions, "seq long, itemid long, property string, timestamp long")
    parts = 40 if hot else 1
    monkeypatch.setattr(asof, "shuffle_partitions", lambda _: parts)
    cuts = asof.hot_cuts(e.select(e.itemid.alias("e"), e.timestamp.alias("t")).dropna(), parts)
    assert bool(cuts) == (hot or True)  # item 1 holds most of the rows
    got = asof.asof_versions(e, v, "itemid", "timestamp", "seq", "timestamp", "seq", "property", ["a", "b"])
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(events, versions, ["a", "b"])


def test_attributes_keep_every_event(spark, rows):
    e = spark.createDataFrame([(1, 5, 10, "x"), (2, 5, 3, "y"), (3, None, 10, "z"), (1, 5, 10, "x")], "seq long, itemid long, timestamp long, cat string")
    v = spark.createDataFrame([(1, 5, "cat", 4, "c1"), (2, 5, "cat", 4, "c2"), (3, 5, "cat", 11, "late"), (4, 5, "av", 4, None)], "seq long, itemid long, property string, timestamp long, value string")
    got = rows(asof.asof_attributes(e, v, "itemid", "timestamp", "timestamp", "seq", "property", "value", ["cat", "av"]))
    assert got == [(1, 5, 10, "x", "c2", None), (1, 5, 10, "x", "c2", None), (2, 5, 3, "y", None, None), (3, None, 10, "z", None, None)]


def test_empty_sides(spark, rows):
    e = spark.createDataFrame([(1, 5, 10)], "seq long, itemid long, timestamp long")
    v = spark.createDataFrame([], "seq long, itemid long, property string, timestamp long, value string")
    args = ("itemid", "timestamp", "timestamp", "seq", "property", "value", ["a"])
    assert rows(asof.asof_attributes(e, v, *args)) == [(1, 5, 10, None)]
    assert rows(asof.asof_attributes(e.where("false"), v, *args)) == []


EVENTS = [(1, "View", 10, 2.0), (1, "view", 30, None), (1, "add-to cart", 20, -1.5), (2, "VIEW!", 5, None), (None, "view", 1, 1.0), (3, None, 1, 1.0), (2, "---", 7, 1.0), (1, "View", 10, 2.0)]


def test_feature_cells(spark, rows):
    df = spark.createDataFrame(EVENTS, "v long, e string, t long, x double")
    wide = feature_table.feature_table(df, "v", "e", "t", "x")
    assert wide.count() == 2 and set(wide.columns) == {"v", "e_", "e_view", "e_addtocart"}
    assert rows(unpivot_features(wide, "v")) == [(1, "addtocart", 1, 20, 10, -1.5), (1, "view", 3, 30, 0, 4.0), (2, "", 1, 7, 23, 1.0), (2, "view", 1, 5, 25, None)]
    zero = wide.where("v = 2").select("e_addtocart.*").first()
    assert tuple(zero) == (0, None, None, None)


def test_feature_types_given_and_bounds(spark, rows, monkeypatch):
    df = spark.createDataFrame(EVENTS, "entity long, e string, t long, x double")
    wide = feature_table.feature_table(df, "entity", "e", "t", "x", types=["view", "never"], as_of=100)
    assert rows(unpivot_features(wide, "entity")) == [(1, "view", 3, 30, 70, 4.0), (2, "view", 1, 5, 95, None)]
    monkeypatch.setattr(feature_table, "MAX_TYPES", 2)
    with pytest.raises(ValueError):
        event_types(df, "e")


def test_feature_empty(spark, rows):
    empty = spark.createDataFrame([], "v long, e string, t long, x double")
    assert rows(unpivot_features(feature_table.feature_table(empty, "v", "e", "t", "x"), "v")) == []
    assert rows(long_table(empty, "v", "e", "t", "x", [])) == []


def test_spellings_beyond_the_broadcast(spark, rows, monkeypatch):
    df = spark.createDataFrame(EVENTS, "v long, e string, t long, x double")
    cells = lambda: rows(feature_table.feature_cells(df, "v", "e", "t", "x"))
    looked_up = cells()
    monkeypatch.setattr(feature_table, "MAX_SPELLINGS", 1)
    assert cells() == looked_up and len(looked_up) == 4


def test_feature_times_keep_their_type(spark):
    df = spark.createDataFrame([(1, "a", 10.25, 1.0), (1, "a", 10.5, 1.0), (2, "a", 12.75, None), (2, "b", float("nan"), None)], "v long, e string, t double, x double")
    got = {(r["v"], r["event_type"]): (r["last_ts"], r["recency"]) for r in feature_table.feature_cells(df, "v", "e", "t", "x").collect()}
    assert got == {(1, "a"): (10.5, 2.25), (2, "a"): (12.75, 0.0), (2, "b"): (None, None)}
    moments = df.where("t = t and e = 'a'").selectExpr("v", "e", "timestamp_micros(cast(t * 1000000 as bigint)) as t", "x")
    got = {r["v"]: (r["last_ts"].microsecond, r["recency"]) for r in feature_table.feature_cells(moments, "v", "e", "t", "x").collect()}
    assert got == {1: (500000, 2.25), 2: (750000, 0.0)}


@pytest.mark.parametrize("hot", [False, True])
def test_fractional_times_never_see_later_versions(spark, hot, monkeypatch):
    rng = random.Random(3)
    at = lambda: rng.choice([10.2, 10.7, 10.7, rng.uniform(9, 12), float("nan")])
    events = [(i, rng.choice([1, 1, 2]), at()) for i in range(2500)]
    versions = [(i, rng.choice([1, 1, 2]), rng.choice("ab"), at()) for i in range(300)]
    monkeypatch.setattr(asof, "shuffle_partitions", lambda _: 30 if hot else 1)
    known = lambda t: None if t != t else t
    e = spark.createDataFrame(events, "seq long, itemid long, timestamp double")
    v = spark.createDataFrame(versions, "seq long, itemid long, property string, timestamp double")
    got = [tuple(r) for r in asof.asof_versions(e, v, "itemid", "timestamp", "seq", "timestamp", "seq", "property", ["a", "b"]).collect()]
    want = brute([(s, i, known(t)) for s, i, t in events], [(s, i, p, known(t)) for s, i, p, t in versions], ["a", "b"])
    assert len(got) == len(set(got)) and set(got) == want
    # one instant that holds most rows is spread over shards of its own
    keys = e.select(e.itemid.alias("e"), e.timestamp.alias("t")).where("not isnan(t)")
    assert any(len(set(c)) < len(c) for _, c in asof.hot_cuts(keys, 30))


def test_times_of_two_types(spark, rows):
    e = spark.createDataFrame([(1, 5, 10), (2, 5, 11)], "seq long, itemid long, timestamp long")
    v = spark.createDataFrame([(1, 5, "a", 10.5)], "seq long, itemid long, property string, timestamp double")
    assert rows(asof.asof_versions(e, v, "itemid", "timestamp", "seq", "timestamp", "seq", "property", ["a"])) == [(2, "a", 1)]
    moments = lambda df: df.selectExpr("* except (timestamp)", "timestamp_micros(cast(timestamp * 1000000 as bigint)) as timestamp")
    assert rows(asof.asof_versions(moments(e), moments(v), "itemid", "timestamp", "seq", "timestamp", "seq", "property", ["a"])) == [(2, "a", 1)]
    with pytest.raises(ValueError):
        asof.asof_versions(e, moments(v), "itemid", "timestamp", "seq", "timestamp", "seq", "property", ["a"])
