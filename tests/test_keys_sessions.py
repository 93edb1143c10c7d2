import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators.heavy_keys import per_key
from tidemark.operators.sessions import close_bitmap, sessions


def brute_states(data):
    by = defaultdict(list)
    for k, o, v, t in data:
        by[k].append((o is not None, o or 0, t, v))
    out = {}
    for k, rows in by.items():
        rows.sort()
        orders = [r[1] for r in rows if r[0]]
        values = [r[3] for r in rows if r[3] is not None]
        gaps = [b - a for a, b in zip(orders, orders[1:])]
        first, last = rows[0], rows[-1]
        out[k] = (len(rows), len(values), round(sum(values), 6), min(values, default=None), max(values, default=None), first[1] if first[0] else None, first[3], last[1] if last[0] else None, last[3], max(gaps, default=None))
    return out


def got_states(df):
    return {r["k"]: (r["n"], r["n_values"], round(r["total"], 6), r["least"], r["most"], r["first_order"], r["first_value"], r["last_order"], r["last_value"], r["max_gap"]) for r in df.collect()}


def test_heavy_key_over_many_partitions(spark):
    rng = random.Random(3)
    data = [(rng.choice([7] * 5 + [1, 2, None]), float(rng.randint(0, 50)), rng.choice([None, 1.0, 2.5, -3.0]), i) for i in range(6000)]
    df = spark.createDataFrame(data, "k long, o double, v double, t long")
    for parts in (1, 5, 16):
        assert got_states(per_key(df, ["k"], "o", "v", tie="t", partitions=parts)) == brute_states(data)


def test_per_key_small_batches_carry_states(spark):
    data = [(k, float(i), 1.0, i) for i in range(300) for k in (1, 2)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = got_states(per_key(spark.createDataFrame(data, "k long, o double, v double, t long"), ["k"], "o", "v", tie="t", partitions=2))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    assert got == brute_states(data)


def test_per_key_empty_nulls_clash(spark, rows):
    assert rows(per_key(spark.createDataFrame([], "k string, o double, v double"), ["k"], "o", "v")) == []
    df = spark.createDataFrame([("a", None, None, 1, "x"), ("a", 2.0, None, 2, "y"), (None, 1.0, 1.0, 3, "z")], "k string, o double, v double, n long, part string")
    got = {r["k"]: r for r in per_key(df, ["k"], "o", "v").collect()}
    assert got["a"]["n"] == 2 and got["a"]["n_values"] == 0 and got["a"]["least"] is None and got["a"]["max_gap"] is None
    assert got[None]["n"] == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60)), max_size=40), st.integers(0, 12))
def test_closing_equals_gap_rule(points, gap):
    points = sorted(points)
    e, t = np.array([p[0] for p in points], np.int64), np.array([p[1] for p in points], np.int64)
    want = []
    for i, (a, b) in enumerate(points):
        if i and want[-1][0] == a and b - want[-1][2] <= gap:
            want[-1][2] = b
        else:
            want.append([a, b, b])
    if not points:
        return
    row, first, last = close_bitmap(e, t, gap)
    assert [[e[r], f, x] for r, f, x in zip(row, first, last)] == want


def brute_sessions(data, gap):
    by = defaultdict(list)
    for k, t, c in data:
        if k is not None and t is not None:
            by[k].append((t, c or ""))
    out = []
    for k, ts in by.items():
        ts.sort()
        cur = [ts[0]]
        for a in ts[1:]:
            if a[0] - cur[-1][0] > gap:
                out.append((k, cur))
                cur = []
            cur.append(a)
        out.append((k, cur))
    res = set()
    for k, cur in out:
        counts = defaultdict(int)
        for _, c in cur:
            counts[c] += 1
        res.add((k, cur[0][0], cur[-1][0], len(cur), tuple(sorted(counts.items()))))
    return res


def test_sessions_against_brute_force(spark):
    rng = random.Random(5)
    data = [(rng.choice([9] * 6 + [1, 2, 3, None]), rng.choice([None, *range(0, 200_000, 7)]), rng.choice(["a", "b", None])) for _ in range(5000)]
    df = spark.createDataFrame(data, "v long, t long, e string")
    for batch, parts in (("20000", 1), ("11", 3), ("500", 20)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {(r["v"], r["start_ts"], r["end_ts"], r["n_events"], tuple(sorted(r["counts"].items()))) for r in sessions(df, "v", "t", 60, by="e", partitions=parts).collect()}
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
        assert got == brute_sessions(data, 60)


def test_sessions_edges(spark, rows):
    df = spark.createDataFrame([("u", 0, 1), ("u", 1_800_000, 2), ("u", 3_600_001, 3), ("u", 0, 4), (None, 5, 5), ("w", None, 6)], "entity string, t long, n long")
    got = rows(sessions(df, "entity", "t", 1_800_000))
    assert got == [("u", 0, 1_800_000, 1_800_000, 3), ("u", 3_600_001, 3_600_001, 0, 1)]
    assert rows(sessions(spark.createDataFrame([], "v long, t long"), "v", "t", 5)) == []
    assert rows(sessions(spark.createDataFrame([], "v long, t long, e string"), "v", "t", 5, by="e")) == []


def test_plan_has_no_python_udf_per_row(spark):
    df = spark.range(10).select(F.col("id").alias("v"), F.col("id").alias("t"))
    plan = sessions(df, "v", "t", 5)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "BatchEvalPython" not in plan


def test_sessions_of_fractional_times(spark, rows):
    df = spark.createDataFrame([(1, 0.1), (1, 10.1), (1, 21.0), (2, 5.0), (2, float("nan"))], "v long, t double")
    assert rows(sessions(df, "v", "t", 10, resolution=0.1)) == [(1, 0.1, 10.1, 10.0, 2), (1, 21.0, 21.0, 0.0, 1), (2, 5.0, 5.0, 0.0, 1)]
    with pytest.raises(Exception, match="fractional times"):
        sessions(df, "v", "t", 10).collect()
    with pytest.raises(ValueError):
        sessions(df, "v", "t", 10.05, resolution=0.1)
    assert rows(sessions(df.where("t = floor(t)"), "v", "t", 10)) == [(1, 21.0, 21.0, 0.0, 1), (2, 5.0, 5.0, 0.0, 1)]
    moments = df.where("not isnan(t)").selectExpr("v", "timestamp_micros(cast(round(t * 1000000) as bigint)) as t")
    assert [(r["v"], r["duration"], r["n_events"]) for r in sessions(moments, "v", "t", 10).orderBy("v", "start_ts").collect()] == [(1, 10.0, 2), (1, 0.0, 1), (2, 0.0, 1)]
    with pytest.raises(ValueError):
        sessions(df.selectExpr("v", "cast(t as string) as t"), "v", "t", 10)
