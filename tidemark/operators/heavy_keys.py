"""Per-key results when a few keys hold most rows.

Rows are range partitioned on the composite (keys, secondary order) with quantiles that Spark samples, so that a
heavy key is divided over as many partitions as its share needs and every partition is of like size. Each partition,
sorted, is read once and gives one partial state per key; only keys cut by a boundary have more than one. The
partial states of a key, one per partition it touches, are then stitched in partition order.

Defined results: null keys form a key of their own; a row with a null value counts in `n` but not in the sums; a row
with a null order stands before all others and opens no gap; equal rows are all counted; ties in the order are
resolved by the tie column, or, without one, any of the equal rows may be first. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATE = "n long, n_values long, total double, least double, most double, first_order double, first_value double, last_order double, last_value double, max_gap double"


def changes(columns: Sequence[pa.Array]) -> np.ndarray:
    """True where a row's keys differ from those of the row before; the first row is True. Nulls are equal."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    if n:
        out[0] = True
    for c in columns:
        if n < 2:
            break
        a, b = c.slice(1), c.slice(0, n - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        if c.null_count:
            differ |= pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False)
        out[1:] |= differ
    return out


def _floats(c: pa.Array) -> np.ndarray:
    return pc.fill_null(c.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)


def _states(order: np.ndarray, value: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
    """The states of the segments that begin at `start`."""
    stop = np.append(start[1:], len(order))
    has = ~np.isnan(value)
    with np.errstate(invalid="ignore"):
        gap = np.full(len(order), np.nan)
        gap[1:] = order[1:] - order[:-1]
    gap[start] = np.nan
    return {
        "n": stop - start, "n_values": np.add.reduceat(has.astype(np.int64), start), "total": np.add.reduceat(np.where(has, value, 0.0), start),
        "least": np.fmin.reduceat(value, start), "most": np.fmax.reduceat(value, start),
        "first_order": order[start], "first_value": value[start], "last_order": order[stop - 1], "last_value": value[stop - 1], "max_gap": np.fmax.reduceat(gap, start),
    }


def _join(a: dict, b: dict) -> dict:
    """The state of two neighbouring stretches of one key."""
    small, large = (lambda x, y: float(np.fmin(x, y))), (lambda x, y: float(np.fmax(x, y)))
    return {
        "n": a["n"] + b["n"], "n_values": a["n_values"] + b["n_values"], "total": a["total"] + b["total"], "least": small(a["least"], b["least"]), "most": large(a["most"], b["most"]),
        "first_order": a["first_order"], "first_value": a["first_value"], "last_order": b["last_order"], "last_value": b["last_value"],
        "max_gap": large(large(a["max_gap"], b["max_gap"]), b["first_order"] - a["last_order"]),
    }


def _scan(keys: Sequence[str]):
    """Reads a sorted partition; gives one state per key, holding back only the last key's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, dict] | None = None

        def batch(ks: list[pa.Array], states: dict) -> pa.RecordBatch:
            columns = [pa.array(v, from_pandas=True) if v.dtype.kind == "f" else pa.array(v) for v in states.values()]
            return pa.RecordBatch.from_arrays([*ks, *columns], names=[*keys, *states])

        def one(ks: list, state: dict) -> pa.RecordBatch:
            return batch(ks, {k: np.array([v], np.int64 if k in ("n", "n_values") else np.float64) for k, v in state.items()})

        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(k) for k in keys]
            start = np.flatnonzero(changes(columns))
            states = _states(_floats(b.column("o")), _floats(b.column("v")), start)
            of = lambda i, columns=columns, start=start: [c.slice(int(start[i]), 1) for c in columns]
            state_of = lambda i, states=states: {k: v[i].item() for k, v in states.items()}
            first, last = 0, len(start) - 1
            if held is not None:
                if all(x.equals(y) for x, y in zip(held[0], of(0))):
                    joined = _join(held[1], state_of(0))
                    if last == 0:
                        held = (held[0], joined)
                        continue
                    yield one(held[0], joined)
                    first = 1
                else:
                    yield one(*held)
            if last > first:
                rows = pa.array(start[first:last])
                yield batch([c.take(rows) for c in columns], {k: v[first:last] for k, v in states.items()})
            held = (of(last), state_of(last))
        if held is not None:
            yield one(*held)

    return run


def per_key(df: DataFrame, keys: Sequence[str], order: str, value: str, tie: str | None = None, partitions: int | None = None) -> DataFrame:
    """One row per key with STATE: counts, sums, extremes, first and last value in the order, and the longest gap."""
    names = [f"k{i}" for i in range(len(keys))]
    kinds = dict(df.dtypes)
    src = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(order).cast("double").alias("o"), *([F.col(tie).alias("tie")] if tie else []), F.col(value).cast("double").alias("v"))
    by = [*names, "o", *(["tie"] if tie else [])]
    ranged = (src.repartitionByRange(partitions, *by) if partitions else src.repartitionByRange(*by)).sortWithinPartitions(*by).select(*names, "o", "v")
    key_schema = ", ".join(f"{n} {kinds[k]}" for k, n in zip(keys, names))
    states = ranged.mapInArrow(_scan(names), f"{key_schema}, {STATE}").withColumn("part", F.spark_partition_id())
    return stitch(states, names).select(*(F.col(n).alias(k) for n, k in zip(names, keys)), *(c.split()[0] for c in STATE.split(", ")))


def stitch(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join the partial states of each key in partition order: at most one row per key and partition comes in."""
    w = Window.partitionBy(*keys).orderBy("part")
    across = F.col("first_order") - F.lag("last_order").over(w)
    return (
        states.withColumn("across", across)
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"),
            F.min_by("first_order", "part").alias("first_order"), F.min_by("first_value", "part").alias("first_value"),
            F.max_by("last_order", "part").alias("last_order"), F.max_by("last_value", "part").alias("last_value"),
            F.max(F.greatest("max_gap", "across")).alias("max_gap"),
        )
    )
