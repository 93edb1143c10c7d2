"""Sessions of inactivity gaps by morphological closing of occupancy bitmaps.

The occupancy of an entity is a bitmap with one bit per timestamp unit. It is closed with a structuring element of
`gap` bits: a dilation by doubling shifts (B |= B << 1, << 2, << 4, ...) to a total of gap - 1, so that two occupied
bits at most `gap` apart lie in one run, then an erosion by as much. Bitmaps at millisecond resolution are nearly
empty, so they are held run-length coded: a shifted OR lengthens every run by the shift and joins runs that touch,
for all entities of an Arrow batch at once. The runs that remain are the sessions; the erosion trims their ends back
to the last event, and the events are counted into them.

Rows are range partitioned on (entity, time), so a busy entity is divided over many partitions. Only the first and
the last run of a partition can continue elsewhere; they are flagged and joined where neighbours are near enough.

A bit is one unit of whole-number times and a microsecond of timestamps. Fractional times need a `resolution`, the length
of a bit in their unit, and are placed on its nearest multiple; without one a fraction is an error, never cut off.

Defined results: rows with a null entity or time (NaN counts as null) belong to no session; repeated rows count each; equal timestamps
share a bit; a null category counts under the key '' of `by`; an empty table gives no sessions; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .heavy_keys import changes


def close_bitmap(entity: np.ndarray, bit: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the closed bitmap: (index of the run's first row, first bit, last bit). Rows lie sorted by (entity, bit)."""
    fresh = np.ones(len(bit), bool)
    fresh[1:] = (entity[1:] != entity[:-1]) | (bit[1:] != bit[:-1])
    row = np.flatnonzero(fresh)
    first, last, owner = bit[row].astype(np.int64), bit[row].astype(np.int64), entity[row]

    def coalesce(reach: np.ndarray) -> np.ndarray:
        """True for runs that don't touch the run before, each lengthened to `reach`."""
        head = np.ones(len(first), bool)
        head[1:] = (owner[1:] != owner[:-1]) | (first[1:] > reach[:-1] + 1)
        return head

    dilated, length, left = last, 1, max(gap - 1, 0)
    while left > 0:
        shift = min(length, left)
        dilated = dilated + shift
        head = coalesce(dilated)
        tail = np.append(np.flatnonzero(head)[1:], len(first)) - 1
        row, first, dilated, owner = row[head], first[head], dilated[tail], owner[head]
        length, left = length + shift, left - shift
    if gap <= 1:
        head = coalesce(dilated) if gap == 1 else np.ones(len(first), bool)
        tail = np.append(np.flatnonzero(head)[1:], len(first)) - 1
        row, first, dilated = row[head], first[head], dilated[tail]
    return row, first, dilated - max(gap - 1, 0)


def _closing(gap: int, by: bool):
    names = ["entity", "start_ts", "end_ts", "n", *(["counts"] if by else []), "edge"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        seen = False

        def one(x: dict, edge: bool) -> pa.RecordBatch:
            columns = [x["entity"], pa.array([x["first"]]), pa.array([x["last"]]), pa.array([x["n"]])]
            if by:
                columns.append(pa.array([list(x["counts"].items())], pa.map_(pa.string(), pa.int64())))
            return pa.RecordBatch.from_arrays([*columns, pa.array([edge])], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("entity")
            owner = np.cumsum(changes([ids]))
            row, first, last = close_bitmap(owner, b.column("t").to_numpy(), gap)
            n = np.diff(np.append(row, b.num_rows))
            if by:
                coded = b.column("kind").dictionary_encode()
                labels, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                of_row = np.repeat(np.arange(len(row)), n)
                cell, amount = np.unique(of_row * len(labels) + code, return_counts=True)
                at = np.searchsorted(cell // len(labels), np.arange(len(row) + 1))
            counts = lambda i: dict(zip((labels[c] for c in cell[at[i] : at[i + 1]] % len(labels)), amount[at[i] : at[i + 1]].tolist())) if by else {}  # noqa: E731, B023
            state = lambda i: {"entity": ids.slice(int(row[i]), 1), "first": int(first[i]), "last": int(last[i]), "n": int(n[i]), "counts": counts(i)}  # noqa: E731, B023
            lo, hi = 0, len(row) - 1
            if held is not None:
                head = state(0)
                if held["entity"].equals(head["entity"]) and head["first"] - held["last"] <= gap:
                    merged = held["counts"] | {k: v + held["counts"].get(k, 0) for k, v in head["counts"].items()}
                    held = {**held, "last": max(held["last"], head["last"]), "n": held["n"] + head["n"], "counts": merged}
                    if hi == 0:
                        continue
                    lo = 1
                yield one(held, not seen)
                seen = True
            if hi > lo:
                keep = slice(lo, hi)
                columns = [ids.take(pa.array(row[keep])), pa.array(first[keep]), pa.array(last[keep]), pa.array(n[keep].astype(np.int64))]
                if by:
                    cells = slice(at[lo], at[hi])
                    columns.append(pa.MapArray.from_arrays(pa.array((at[lo : hi + 1] - at[lo]).astype(np.int32)), coded.dictionary.take(pa.array(cell[cells] % len(labels))), pa.array(amount[cells].astype(np.int64))))
                edge = np.zeros(hi - lo, bool)
                edge[0] = not seen
                yield pa.RecordBatch.from_arrays([*columns, pa.array(edge)], names=names)
                seen = True
            held = state(hi)
        if held is not None:
            yield one(held, True)

    return run


def _bits(df: DataFrame, time: str, gap: float, resolution: float | None) -> tuple[Column, int, Callable[[Column], Column], Callable[[Column], Column]]:
    """(bit of a row, gap in bits, time of a bit, length of bits) for the type of the time column."""
    kind, t = df.schema[time].dataType, F.col(time)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        back = kind.simpleString() if not isinstance(kind, T.DateType) else "timestamp"
        return F.unix_micros(t.cast("timestamp")), _whole(gap * 1_000_000, "gap"), lambda b: F.timestamp_micros(b).cast(back), lambda b: b / 1_000_000
    if isinstance(kind, T.IntegralType) and resolution is None:
        return t.cast("long"), _whole(gap, "gap"), lambda b: b, lambda b: b
    if not isinstance(kind, T.NumericType):
        raise ValueError(f"times of type {kind.simpleString()} have no bits")
    x = t.cast("double")
    known = F.when(~F.isnan(x), x)
    if resolution is None:
        bit = F.when(known == F.floor(known), F.floor(known)).when(known.isNotNull(), F.raise_error(F.lit(f"fractional times in {time}: give a resolution")).cast("long"))
        return bit, _whole(gap, "gap"), lambda b: b.cast(kind), lambda b: b.cast(kind)
    a_unit = round(1 / resolution) if resolution < 1 and abs(round(1 / resolution) * resolution - 1) < 1e-9 else None
    to, of = (lambda c: c * a_unit, lambda b: b / a_unit) if a_unit else (lambda c: c / resolution, lambda b: b * resolution)
    return F.round(to(known)).cast("long"), _whole(gap / resolution, "gap"), of, of


def _whole(x: float, what: str) -> int:
    if abs(x - round(x)) > 1e-6:
        raise ValueError(f"the {what} isn't a whole number of bits")
    return round(x)


def sessions(df: DataFrame, entity: str, time: str, gap: float, by: str | None = None, partitions: int | None = None, resolution: float | None = None) -> DataFrame:
    """(entity, start_ts, end_ts, duration, n_events[, counts]): the sessions of every entity.

    Neighbours at most `gap` apart stay together; gap and duration are in the unit of the times, seconds for timestamps.
    resolution: the length of a bit, for fractional times. With `by`, counts is a map of category to events.
    """
    bit, gap, moment, length = _bits(df, time, gap, resolution)
    kind = [F.coalesce(F.col(by).cast("string"), F.lit("")).alias("kind")] if by else []
    src = df.select(F.col(entity).alias("entity"), bit.alias("t"), *kind).where(F.col("entity").isNotNull() & F.col("t").isNotNull())
    ranged = (src.repartitionByRange(partitions, "entity", "t") if partitions else src.repartitionByRange("entity", "t")).sortWithinPartitions("entity", "t")
    schema = f"entity {dict(src.dtypes)['entity']}, start_ts long, end_ts long, n long, {'counts map<string,long>, ' if by else ''}edge boolean"
    runs = ranged.mapInArrow(_closing(gap, by is not None), schema)
    # inner runs are whole and stand alone; the edge runs of an entity, at most two a partition, are joined
    runs = runs.withColumn("own", F.when(~F.col("edge"), F.col("start_ts")))
    w = Window.partitionBy("entity", "own").orderBy("start_ts", "end_ts")
    before = F.max("end_ts").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("new", F.when(before.isNull() | (F.col("start_ts") - before > gap), 1).otherwise(0))
    runs = runs.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = F.aggregate(
        F.collect_list("counts"), F.create_map().cast("map<string,bigint>"), lambda a, m: F.map_zip_with(a, m, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    ) if by else None
    out = runs.groupBy("entity", "own", "session").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("n").alias("n_events"), *([merged.alias("counts")] if by else []))
    start, end = F.col("start_ts"), F.col("end_ts")
    return out.select(F.col("entity").alias(entity), moment(start).alias("start_ts"), moment(end).alias("end_ts"), length(end - start).alias("duration"), "n_events", *(["counts"] if by else []))
