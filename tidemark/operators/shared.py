"""Products with a sparse matrix that every task reads by rows, so that no pair of columns is ever shuffled.

The matrix goes to the tasks in parts of at most about PART entries: 4 bytes for the column, and 1 for the value where
at most 256 values occur, else 8. Where the shared folder is a path, tasks write the parts there and map them when they
read, so there is one copy and none of it passes the driver; elsewhere they are broadcast, of which the driver holds one
at a time. A task sums the rows that an owner asks for, for as many owners at once as reach about CHUNK entries, and
hands on what the caller keeps of the sums.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import delete_at_end, discard, materialize, remove, shared_path
from .ids import numbered

PART = 4_000_000
#: Rows that come to the driver at once.
FETCH = 1_000_000
#: Entries that are summed up together in a task.
CHUNK = 1 << 18
#: A task keeps so many parts; of more it keeps none after use.
KEEP = 8
#: Names up to this number are broadcast to the rows that hold them; beyond that Spark's skew join divides frequent ones.
SHARED_NAMES = 1_000_000


def coded(df: DataFrame, names: DataFrame, n_names: int, column: str, name: str) -> DataFrame:
    """df with the number of its column's value: names(column, name)."""
    return df.join(F.broadcast(names) if n_names <= SHARED_NAMES else names, column)


def numbers_of(df: DataFrame, column: str, name: str) -> tuple[DataFrame, int]:
    """((column, name), how many): the distinct values in order, numbered from 0."""
    names = materialize(numbered(df.select(column).distinct(), [column], name), "names")
    return names, names.count()


def added(key: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, sums of their parts)."""
    if not len(key):
        return key, part
    low = int(key.min())
    span = int(key.max()) - low + 1
    if span < 4 * len(key):
        key = key - low
        found = np.flatnonzero(np.bincount(key, minlength=span))
        return found + low, np.bincount(key, part, span)[found]
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(part[order], first)


class MappedPart:
    """A part in files of the shared folder. Tasks map them: the pages are the system's, and go with the task."""

    def __init__(self, path: str, first: int, table: np.ndarray | None):
        self.path, self.first, self.table = path, first, table

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_value"}

    @property
    def value(self) -> tuple:
        if "_value" not in self.__dict__:
            start, column, value = (np.asarray(np.load(f"{self.path}-{k}.npy", mmap_mode="r")) for k in ("start", "column", "value"))
            self._value = (self.first, start, column, value, self.table)
        return self._value


def _write_part(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of a task as one part."""
    held = [tuple(b.column(k).to_numpy() for k in ("r", "c", "v")) for b in batches if b.num_rows]
    if not held:
        return
    r, c, v = (np.concatenate(a) for a in zip(*held))
    order = np.lexsort((c, r))
    first = int(r.min())
    start = np.append(0, np.cumsum(np.bincount(r - first)))
    values = np.unique(v)
    table = values if len(values) <= 256 else None
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{uuid.uuid4().hex}"  # a task that runs twice writes twice; the part is the one it names at its end
    v = v[order]
    for k, a in (("start", start), ("column", c[order]), ("value", v if table is None else np.searchsorted(table, v).astype(np.uint8))):
        np.save(f"{path}-{k}.npy", a)
    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([first]), pa.array([table], pa.list_(pa.float64()))], names=["path", "first", "table"])


class SharedRows:
    def __init__(self, entries: DataFrame, n_columns: int):
        """entries(r, c, v): row and column are whole numbers from 0, unique together."""
        rows = entries.select(F.col("r").cast("long").alias("r"), F.col("c").cast("int").alias("c"), F.col("v").cast("double").alias("v"))
        self.spark, self.n_columns, self.parts, self.folder = entries.sparkSession, n_columns, [], shared_path(entries.sparkSession, "rows")
        if self.folder is None:
            self._broadcast(rows)
        else:
            self._write(rows)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "spark"}

    def _write(self, rows: DataFrame) -> None:
        folder, n = self.folder, rows.count()
        # half of PART each, as the bounds of ranges are sampled
        laid = rows.repartitionByRange(max(1, -(-2 * n // PART)), "r")
        found = laid.mapInArrow(lambda batches: _write_part(folder, batches), "path string, first long, table array<double>").collect()
        delete_at_end(self.spark, folder)
        self.parts = [MappedPart(p["path"], p["first"], None if p["table"] is None else np.array(p["table"])) for p in sorted(found, key=lambda p: p["first"])]

    def discard(self) -> None:
        """Give up the parts, which no task will read again."""
        if self.folder is not None:
            remove(self.spark, self.folder)
        else:
            for part in self.parts:
                part.destroy()
        self.parts = []

    def _broadcast(self, rows: DataFrame) -> None:
        spark = self.spark
        laid = materialize(rows.repartitionByRange("r").withColumn("p", F.spark_partition_id()), "rows")
        values = laid.select("v").distinct().limit(257).toArrow().column("v").to_numpy()
        table = np.sort(values) if len(values) <= 256 else None
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def share() -> None:
            nonlocal held, size
            if size:
                row, many, c, v = (np.concatenate(a) for a in zip(*held))
                first = int(row[0])
                start = np.append(0, np.cumsum(np.bincount(row - first, many).astype(np.int64)))
                self.parts.append(spark.sparkContext.broadcast((first, start, c, v, table)))
            held, size = [], 0

        def fetch(low: int, high: int) -> None:
            nonlocal size
            found = laid.where(F.col("p").between(low, high)).select("r", "c", "v").toArrow()
            r, c, v = (found.column(n).to_numpy() for n in ("r", "c", "v"))
            order = np.lexsort((c, r))
            row, many = np.unique(r, return_counts=True)
            held.append((row, many, c[order], v[order] if table is None else np.searchsorted(table, v[order]).astype(np.uint8)))
            size += len(r)
            if size >= PART:
                share()

        ranges: list[list[int]] = []
        for p, n in laid.groupBy("p").agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():
            if ranges and ranges[-1][2] + n <= FETCH:
                ranges[-1][1:] = [p, ranges[-1][2] + n]
            else:
                ranges.append([p, p, n])
        for low, high, _ in ranges:
            fetch(low, high)
        share()
        discard(laid)

    def _loaded(self) -> Iterator[tuple]:
        for part in self.parts:
            yield part.value
            if len(self.parts) > KEEP:
                part.__dict__.pop("_value", None)

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in rows, column, value) of all entries of the rows, which may repeat; those of a row stay in order."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0))]
        for first, start, column, value, table in self._loaded():
            inside = np.flatnonzero((rows >= first) & (rows < first + len(start) - 1))
            r = rows[inside] - first
            length = start[r + 1] - start[r]
            ends = np.cumsum(length)
            at = np.repeat(start[r] - (ends - length), length) + np.arange(length.sum())
            found.append((np.repeat(inside, length), column[at], value[at] if table is None else table[value[at]]))
        place, column, value = (np.concatenate(c) for c in zip(*found))
        return place, column, value

    def products(self, bounds: np.ndarray, rows: np.ndarray, weight: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first, bounds, column, sum) of groups of owners: the sums of weight x row over the rows that each asks for.

        Owner o asks for rows[bounds[o] : bounds[o + 1]]; columns that any of its rows has come out in order.
        """
        length = np.zeros(len(rows), np.int64)
        for first, start, *_ in self._loaded():
            inside = np.flatnonzero((rows >= first) & (rows < first + len(start) - 1))
            length[inside] = start[rows[inside] - first + 1] - start[rows[inside] - first]
        reach = np.append(0, np.cumsum(length))[bounds]
        chunk = CHUNK * (1 if len(self.parts) <= KEEP else 16)
        o, n = 0, len(bounds) - 1
        while o < n:
            upto = max(o + 1, int(np.searchsorted(reach, reach[o] + chunk, "right")) - 1)
            here = slice(bounds[o], bounds[upto])
            code, total = self._summed(rows[here], weight[here], np.repeat(np.arange(upto - o), np.diff(bounds[o : upto + 1])))
            owner = code // self.n_columns
            yield o, np.searchsorted(owner, np.arange(upto - o + 1)), code - owner * self.n_columns, total
            o = upto

    def _summed(self, rows: np.ndarray, weight: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
        for first, start, column, value, table in self._loaded():
            inside = np.flatnonzero((rows >= first) & (rows < first + len(start) - 1))
            r = rows[inside] - first
            length = start[r + 1] - start[r]
            ends = np.cumsum(length)
            at = 0
            while at < len(r):
                done = int(ends[at - 1]) if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, done + 4 * CHUNK, "right")))
                n, mine = length[at:upto], inside[at:upto]
                place = np.repeat(start[r[at:upto]] - (ends[at:upto] - n - done), n) + np.arange(int(ends[upto - 1]) - done)
                v = value[place] if table is None else table[value[place]]
                code, total = added(np.repeat(owner[mine] * self.n_columns, n) + column[place], v * np.repeat(weight[mine], n))
                keys.append(code)
                sums.append(total)
                at = upto
        if len(keys) == 2:
            return keys[1], sums[1]
        return added(np.concatenate(keys), np.concatenate(sums))
