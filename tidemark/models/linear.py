"""Sparse linear item-item model: an elastic net per target item on the Gram matrix.

Two ways give the same weights. A matrix of at most SHARED_ENTRIES entries is shared with every task by rows and by
columns; tasks take targets, add up a target's products over its users, pick its neighbours and solve, and nothing is
shuffled. Beyond that the matrix is shared in parts, tasks add up the products among a target's neighbours too, from
the columns of the rarer items and products of the frequent ones that are made once, and `neighbours` must be given,
since without it their number has no bound. No product is written in either way.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ranking
from ..operators.gram import Numbered, nearest
from ..operators.ids import numbered
from ..operators.shared import SHARED_NAMES, SharedRows, coded, numbers_of
from ..session import discard, materialize, spread
from .solvers import elastic_net, elastic_net_columns, elastic_net_sgd

SOLVERS = {"cd": elastic_net, "sgd": elastic_net_sgd}
#: Targets solved at once, and the most numbers that their Gram matrices hold.
BATCH, BATCH_NUMBERS = 256, 4_000_000
#: Entries of a matrix that is shared with every task: 24 bytes each, by rows and by columns.
SHARED_ENTRIES = 4_000_000
#: Beyond so many neighbours a target is solved on the columns themselves instead of their products.
DENSE = 1_500
#: Beyond SHARED_ENTRIES: frequent items whose products are made once for all targets.
HOT = 1_024
#: Targets solved at once there, and neighbours that are held until then.
LARGE_BATCH, JOBS = 1_024, 80_000


@dataclass(frozen=True)
class LinearConfig:
    """Of the solver. With `neighbours` only the items most alike a target explain it. The solvers draw nothing at
    random, so there is no random state."""

    optim: str = "cd"
    alpha: float = 0.1
    l1_ratio: float = 0.1
    positive_only: bool = True
    max_iter: int = 100
    tol: float = 1e-4
    eta0: float = 0.001
    neighbours: int | None = None

    def __post_init__(self):
        if self.optim not in SOLVERS:
            raise ValueError(f"unknown optimiser: {self.optim}")

    def explained(self, product: np.ndarray, n: float) -> bool:
        """A target with these products has weights: where none is above the penalty, 0 is the optimum and no solver leaves it."""
        return bool(len(product)) and float((product if self.positive_only else np.abs(product)).max()) > n * self.alpha * self.l1_ratio

    def solve(self, gram: np.ndarray, target: np.ndarray, n: float) -> np.ndarray:
        extra = {"eta0": self.eta0} if self.optim == "sgd" else {}
        return SOLVERS[self.optim](gram, target, n, self.alpha, self.l1_ratio, self.positive_only, self.max_iter, tol=self.tol, **extra)


def fit(x: DataFrame, config: LinearConfig = LinearConfig(), n_users: int | None = None, targets: DataFrame | None = None, matrix: LargeMatrix | None = None) -> DataFrame:
    """(src, dst, weight) of non-zero weights. x: (user, item, weight); n_users: rows of the matrix, unused ids too.

    matrix: of the same x, where several fits are to share it."""
    x = x.where("user is not null and item is not null and weight is not null").select("user", "item", F.col("weight").cast("double").alias("weight"))
    if n_users is None:
        top = x.agg(F.max("user")).first()[0]
        n_users = int(top) + 1 if isinstance(top, int) else x.select("user").distinct().count()
    reached = _reachable(x, config, n_users, targets)
    if reached.isEmpty():
        return _no_weights(x)
    if x.limit(SHARED_ENTRIES + 1).count() <= SHARED_ENTRIES:
        return _fit_shared(x, config, n_users, reached)
    if not config.neighbours:
        raise ValueError(f"a matrix of more than {SHARED_ENTRIES} entries needs a number of neighbours")
    return _fit_by_tables(x, config, n_users, reached, matrix, targets is None)


def _reachable(x: DataFrame, config: LinearConfig, n_users: int, targets: DataFrame | None) -> DataFrame:
    """(item): the targets that can have weights: a product is at most the root of the product of both items' squares,
    and where it isn't above the penalty, 0 is the optimum."""
    squares = materialize(x.groupBy("item").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")), "squares")
    first = squares.orderBy(F.desc("s"), "item").limit(2).collect()
    if not first:
        return squares.select("item")
    most = F.when(F.col("item") == F.lit(first[0]["item"]), F.lit(first[1]["s"] if len(first) > 1 else 0.0)).otherwise(F.lit(first[0]["s"]))
    reached = squares.where(~(F.sqrt(F.col("s")) * F.sqrt(most) * (1 + 1e-9) <= n_users * config.alpha * config.l1_ratio)).select("item")
    return reached if targets is None else reached.join(targets.select("item").distinct(), "item", "left_semi")


class Matrix:
    """A sparse matrix by columns and by rows."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, columns: int):
        def order(major: np.ndarray, minor: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = np.lexsort((minor, major))
            return np.append(0, np.cumsum(np.bincount(major, minlength=size))), minor[at].astype(np.int32), value[at]

        self.columns, self.n_columns = order(column, row, columns), columns
        self.rows = order(row, column, rows)

    def column(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        start, index, value = self.columns
        return index[start[j] : start[j + 1]], value[start[j] : start[j + 1]]

    def products(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """(items, products) of column j with all columns that share a row with it, in order."""
        rows, weight = self.column(j)
        start, index, value = self.rows
        length = start[rows + 1] - start[rows]
        at = np.repeat(start[rows] - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())
        return summed(index[at], value[at] * np.repeat(weight, length), self.n_columns)

    def gram(self, chosen: np.ndarray) -> np.ndarray:
        """The products among the chosen columns."""
        start, index, value = self.columns
        length = start[chosen + 1] - start[chosen]
        at = np.repeat(start[chosen] - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())
        users, place = np.unique(index[at], return_inverse=True)
        dense = np.zeros((len(users), len(chosen)))
        dense[place, np.repeat(np.arange(len(chosen)), length)] = value[at]
        return dense.T @ dense


def summed(index: np.ndarray, part: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct indices below n, in order; sums of their parts)."""
    if len(index) * 4 > n:
        sums, met = np.bincount(index, part, n), np.bincount(index, minlength=n) > 0
        found = np.flatnonzero(met)
        return found, sums[found]
    found, back = np.unique(index, return_inverse=True)
    return found, np.bincount(back, part, len(found))


def _fit_shared(x: DataFrame, config: LinearConfig, n_users: int, targets: DataFrame | None) -> DataFrame:
    spark, kind = x.sparkSession, dict(x.dtypes)["item"]
    held = x.toArrow()
    users, items = (held.column(c).combine_chunks().dictionary_encode() for c in ("user", "item"))
    order = pa.compute.sort_indices(items.dictionary)
    names = items.dictionary.take(order)
    place = np.empty(len(names), np.int64)
    place[order.to_numpy()] = np.arange(len(names))
    column = place[items.indices.to_numpy()]
    matrix = Matrix(users.indices.to_numpy().astype(np.int64), column, held.column("weight").to_numpy(), len(users.dictionary), len(names))
    if targets is None:
        wanted = np.arange(len(names))
    else:
        # of the targets asked, those that the matrix knows: no more than it has items
        asked = targets.select("item").distinct().join(x.select("item").distinct(), "item", "left_semi").toArrow().column("item").combine_chunks()
        wanted = np.sort(pa.compute.index_in(asked, names).to_numpy(zero_copy_only=False).astype(np.int64))
    shared = spark.sparkContext.broadcast((matrix, names, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, names, wanted = shared.value
        for b in batches:
            jobs = []
            for j in wanted[b.column("id").to_numpy()].tolist():
                item, product = nearest(*matrix.products(j), j, config.neighbours)
                if not config.explained(product, n_users):
                    continue
                if len(item) > DENSE:
                    yield _weights(names, item, np.full(len(item), j), elastic_net_columns([matrix.column(i) for i in item.tolist()], matrix.column(j), n_users, config.alpha, config.l1_ratio, config.positive_only, config.max_iter, config.tol))
                else:
                    jobs.append((j, item, product))
            # targets of like size are solved together
            jobs.sort(key=lambda job: len(job[1]))
            at = 0
            while at < len(jobs):
                upto = at + 1
                while upto < len(jobs) and upto - at < BATCH and (upto + 1 - at) * len(jobs[upto][1]) ** 2 <= BATCH_NUMBERS:
                    upto += 1
                size = len(jobs[upto - 1][1])
                a, y = np.zeros((upto - at, size, size)), np.zeros((upto - at, size))
                for r, (_, item, product) in enumerate(jobs[at:upto]):
                    a[r, : len(item), : len(item)] = matrix.gram(item)
                    y[r, : len(item)] = product
                w = config.solve(a, y, n_users)
                real = np.concatenate([w[r, : len(item)] for r, (_, item, _) in enumerate(jobs[at:upto])])
                yield _weights(names, np.concatenate([item for _, item, _ in jobs[at:upto]]), np.repeat([j for j, *_ in jobs[at:upto]], [len(item) for _, item, _ in jobs[at:upto]]), real)
                at = upto

    tasks = max(1, min(len(wanted), 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, len(wanted), 1, tasks).mapInArrow(run, f"src {kind}, dst {kind}, weight double")


def _weights(names: pa.Array, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    kept = np.flatnonzero(weight)
    return pa.RecordBatch.from_arrays([names.take(pa.array(src[kept])), names.take(pa.array(dst[kept])), pa.array(weight[kept])], names=["src", "dst", "weight"])


class LargeMatrix:
    """x(user, item, weight), unique by (user, item), of any size, shared with the tasks in parts: by users; of the HOT
    most frequent neighbours the users' rows again, and their products; of the other neighbours the columns. Made when
    first used, and kept for further fits and for judging them until `discard`."""

    def __init__(self, x: DataFrame):
        self.x, self._near = x, {}

    @cached_property
    def numbered(self) -> Numbered:
        return Numbered(self.x)

    def numbers(self, items: DataFrame) -> DataFrame:
        """(c): the numbers of the items that the matrix holds."""
        return coded(items.select("item").distinct(), self.numbered.names, self.numbered.n_items, "item", "c").select(F.col("c").cast("int").alias("c"))

    def columns(self, codes: DataFrame | None) -> DataFrame:
        """(c, own): the users of the items of these numbers, or of every item, and their weights."""
        if codes is None:
            return self.numbered.columns
        return self.numbered.entries.join(codes, "c", "left_semi").groupBy("c").agg(F.collect_list(F.struct("u", "w")).alias("own"))

    def near(self, config: LinearConfig, n_users: int, targets: DataFrame | None = None, whole: bool = False) -> Neighbours:
        """Of the targets that have weights. whole: `targets` are all that can have some, so that the result is kept."""
        key = (config.neighbours, n_users, config.alpha * config.l1_ratio, config.positive_only)
        if key in self._near:
            return self._near[key] if whole else self._near[key].of(self.numbers(targets))
        explained = lambda product: config.explained(product, n_users)
        out = Neighbours(self.numbered, self.listed(config, None if targets is None else self.numbers(targets), explained))
        if whole:
            self._near[key] = out
        return out

    def listed(self, config: LinearConfig, codes: DataFrame | None, wanted: Callable[[np.ndarray], bool]) -> DataFrame:
        """(c, near, g): targets with neighbours whose products are wanted."""

        def listed(jobs: list[tuple]) -> Iterator[pa.RecordBatch]:
            kept = [job for job in jobs if wanted(job[2])]
            columns = [pa.array([j for j, *_ in kept], pa.int32()), pa.array([near for _, near, _ in kept], pa.list_(pa.int32())), pa.array([g for *_, g in kept], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["c", "near", "g"])

        return materialize(self.columns(codes).mapInArrow(_nearest_jobs(self, config, listed), "c int, near array<int>, g array<double>"), "near")

    def discard(self) -> None:
        """Give up what was written; nothing that reads it may be left to run."""
        if "numbered" in vars(self):
            for near in self._near.values():
                near.discard()
            self.numbered.discard()
            del self.numbered
        self._near = {}


class Neighbours:
    """found(c, near, g): targets by number, their neighbours in order and the products with them."""

    def __init__(self, numbered: Numbered, found: DataFrame, part_of: Neighbours | None = None):
        self.numbered, self.found, self.part_of = numbered, found, part_of

    def of(self, codes: DataFrame) -> Neighbours:
        return Neighbours(self.numbered, self.found.join(codes, "c", "left_semi"), self)

    def discard(self) -> None:
        discard(self.found)
        if "shared" in vars(self):
            for rows in self.shared[:2]:
                rows.discard()

    @property
    def among(self) -> Callable[[list[np.ndarray], int], np.ndarray]:
        """products_among upon this matrix, for tasks."""
        cold, hot_rows, hot, users = (self.part_of or self).shared
        return lambda items, size: products_among(items, size, cold, hot_rows, hot.value, users)

    @cached_property
    def shared(self) -> tuple:
        spark, users, n_items = self.numbered.entries.sparkSession, max(1, self.numbered.n_users), self.numbered.n_items
        # products are asked for among the neighbours only
        needed = self.found.select(F.explode("near").alias("c")).distinct()
        entries = self.numbered.entries.join(F.broadcast(needed) if n_items <= SHARED_NAMES else needed, "c", "left_semi")
        often = entries.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c").limit(HOT)
        hot = np.sort(often.select("c").toArrow().column("c").to_numpy()).astype(np.int64)
        places = F.broadcast(spark.createDataFrame(list(zip(hot.tolist(), range(len(hot)))), "c int, h int"))
        of_hot = entries.join(places, "c")
        hot_rows = SharedRows(of_hot.select(F.col("u").alias("r"), F.col("h").alias("c"), F.col("w").alias("v")), max(1, len(hot)))
        cold = SharedRows(entries.join(places, "c", "left_anti").select(F.col("c").alias("r"), F.col("u").cast("int").alias("c"), F.col("w").alias("v")), users)

        def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own, place = b.column("own"), b.column("h").to_numpy()
                bounds, flat = np.append(0, np.cumsum(own.value_lengths().to_numpy())), own.flatten()
                for first, of, item, product in hot_rows.products(bounds, flat.field("u").to_numpy(), flat.field("w").to_numpy()):
                    i = np.repeat(place[first : first + len(of) - 1], np.diff(of))
                    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(item.astype(np.int32)), pa.array(product)], names=["i", "j", "g"])

        found = of_hot.groupBy("h").agg(F.collect_list(F.struct("u", "w")).alias("own")).mapInArrow(squares, "i int, j int, g double").toArrow()
        # a last row and column of zeros stands for all other items
        gram = np.zeros((len(hot) + 1, len(hot) + 1))
        gram[found.column("i").to_numpy(), found.column("j").to_numpy()] = found.column("g").to_numpy()
        place = np.full(n_items, len(hot), np.int32)
        place[hot] = np.arange(len(hot))
        return cold, hot_rows, spark.sparkContext.broadcast((place, gram)), users


def products_among(items: list[np.ndarray], size: int, cold: SharedRows, hot_rows: SharedRows, hot: tuple[np.ndarray, np.ndarray], n_users: int) -> np.ndarray:
    """[list, size, size] the products among the items of each list.

    Those of two frequent items are known. All others are made by the users of the lists' other items.
    """
    place, known = hot
    many, none = len(items), len(known) - 1
    n = np.array([len(i) for i in items])
    job, flat = np.repeat(np.arange(many), n), np.concatenate(items)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    spot = np.full((many, size), none)
    spot[job, at] = place[flat]
    frequent = spot < none
    out = known[spot[:, :, None], spot[:, None, :]]
    other = np.flatnonzero(place[flat] == none)
    of, user, value = cold.entries(flat[other])
    code, row = np.unique(job[other][of] * n_users + user, return_inverse=True)
    # where a frequent item stands in a list
    stands = np.full((many, none), -1, np.int32)
    stands[np.nonzero(frequent)[0], spot[frequent]] = np.nonzero(frequent)[1]
    of_row, h, hot_value = hot_rows.entries(code % n_users)
    column = stands[code[of_row] // n_users, h]
    met = column >= 0
    row, column, value = np.append(row, of_row[met]), np.append(at[other][of], column[met]), np.append(value, hot_value[met])
    order = np.argsort(row, kind="stable")
    row, column, value = row[order], column[order], value[order]
    sums = np.zeros((many, size, size))
    step = max(1, BATCH_NUMBERS // size)
    starts = np.searchsorted(code, np.arange(many + 1) * n_users)
    for low in range(0, len(code), step):
        high = min(len(code), low + step)
        part = slice(*np.searchsorted(row, [low, high]))
        dense = np.zeros((high - low, size))
        dense[row[part] - low, column[part]] = value[part]
        for r in range(int(code[low] // n_users), int(code[high - 1] // n_users) + 1):
            rows = dense[max(0, starts[r] - low) : max(0, starts[r + 1] - low)]
            sums[r] += rows.T @ rows
    return np.where(frequent[:, :, None] & frequent[:, None, :], out, sums)


def _nearest_jobs(matrix: LargeMatrix, config: LinearConfig, solved: Callable[[list[tuple]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (c, own): what `solved` gives for lists of (target, neighbours, products)."""
    by_user = matrix.numbered.by_user

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        jobs: list[tuple] = []
        for b in batches:
            target, own = b.column("c").to_numpy(), b.column("own")
            bounds, flat = np.append(0, np.cumsum(own.value_lengths().to_numpy())), own.flatten()
            for first, of, item, product in by_user.products(bounds, flat.field("u").to_numpy(), flat.field("w").to_numpy()):
                for r in range(len(of) - 1):
                    j = int(target[first + r])
                    near, g = nearest(item[of[r] : of[r + 1]], product[of[r] : of[r + 1]], j, config.neighbours)
                    if len(near):
                        jobs.append((j, near, g))
                if sum(len(job[1]) for job in jobs) >= JOBS:
                    yield from solved(jobs)
                    jobs = []
        yield from solved(jobs)

    return run


def _alike(jobs: list[tuple]) -> Iterator[tuple[list[tuple], int, np.ndarray]]:
    """(jobs, size, [job, size] products): jobs with about as many neighbours together, as many as memory allows."""
    jobs = sorted(jobs, key=lambda job: len(job[1]))
    at = 0
    while at < len(jobs):
        upto = at + 1
        while upto < len(jobs) and upto - at < LARGE_BATCH and (upto + 1 - at) * len(jobs[upto][1]) ** 2 <= BATCH_NUMBERS:
            upto += 1
        part, size = jobs[at:upto], len(jobs[upto - 1][1])
        y = np.zeros((len(part), size))
        for r, (_, near, g, *_) in enumerate(part):
            y[r, : len(near)] = g
        yield part, size, y
        at = upto


def _fit_by_tables(x: DataFrame, config: LinearConfig, n_users: int, targets: DataFrame | None, matrix: LargeMatrix | None = None, whole: bool = False) -> DataFrame:
    matrix = matrix or LargeMatrix(x)
    near = matrix.near(config, n_users, targets, whole)
    found = near.found
    if found.isEmpty():
        return _no_weights(x)
    among = near.among

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bounds = np.append(0, np.cumsum(b.column("near").value_lengths().to_numpy()))
            near, g = (b.column(c).flatten().to_numpy() for c in ("near", "g"))
            jobs = [(j, near[at:to], g[at:to]) for j, (at, to) in zip(b.column("c").to_numpy().tolist(), itertools.pairwise(bounds.tolist()))]
            for part, size, y in _alike(jobs):
                w = config.solve(among([near for _, near, _ in part], size), y, n_users)
                src = np.zeros((len(part), size), np.int32)
                for r, (_, near_r, _) in enumerate(part):
                    src[r, : len(near_r)] = near_r
                dst = np.array([j for j, *_ in part], np.int32)
                r, place = np.nonzero(w)
                yield pa.RecordBatch.from_arrays([pa.array(src[r, place]), pa.array(dst[r]), pa.array(w[r, place])], names=["src", "dst", "weight"])

    weights = spread(found).mapInArrow(solved, "src int, dst int, weight double")
    return matrix.numbered.named(weights, "src", "dst").select("src", "dst", "weight")


def _no_weights(x: DataFrame) -> DataFrame:
    kind = dict(x.dtypes)["item"]
    return x.sparkSession.createDataFrame([], f"src {kind}, dst {kind}, weight double")


def violations(x: DataFrame, sim: DataFrame, config: LinearConfig, n_users: int, matrix: LargeMatrix | None = None) -> DataFrame:
    """(dst, violation): by target with neighbours, how far its weights are from the conditions of the optimum, as a share
    of the penalty. For positive weights.

    The slope of the fit less the ridge term equals the penalty where a weight is positive, and doesn't exceed it elsewhere.
    A target without weights, none of whose products exceeds the penalty, is at its optimum and needs no products among
    its neighbours, nor its own where they can't reach it. matrix: of the same x, with the neighbours of an earlier fit.
    """
    x = x.where("user is not null and item is not null and weight is not null").select("user", "item", F.col("weight").cast("double").alias("weight"))
    matrix = matrix or LargeMatrix(x)
    numbered = matrix.numbered
    l1, l2 = config.alpha * config.l1_ratio, config.alpha * (1 - config.l1_ratio)
    of = lambda side: numbered.names.select(F.col("item").alias(side), F.col("c").cast("int").alias(f"{side}_c"))
    codes = sim.where("weight <> 0").join(of("src"), "src").join(of("dst"), "dst")
    weights = materialize(codes.groupBy(F.col("dst_c").alias("c")).agg(F.collect_list(F.struct(F.col("src_c").alias("c"), F.col("weight").alias("w"))).alias("weights")), "weights")
    near = matrix.near(config, n_users, _reachable(x, config, n_users, None), True)
    more = weights.join(near.found, "c", "left_anti").select("c")
    if not more.isEmpty():  # targets with weights though nothing explains them
        near = Neighbours(numbered, materialize(near.found.unionByName(matrix.listed(config, more, lambda product: True)), "near"))
    among = None if weights.isEmpty() else near.among

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, out = [], []
            bounds = np.append(0, np.cumsum(b.column("near").value_lengths().to_numpy()))
            items, products = (b.column(c).flatten().to_numpy() for c in ("near", "g"))
            for j, (at, to), own in zip(b.column("c").to_numpy().tolist(), itertools.pairwise(bounds.tolist()), b.column("weights")):
                if own.is_valid:
                    held.append((j, items[at:to], products[at:to], own))
                else:
                    out.append((j, max(0.0, float(products[at:to].max()) / n_users - l1)))
            for part, size, y in _alike(held):
                w = np.zeros((len(part), size))
                for r, (_, near, _, own) in enumerate(part):
                    of = dict(zip(near.tolist(), range(len(near))))
                    for e in own.as_py():
                        if e["c"] in of:
                            w[r, of[e["c"]]] = e["w"]
                slope = (y - np.einsum("bij,bj->bi", among([near for _, near, *_ in part], size), w)) / n_users - l2 * w
                off = np.where(w > 0, np.abs(slope - l1), np.maximum(slope - l1, 0))
                out += zip((j for j, *_ in part), off.max(axis=1).tolist())
            yield pa.RecordBatch.from_arrays([pa.array([j for j, _ in out], pa.int32()), pa.array([v / l1 for _, v in out], pa.float64())], names=["dst", "violation"])

    judge = spread(near.found).join(weights, "c", "left").select("c", "near", "g", "weights")
    found = judge.mapInArrow(judged, "dst int, violation double")
    free = numbered.accompanied().join(near.found, "c", "left_anti").select(F.col("c").alias("dst"), F.lit(0.0).alias("violation"))
    return found.unionByName(free).withColumnRenamed("dst", "dst_c").join(of("dst"), "dst_c").select("dst", "violation")


def refit(sim: DataFrame, x: DataFrame, touched: DataFrame, config: LinearConfig = LinearConfig(), n_users: int | None = None, matrix: LargeMatrix | None = None) -> DataFrame:
    """sim with the whole columns of the touched items solved anew."""
    fresh = fit(x, config, n_users, touched, matrix)
    return sim.join(touched.select(F.col("item").alias("dst")).distinct(), "dst", "left_anti").select("src", "dst", "weight").unionByName(fresh)


def scores(x: DataFrame, sim: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """(user, item, score): X W of the given users, non-zero entries."""
    if users is not None:
        x = x.join(users.select("user").distinct(), "user", "left_semi")
    joined = x.withColumnRenamed("item", "src").withColumnRenamed("weight", "x").join(sim, "src")
    return joined.groupBy("user", F.col("dst").alias("item")).agg(F.sum(F.col("x") * F.col("weight")).alias("score"))


def recommend(x: DataFrame, sim: DataFrame, users: DataFrame, k: int, candidates: DataFrame | None = None, exclude_seen: bool = True, pad_zero: bool = False, digits: int | None = None) -> DataFrame:
    """(user, item, score, rank). Given candidates, seen items stay in. With pad_zero items without a score count as 0.

    digits: scores are rounded to so many before they are ranked, so that the order of summation decides no tie.

    Weights of at most SHARED_ENTRIES entries are shared with every task, which then scores, leaves out and ranks the
    items of its users on its own; beyond that they are shared in parts, or, with candidates or padding, the product is
    a join, whose hot items Spark's skew join divides.
    Padding needs only the first items that a user lacks: the k + m smallest items, m the user's scored and seen ones.
    """
    if sim.limit(SHARED_ENTRIES + 1).count() <= SHARED_ENTRIES:
        return _recommend_shared(x, sim, users, k, candidates, exclude_seen, pad_zero, digits)
    if candidates is None and not pad_zero:
        return _recommend_in_parts(x, sim, users, k, exclude_seen, digits)
    out = scores(x, sim, users)
    if digits is not None:
        out = out.withColumn("score", F.round("score", digits))
    if candidates is not None:
        known = x.select("item").distinct()
        usable = ranking.restrict(out, candidates, known)
        return ranking.top_k(usable, k)
    if exclude_seen:
        out = ranking.exclude_seen(out, x)
    if pad_zero:
        asked = users.select("user").distinct()
        used = out.select("user", "item")
        if exclude_seen:
            used = used.union(x.select("user", "item").join(asked, "user", "left_semi")).distinct()
        # the first item that a user lacks is at most as far on as the user has items: places up to the user's own number
        places = numbered(x.select("item").distinct(), ["item"], "place")
        need = asked.join(used.groupBy("user").agg(F.count(F.lit(1)).alias("m")), "user", "left").select("user", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("m", F.lit(0)) + F.lit(k - 1))).alias("place"))
        blanks = need.join(places, "place").join(used, ["user", "item"], "left_anti").select("user", "item", F.lit(0.0).alias("score"))
        out = out.unionByName(blanks)
    return ranking.top_k(out, k)


def _recommend_shared(x: DataFrame, sim: DataFrame, users: DataFrame, k: int, candidates: DataFrame | None, exclude_seen: bool, pad_zero: bool, digits: int | None) -> DataFrame:
    spark, kinds = x.sparkSession, dict(x.dtypes)
    held = sim.toArrow()
    columns = [held.column(c).combine_chunks() for c in ("src", "dst")]
    usable = None
    if candidates is not None:
        # candidates that the matrix holds; without any, all items are usable
        found = candidates.select("item").distinct().join(x.select("item").distinct(), "item", "left_semi")
        usable = found.join(sim.select(F.col("dst").alias("item")).distinct(), "item", "left_semi").toArrow().column("item").combine_chunks()
        usable = usable if len(usable) or not found.isEmpty() else None
    pad = pad_zero and candidates is None
    # an item without weights can only be a padding: the first ones in order, past the longest list of a user
    extra = []
    if pad:
        most = x.groupBy("user").agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0] or 0
        extra = [x.select("item").distinct().orderBy("item").limit(k + most + len(pa.compute.unique(columns[1]))).toArrow().column("item").combine_chunks()]
    names = pa.compute.unique(pa.concat_arrays([*columns, *extra]))
    names = names.take(pa.compute.sort_indices(names))
    src, dst = (pa.compute.index_in(c, names).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    matrix = Matrix(src, dst, held.column("weight").to_numpy(), len(names), len(names))
    allowed = np.ones(len(names), bool) if usable is None else pa.compute.is_in(names, usable).to_numpy(zero_copy_only=False)
    paddings = np.sort(pa.compute.index_in(extra[0], names).to_numpy(zero_copy_only=False)) if pad else np.zeros(0, np.int64)
    shared = spark.sparkContext.broadcast((matrix.rows, names, allowed, paddings))
    leave_out = exclude_seen and candidates is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (start, index, weight), names, allowed, paddings = shared.value
        for b in batches:
            own = b.column("own")
            bounds = np.append(0, np.cumsum(own.value_lengths().to_numpy()))
            flat = own.flatten()
            code = pa.compute.fill_null(pa.compute.index_in(flat.field("item"), names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            value = flat.field("w").to_numpy(zero_copy_only=False)
            user, found, score, rank = [], [], [], []
            for r in range(b.num_rows):
                mine, w = code[bounds[r] : bounds[r + 1]], value[bounds[r] : bounds[r + 1]]
                known = mine >= 0
                mine, w = mine[known], w[known]
                length = start[mine + 1] - start[mine]
                at = np.repeat(start[mine] - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())
                item, s = summed(index[at], weight[at] * np.repeat(w, length), len(names))
                if digits is not None:
                    s = np.round(s, digits)
                if len(paddings):
                    # as many as could be needed if all of the user's items and scored ones stood first
                    more = np.setdiff1d(paddings[: k + len(item) + len(mine)], item, assume_unique=True)
                    item, s = np.append(item, more), np.append(s, np.zeros(len(more)))
                keep = allowed[item]
                if leave_out:
                    keep &= ~np.isin(item, mine)
                item, s = item[keep], s[keep]
                if len(item) > k:
                    near = np.flatnonzero(s >= np.partition(s, -k)[-k])
                    item, s = item[near], s[near]
                order = np.lexsort((item, -s))[:k]
                user.append(np.full(len(order), r))
                found.append(item[order])
                score.append(s[order])
                rank.append(np.arange(1, len(order) + 1, dtype=np.int32))
            if user:
                yield pa.RecordBatch.from_arrays([b.column("user").take(pa.array(np.concatenate(user))), names.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(score)), pa.array(np.concatenate(rank))], names=["user", "item", "score", "rank"])

    rows = x.select("user", F.struct("item", F.col("weight").cast("double").alias("w")).alias("e")).join(users.select("user").distinct(), "user", "left_semi" if not pad else "right")
    if not pad:
        # items without weights in either place decide nothing
        used = sim.select(F.col("src").alias("item")).union(sim.select(F.col("dst").alias("item"))).distinct()
        rows = rows.join(F.broadcast(used), F.col("e.item") == used["item"], "left_semi")
    lists = rows.groupBy("user").agg(F.collect_list("e").alias("own"))
    return lists.select("user", "own").mapInArrow(run, f"user {kinds['user']}, item {kinds['item']}, score double, rank int")


def _recommend_in_parts(x: DataFrame, sim: DataFrame, users: DataFrame, k: int, exclude_seen: bool, digits: int | None) -> DataFrame:
    """The weights are shared by rows in parts; a task scores all items of its users and keeps k of each."""
    kinds = dict(x.dtypes)
    x = materialize(x.select("user", "item", F.col("weight").cast("double").alias("w")).join(users.select("user").distinct(), "user", "left_semi"), "matrix")
    names, n = numbers_of(x.select("item").union(sim.select("src")).union(sim.select("dst")), "item", "c")
    of = lambda side: names.select(F.col("item").alias(side), F.col("c").alias(f"{side}_c"))
    weights = SharedRows(coded(coded(sim, of("src"), n, "src", "src_c"), of("dst"), n, "dst", "dst_c").select(F.col("src_c").alias("r"), F.col("dst_c").alias("c"), F.col("weight").alias("v")), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("own")
            bounds, flat = np.append(0, np.cumsum(own.value_lengths().to_numpy())), own.flatten()
            mine = flat.field("c").to_numpy()
            for first, of, item, s in weights.products(bounds, mine, flat.field("w").to_numpy(zero_copy_only=False)):
                if digits is not None:
                    s = np.round(s, digits)
                user = np.repeat(np.arange(len(of) - 1), np.diff(of))
                if exclude_seen:
                    held = slice(bounds[first], bounds[first + len(of) - 1])
                    seen = np.repeat(np.arange(len(of) - 1), np.diff(bounds[first : first + len(of)])) * n + mine[held]
                    left = ~np.isin(user * n + item, seen)
                    user, item, s = user[left], item[left], s[left]
                best = [nearest(item[i:j], s[i:j], -1, k) for i, j in itertools.pairwise(np.searchsorted(user, np.arange(len(of))).tolist())]
                user = np.repeat(np.arange(len(best)), [len(i) for i, _ in best])
                item, s = (np.concatenate(c) for c in zip(*best))
                order = np.lexsort((item, -s, user))
                rank = np.arange(len(user)) - np.searchsorted(user, user) + 1
                yield pa.RecordBatch.from_arrays([b.column("user").take(pa.array(first + user)), pa.array(item[order]), pa.array(s[order]), pa.array(rank.astype(np.int32))], names=["user", "c", "score", "rank"])

    lists = coded(x, names, n, "item", "c").groupBy("user").agg(F.collect_list(F.struct("c", "w")).alias("own"))
    found = lists.mapInArrow(run, f"user {kinds['user']}, c long, score double, rank int")
    return coded(found, names, n, "c", "item").select("user", "item", "score", "rank")


def similar_items(sim: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(query, item, score, rank): the sources with the largest weights in each query's column; unknown items have none."""
    asked = sim.join(items.select(F.col("item").alias("dst")).distinct(), "dst", "left_semi").where("src <> dst and weight <> 0")
    return ranking.top_k(asked.select(F.col("dst").alias("query"), F.col("src").alias("item"), F.col("weight").alias("score")), k, by="query")
