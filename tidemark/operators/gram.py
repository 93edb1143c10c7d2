"""Item-item Gram matrix X'X of (user, item, weight), without emitting the pairs of a user one by one.

Users up to BLOCK items are handed to tasks as lists; a task adds the products of all its users up before anything is
shuffled. The items of a larger user are cut into blocks, and each pair of blocks is a unit of its own.

Where only the nearest items are asked (nearest_items), the products stay in the tasks: each takes items with their
users, and reads the users' rows in a matrix that all tasks share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialize
from .shared import SharedRows, coded, numbers_of

BLOCK = 512
HELD = 1_000_000


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of left x right products (or of left x left from the diagonal up where right is null) over a task."""
    index: dict = {}
    keys: list[np.ndarray] = []
    sums: list[np.ndarray] = []
    held = 0

    def encode(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = column.flatten()
        coded = flat.field("item").dictionary_encode()
        code = np.array([index.setdefault(v, len(index)) for v in coded.dictionary.to_pylist()], np.int64)
        return code[coded.indices.to_numpy()], flat.field("w").to_numpy(zero_copy_only=False), np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))

    def add(a: np.ndarray, b: np.ndarray, product: np.ndarray) -> None:
        nonlocal held
        keys.append(((np.minimum(a, b) << 32) | np.maximum(a, b)).ravel())
        sums.append(product.ravel())
        held += product.size
        if held > 4 * HELD:
            merge()

    def merge() -> None:
        nonlocal keys, sums, held
        code, at = np.unique(np.concatenate(keys), return_inverse=True)
        keys, sums = [code], [np.bincount(at, np.concatenate(sums), len(code))]
        held = len(code)

    def flush() -> pa.RecordBatch:
        nonlocal keys, sums, held
        merge()
        items = pa.array(list(index))
        out = pa.RecordBatch.from_arrays([items.take(pa.array(keys[0] >> 32)), items.take(pa.array(keys[0] & 0xFFFFFFFF)), pa.array(sums[0])], names=["i", "j", "g"])
        keys, sums, held = [], [], 0
        index.clear()
        return out

    for b in batches:
        left, lw, lo = encode(b.column("left"))
        right, rw, ro = encode(b.column("right"))
        size, other = np.diff(lo), np.diff(ro)
        for r in np.flatnonzero(other).tolist():
            x, y = slice(lo[r], lo[r + 1]), slice(ro[r], ro[r + 1])
            add(left[x][:, None], right[y][None, :], lw[x][:, None] * rw[y][None, :])
        # users with as many items are multiplied out together
        for k in np.unique(size[(other == 0) & (size > 0)]).tolist():
            rows = np.flatnonzero((size == k) & (other == 0))
            p, q = np.triu_indices(k)
            for part in np.array_split(rows, max(1, len(rows) * len(p) // HELD)):
                at = lo[part][:, None] + np.arange(k)
                x, w = left[at], lw[at]
                add(x[:, p], x[:, q], w[:, p] * w[:, q])
        if held > 2 * HELD:
            merge()
            if held > 2 * HELD:
                yield flush()
    if keys:
        yield flush()


def gram(x: DataFrame, block: int = BLOCK) -> DataFrame:
    """(i, j, g): all non-zero sums over users of w_i w_j, in both orders and on the diagonal. x is unique by (user, item)."""
    return both_orders(gram_half(x, block))


def both_orders(half: DataFrame) -> DataFrame:
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return half.select("g", F.inline(both)).select("i", "j", "g")


def gram_half(x: DataFrame, block: int = BLOCK) -> DataFrame:
    """The products of gram with i <= j."""
    kind = dict(x.dtypes)["item"]
    rows = x.where("user is not null and item is not null and weight is not null").select("user", F.struct("item", F.col("weight").cast("double").alias("w")).alias("e"))
    large = rows.groupBy("user").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("user", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    has_large = bool(large.take(1))
    none = F.array().cast(f"array<struct<item:{kind},w:double>>")
    small = rows.join(large, "user", "left_anti") if has_large else rows
    units = small.groupBy("user").agg(F.collect_list("e").alias("left")).select("left", none.alias("right"))
    if has_large:
        own = rows.join(large, "user").withColumn("own", F.pmod(F.xxhash64("e.item"), F.col("blocks")).cast("int"))
        each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        first = F.col("own") <= F.col("other")
        lists = each.groupBy("user", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).agg(F.collect_list(F.when(first, F.col("e"))).alias("left"), F.collect_list(F.when(~first, F.col("e"))).alias("right"))
        units = units.unionByName(lists.where("a = b or (size(left) > 0 and size(right) > 0)").select("left", "right"))
    half = units.mapInArrow(_products, f"i {kind}, j {kind}, g double")
    lower, upper = F.least("i", "j"), F.greatest("i", "j")
    return half.groupBy(lower.alias("i"), upper.alias("j")).agg(F.sum("g").alias("g"))


def neighbours(g: DataFrame, n: int) -> DataFrame:
    """(dst, src, g, rank): the n items with the largest products with dst, itself aside; ties to the smaller item."""
    w = Window.partitionBy("j").orderBy(F.desc("g"), F.asc("i"))
    return g.where("i <> j").select(F.col("j").alias("dst"), F.col("i").alias("src"), "g", F.row_number().over(w).alias("rank")).where(F.col("rank") <= n)


def nearest(item: np.ndarray, product: np.ndarray, j: int, n: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The n items with the largest products, j itself aside; ties to the smaller item."""
    other = item != j
    item, product = item[other], product[other]
    if n is not None and len(item) > n:
        least = np.partition(product, -n)[-n]
        keep = np.flatnonzero(product >= least)
        keep = np.sort(keep[np.lexsort((item[keep], -product[keep]))[:n]])
        item, product = item[keep], product[keep]
    return item, product


class Numbered:
    """x(user, item, weight), unique by (user, item), with numbers in place of names: entries(u, c, w), names(item, c)."""

    def __init__(self, x: DataFrame):
        own = x.where("user is not null and item is not null and weight is not null").select("user", "item", F.col("weight").cast("double").alias("w"))
        written = "written_at" in vars(x)
        x = own if written else materialize(own, "matrix")
        self.names, self.n_items = numbers_of(x, "item", "c")
        users, n_users = numbers_of(x, "user", "u")
        self.n_users = n_users
        self.entries = materialize(coded(coded(x, users, n_users, "user", "u"), self.names, self.n_items, "item", "c").select("u", F.col("c").cast("int").alias("c"), "w"), "entries")
        if not written:
            discard(x)
        self.by_user = SharedRows(self.entries.select(F.col("u").alias("r"), "c", F.col("w").alias("v")), self.n_items)

    def discard(self) -> None:
        """Give up what was written; nothing that reads it may be left to run."""
        self.by_user.discard()
        discard(self.entries)

    @property
    def columns(self) -> DataFrame:
        """(c, own): the users of every item and their weights."""
        return self.entries.groupBy("c").agg(F.collect_list(F.struct("u", "w")).alias("own"))

    def accompanied(self) -> DataFrame:
        """(c): the items that share a user with another item."""
        alone = self.entries.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("c")).where("n = 1").groupBy("c").agg(F.count(F.lit(1)).alias("alone"))
        return self.entries.groupBy("c").agg(F.count(F.lit(1)).alias("n")).join(alone, "c", "left").where("n > coalesce(alone, 0)").select("c")

    def nearest(self, n: int, digits: int | None = None, columns: DataFrame | None = None) -> DataFrame:
        """(dst, src, g, rank) by number, as nearest_items."""
        by_user = self.by_user

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                target, own = b.column("c").to_numpy(), b.column("own")
                bounds, flat = np.append(0, np.cumsum(own.value_lengths().to_numpy())), own.flatten()
                for first, of, item, product in by_user.products(bounds, flat.field("u").to_numpy(), flat.field("w").to_numpy()):
                    if digits is not None:
                        product = np.round(product, digits)
                    dst, src, g, rank = [], [], [], []
                    for r in range(len(of) - 1):
                        j = int(target[first + r])
                        i, p = nearest(item[of[r] : of[r + 1]], product[of[r] : of[r + 1]], j, n)
                        order = np.lexsort((i, -p))
                        dst.append(np.full(len(i), j, np.int32))
                        src.append(i[order])
                        g.append(p[order])
                        rank.append(np.arange(1, len(i) + 1, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(dst)), pa.array(np.concatenate(src).astype(np.int32)), pa.array(np.concatenate(g)), pa.array(np.concatenate(rank))], names=["dst", "src", "g", "rank"])

        return (self.columns if columns is None else columns).mapInArrow(run, "dst int, src int, g double, rank int")

    def named(self, df: DataFrame, *columns: str) -> DataFrame:
        """df with the items' names in place of the numbers in the given columns."""
        for c in columns:
            df = coded(df, self.names.select(F.col("c").cast("int").alias(c), F.col("item").alias("__item")), self.n_items, c, "__item").withColumn(c, F.col("__item")).drop("__item")
        return df


def nearest_items(x: DataFrame, n: int, digits: int | None = None) -> DataFrame:
    """neighbours(gram(x), n) without writing the products; with digits they are rounded before they are ranked."""
    numbered = Numbered(x)
    return numbered.named(numbered.nearest(n, digits), "dst", "src").select("dst", "src", "g", "rank")
