"""Filling containers of fixed capacity with texts: pattern packing by non-negative least squares.

Only the histogram of lengths, at most `capacity` counts, comes to the driver, so planning costs the same for any
corpus. Lengths are put into buckets; patterns of few documents whose buckets fill a container exactly are
enumerated; non-negative least squares fits how often each pattern repeats, with the misfit of long documents
weighing more; the counts are rounded down and given real documents. The residual documents go, longest first, into
the tightest space that is left, in whole blocks of equal containers, and into new containers when none fits.

The plan is a list of rank intervals by length. Every document finds its container from the rank it has among the
documents of its length, which is counted in salted groups so that one length may hold any share of the corpus.

Defined results: a null or empty text has no tokens and goes into no container; a text longer than the capacity is
divided into full containers and a remainder, every other text stays whole; repeated texts and ids are packed like
any other; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, shuffle_partitions, spread
from .tokens import VOCABULARY, count_tokens

CAPACITY = 2048
BUCKETS = 64
DOCUMENTS_OF_A_PATTERN = 4


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 600) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active set method."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(steps):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= tol:
            break
        active[j] = True
        while True:
            s = np.zeros_like(x)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if s[active].min(initial=1) > 0:
                x = s
                break
            out = active & (s <= 0)
            step = float((x[out] / (x[out] - s[out] + 1e-300)).min())
            x = np.maximum(x + step * (s - x), 0)
            active &= x > 1e-12
            if not active.any():
                break
    return x


def patterns(buckets: int, most: int) -> list[tuple[int, ...]]:
    """The multisets of at most `most` bucket numbers 1..buckets whose sum is `buckets`, largest first."""

    def parts(total: int, largest: int, left: int) -> Iterator[tuple[int, ...]]:
        if total == 0:
            yield ()
        elif left:
            for k in range(min(total, largest), 0, -1):
                if k * left >= total:
                    yield from ((k, *rest) for rest in parts(total - k, k, left - 1))

    return list(parts(buckets, buckets, most))


@dataclass
class Block:
    """Equal containers: how many, the space left in each, and (length, documents of it) in each."""

    n: int
    space: int
    slots: list[tuple[int, int]]


def plan_blocks(histogram: np.ndarray, capacity: int, buckets: int = BUCKETS, most: int = DOCUMENTS_OF_A_PATTERN) -> list[Block]:
    """Blocks of containers that hold all documents; histogram[L] documents have L tokens, 1 <= L <= capacity."""
    left = histogram.astype(np.int64).copy()
    buckets = min(buckets, capacity)
    width = -(-capacity // buckets)
    buckets = capacity // width
    bucket = -(-np.arange(capacity + 1) // width)  # of a length, rounded up
    bucket[bucket > buckets] = buckets + 1  # those fill a container nearly alone
    found = patterns(buckets, most)
    a = np.zeros((buckets, len(found)))
    for j, p in enumerate(found):
        for k in p:
            a[k - 1, j] += 1
    have = np.array([left[bucket == k].sum() for k in range(1, buckets + 1)], float)
    weight = np.sqrt(np.arange(1, buckets + 1) / buckets)
    repeats = np.floor(nnls(a * weight[:, None], have * weight) + 1e-9).astype(np.int64) if have.any() else np.zeros(len(found), np.int64)

    # lengths of each bucket, longest first; patterns take their documents from the front
    lengths = {k: [int(x) for x in np.flatnonzero((bucket == k) & (left > 0))[::-1] if x] for k in range(1, buckets + 1)}
    blocks: list[Block] = []
    for j in sorted(np.flatnonzero(repeats), key=lambda j: -found[j][0]):
        todo = int(repeats[j])
        while todo > 0:
            taken: dict[int, int] = defaultdict(int)
            for k in found[j]:
                x = next((x for x in lengths[k] if left[x] > taken[x]), None)
                if x is None:
                    todo = 0
                    break
                taken[x] += 1
            if not todo:
                break
            n = min(todo, *(int(left[x]) // c for x, c in taken.items()))
            for x, c in taken.items():
                left[x] -= n * c
            for k in set(found[j]):
                lengths[k] = [x for x in lengths[k] if left[x] > 0]
            blocks.append(Block(n, capacity - sum(x * c for x, c in taken.items()), list(taken.items())))
            todo -= n

    by_space: dict[int, list[Block]] = defaultdict(list)
    for b in blocks:
        by_space[b.space].append(b)
    for x in range(capacity, 0, -1):
        n = int(left[x])
        while n > 0:
            space = next((s for s in range(x, capacity + 1) if by_space.get(s)), None)
            if space is None:
                each = min(capacity // x, n)
                fresh = Block(n // each, capacity - each * x, [(x, each)])
                by_space[fresh.space].append(fresh)
                n -= fresh.n * each
                continue
            b = by_space[space].pop()
            each = min(space // x, n)
            use = min(b.n, n // each)
            if use < b.n:
                by_space[space].append(Block(b.n - use, space, list(b.slots)))
            filled = Block(use, space - each * x, [*b.slots, (x, each)])
            by_space[filled.space].append(filled)
            n -= use * each
    return [b for at in sorted(by_space) for b in by_space[at]]


def intervals(blocks: list[Block]) -> np.ndarray:
    """Rows (length, first rank, documents a container, first container), sorted by length and rank."""
    nxt: dict[int, int] = defaultdict(int)
    rows, container = [], 0
    for b in blocks:
        for x, each in b.slots:
            rows.append((x, nxt[x], each, container))
            nxt[x] += b.n * each
        container += b.n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def cut(tokens: DataFrame, key: str, capacity: int) -> DataFrame:
    """(key, part, first_token, n_tokens): one row per text, or several full parts and a remainder for a longer one."""
    last = ((F.col("n_tokens") - 1) / capacity).cast("long")
    parts = tokens.where("n_tokens > 0").select(F.col(key), "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    first = F.col("part") * capacity
    return parts.select(F.col(key), "part", first.alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - first).alias("n_tokens"))


def pack(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, part, first_token, n_tokens, container_id): every part of every text and the container it goes into."""
    spark = df.sparkSession
    tokens = materialize(count_tokens(spread(df.select(key, text)), text, [key], vocabulary), "tokens")
    parts = cut(tokens, key, capacity)
    # as many cells for a length as its share asks for: at most 4 P + capacity in all, with P shuffle partitions
    sizes = np.zeros(capacity + 1, np.int64)
    for r in parts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["n_tokens"]] = r["n"]
    many = np.maximum(1, -(-4 * shuffle_partitions(spark) * sizes // max(1, sizes.sum())))
    first = np.cumsum(many) - many
    cells = spark.createDataFrame([(n, int(first[n]), int(many[n])) for n in np.flatnonzero(sizes).tolist()], "n_tokens long, first int, many int")
    parts = parts.join(F.broadcast(cells), "n_tokens").withColumn("cell", F.col("first") + F.pmod(F.xxhash64(key, "part"), F.col("many")).cast("int"))
    counts = np.zeros(int(many.sum()), np.int64)
    for r in parts.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["cell"]] = r["n"]
    plan = intervals(plan_blocks(sizes, capacity))
    # parts of the same length in earlier cells
    before = np.cumsum(counts) - counts
    before -= np.repeat(before[first], many)
    w = Window.partitionBy("cell").orderBy(key, "part")
    ranked = parts.withColumn("r", F.row_number().over(w))
    plan_b, before_b = spark.sparkContext.broadcast(plan), spark.sparkContext.broadcast(before)
    span = 1 << 40
    names = [key, "part", "first_token", "n_tokens", "container_id"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = plan_b.value
        starts = rows[:, 0] * span + rows[:, 1]
        for b in batches:
            length = b.column("n_tokens").to_numpy()
            rank = before_b.value[b.column("cell").to_numpy()] + b.column("r").to_numpy() - 1
            row = rows[np.searchsorted(starts, length * span + rank, side="right") - 1]
            container = row[:, 3] + (rank - row[:, 1]) // row[:, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-1]), pa.array(container)], names=names)

    kind = dict(df.dtypes)[key]
    return ranked.select(*names[:-1], "cell", "r").mapInArrow(place, f"`{key}` {kind}, part long, first_token long, n_tokens long, container_id long")


def pack_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, least_possible, tokens, fill): how full the containers are."""
    of = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    out = of.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.max("n"), F.lit(0)).alias("fullest"))
    return out.select("containers", F.ceil(F.col("tokens") / capacity).alias("least_possible"), "tokens", "fullest", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("containers") * capacity), F.lit(0.0)).alias("fill"))
