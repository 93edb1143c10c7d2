"""Items that appear together: exact pair counts against a fitted bipartite configuration null.

Counting. A basket is a set of distinct items. Baskets up to BLOCK items are counted where they lie: a task adds up the pairs of all its baskets before anything is shuffled. A larger basket is cut into blocks of items, and every
pair of blocks is a unit of its own, so no task ever holds a whole large basket.

Null. In the bipartite configuration model an item of frequency f is in a basket of size k with probability
x_k y_f / (1 + x_k y_f), where x and y are fitted so that expected sizes and frequencies equal the observed ones;
there is one unknown per distinct size and frequency, so the fit costs as little for any number of baskets. The
number of common baskets of a pair is then Poisson-binomial. Its upper tail is the Lugannani-Rice saddlepoint
approximation with continuity correction over the size classes, which keeps its relative precision far out in the
tail, where sums of exact terms lose theirs.

False discovery. Benjamini-Hochberg over all pairs of items, counted or not; the ranks come from a histogram of the
tails of all pairs that meet, with bins of 1/100 of a decade, rounded to the safe side; what is asked for is picked
afterwards, so a pair's q value doesn't depend on it.

Defined results: rows with a null basket key or item are ignored; repeated rows count once; a basket of one item
counts as a basket; an empty table gives no pairs; frequencies above 512 enter the null to three digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BLOCK = 512
#: Items up to this number are broadcast with their frequencies; beyond that Spark's skew join divides frequent ones.
SHARED_ITEMS = 1_000_000
HELD_PAIRS = 1_000_000
BINS_A_DECADE = 100
DEEPEST = 1000  # decades; smaller tails share the last bin


# -- the null model ---------------------------------------------------------------------------------------------


def coarse(f: np.ndarray) -> np.ndarray:
    """Frequencies to three digits above 512, so that there are few classes."""
    f = np.asarray(f, float)
    unit = 10.0 ** np.maximum(0, np.floor(np.log10(np.maximum(f, 1))) - 2)
    return np.where(f > 512, np.round(f / unit) * unit, f)


class Null:
    """The fitted model: classes of basket sizes with x, and of frequencies with y."""

    def __init__(self, sizes: dict[int, int], frequencies: dict[int, int], rounds: int = 2000, tol: float = 1e-9):
        # sizes in classes too: within a class no size is further than half a percent from the mean that stands for it
        each = np.array(sorted(sizes), float)
        baskets = np.array([sizes[k] for k in sorted(sizes)], float)
        of = np.unique(coarse(each), return_inverse=True)[1] if len(each) else np.zeros(0, np.int64)
        self.m = np.bincount(of, baskets)
        self.k = np.bincount(of, baskets * each) / np.maximum(self.m, 1)
        classes, at = np.unique(coarse(np.array(sorted(frequencies))), return_inverse=True)
        many = np.array([frequencies[f] for f in sorted(frequencies)], float)
        self.n_items = many.sum()
        number = np.bincount(at, many)
        self.f = np.bincount(at, many * np.array(sorted(frequencies), float)) / np.maximum(number, 1) if len(classes) else classes
        self.classes = classes
        total = max((self.k * self.m).sum(), 1.0)
        x, y = self.k / math.sqrt(total), self.f / math.sqrt(total)
        for _ in range(rounds if len(classes) and len(self.k) else 0):
            odds = 1 + x[:, None] * y[None, :]
            fresh = self.k / ((number * y)[None, :] / odds).sum(axis=1)
            odds = 1 + fresh[:, None] * y[None, :]
            y_new = self.f / ((self.m * fresh)[:, None] / odds).sum(axis=0)
            moved = max(np.abs(fresh / x - 1).max(), np.abs(y_new / y - 1).max())
            x, y = fresh, y_new
            if moved < tol:
                break
        self.x, self.y = x, y

    def probability(self, frequency: np.ndarray) -> np.ndarray:
        """[pair, size class]: probability that an item of the frequency is in a basket of the class."""
        xy = self.x[None, :] * self.y[np.searchsorted(self.classes, coarse(frequency))][:, None]
        return xy / (1 + xy)

    def log10_tail(self, fa: np.ndarray, fb: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected common baskets, log10 P(at least n common baskets))."""
        q = np.clip(self.probability(fa) * self.probability(fb), 0, 1 - 1e-12)
        return (q * self.m).sum(axis=1), poisson_binomial_tail(q, self.m, n)


def _log_upper(w: np.ndarray) -> np.ndarray:
    """Natural log of the normal distribution's upper tail."""
    out = np.empty_like(w)
    near = w < 30
    out[near] = np.log(np.maximum([0.5 * math.erfc(v / math.sqrt(2)) for v in w[near]], 1e-300))
    far = w[~near]
    out[~near] = -far * far / 2 - np.log(far * math.sqrt(2 * math.pi)) + np.log1p(-1 / far**2 + 3 / far**4)
    return out


def poisson_binomial_tail(q: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 P(X >= n) for X a sum of m[j] coins of probability q[i, j], for each row i."""
    n = np.asarray(n, float)
    mean = (q * m).sum(axis=1)
    top = (np.where(q > 0, m, 0)).sum(axis=1)
    x = np.minimum(n, top) - 0.5
    s = np.log(np.maximum(x, 1e-9) / np.maximum(mean, 1e-300))
    low, high = np.full(len(n), -60.0), np.full(len(n), 700.0)
    for _ in range(100):
        e = q * np.exp(np.clip(s, -700, 700))[:, None]
        p = e / (1 - q + e)
        gap = (p * m).sum(axis=1) - x
        low, high = np.where(gap < 0, s, low), np.where(gap > 0, s, high)
        step = s - gap / np.maximum((p * (1 - p) * m).sum(axis=1), 1e-300)
        fresh = np.where((step > low) & (step < high), step, (low + high) / 2)
        done = np.abs(fresh - s).max(initial=0) < 1e-12
        s = fresh
        if done:
            break
    e = q * np.exp(s)[:, None]
    p = e / (1 - q + e)
    k = (m * np.log1p(q * np.expm1(s)[:, None])).sum(axis=1)
    k2 = (p * (1 - p) * m).sum(axis=1)
    w = np.sign(s) * np.sqrt(np.maximum(2 * (s * x - k), 0))
    u = 2 * np.sinh(s / 2) * np.sqrt(k2)
    small = np.abs(w) < 1e-4
    w_, u_ = np.where(small, 1.0, w), np.where(small | (u == 0), 1.0, u)
    upper, density = _log_upper(w_), -w_ * w_ / 2 - 0.5 * math.log(2 * math.pi)
    log_p = upper + np.log(np.maximum(1 + np.exp(np.clip(density - upper, -700, 700)) * (1 / u_ - 1 / w_), 1e-12))
    log_p = np.where(small, math.log(0.5), log_p)
    log_p = np.where(n <= 0, 0.0, np.where(n > top, -np.inf, np.minimum(log_p, 0.0)))
    return log_p / math.log(10)


# -- counting ---------------------------------------------------------------------------------------------------


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate(keys), return_inverse=True)
    return code, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the pairs of (left, right) lists of a task: all pairs of left, and with right those across."""
    index: dict = {}
    items: list = []
    freq: list[int] = []
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        code, n = _merge(keys, counts)
        a, b = code >> 32, code & 0xFFFFFFFF
        values, f = pa.array(items), np.array(freq, np.int64)
        index.clear(), items.clear(), freq.clear()
        return pa.RecordBatch.from_arrays([values.take(pa.array(a)), values.take(pa.array(b)), pa.array(n), pa.array(f[a]), pa.array(f[b])], names=["a", "b", "n", "fa", "fb"])

    def encode(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        flat = column.flatten()
        coded = flat.field("item").dictionary_encode()
        at, f = coded.indices.to_numpy(), flat.field("f").to_numpy(zero_copy_only=False)
        values = coded.dictionary.to_pylist()
        many = np.zeros(len(values), np.int64)
        many[at] = f
        code = np.empty(len(values), np.int64)
        for i, v in enumerate(values):
            k = index.get(v)
            if k is None:
                k = index[v] = len(items)
                items.append(v)
                freq.append(int(many[i]))
            code[i] = k
        out = code[at]
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return out, np.append(0, np.cumsum(lengths))

    def add(x: np.ndarray, y: np.ndarray) -> int:
        code, n = np.unique((x.ravel() << 32) | y.ravel(), return_counts=True)
        keys.append(code)
        counts.append(n)
        return len(code)

    # codes are given in order of arrival, so pairs are put in item order when they leave (see pair_counts)
    for batch in batches:
        left, lo = encode(batch.column("left"))
        size = np.diff(lo)
        if batch.schema.get_field_index("right") < 0:
            for k in np.unique(size[size > 1]):
                rows = np.flatnonzero(size == k)
                i, j = np.triu_indices(int(k), 1)
                for part in np.array_split(rows, max(1, len(rows) * len(i) // HELD_PAIRS)):
                    lists = np.sort(left[lo[part][:, None] + np.arange(k)], axis=1)
                    held += add(lists[:, i], lists[:, j])
        else:
            right, ro = encode(batch.column("right"))
            for r in range(batch.num_rows):
                x, y = np.meshgrid(left[lo[r] : lo[r + 1]], right[ro[r] : ro[r + 1]], indexing="ij")
                held += add(np.minimum(x, y), np.maximum(x, y)) if x.size else 0
                if held > 4 * HELD_PAIRS:
                    code, n = _merge(keys, counts)
                    keys, counts, held = [code], [n], len(code)
        if held > 2 * HELD_PAIRS:
            code, n = _merge(keys, counts)
            keys, counts, held = [code], [n], len(code)
            if held > HELD_PAIRS:
                yield flush()
                keys, counts, held = [], [], 0
    if keys:
        yield flush()


def pair_counts(baskets: DataFrame, key: Sequence[str], kept: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b) of the kept items. baskets(key.., item) is distinct; kept(item, f); sizes(key.., k)."""
    kind = dict(baskets.dtypes)["item"]
    entry = F.struct("item", "f").alias("entry")
    # a frequent item's baskets stay where they are while the items are few enough to be sent to them
    few = kept.limit(SHARED_ITEMS + 1).count() <= SHARED_ITEMS
    used = baskets.join(F.broadcast(kept) if few else kept, "item").select(*key, entry)
    large = sizes.where(F.col("k") > block).select(*key, F.ceil(F.col("k") / block).cast("int").alias("blocks"))
    schema = f"a {kind}, b {kind}, n long, fa long, fb long"
    has_large = bool(large.take(1))
    small = used.join(large, list(key), "left_anti") if has_large else used
    counted = small.groupBy(*key).agg(F.collect_list("entry").alias("left")).where(F.size("left") > 1).select("left").mapInArrow(_count_pairs, schema)
    if has_large:
        own = used.join(large, list(key)).withColumn("own", F.pmod(F.xxhash64("entry.item"), F.col("blocks")).cast("int"))
        other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        unit = other.select(*key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("first"), (F.col("own") == F.col("other")).alias("same"), "entry")
        lists = unit.groupBy(*key, "i", "j").agg(F.collect_list(F.when(F.col("first"), F.col("entry"))).alias("left"), F.collect_list(F.when(~F.col("first"), F.col("entry"))).alias("right"))
        within = lists.where("i = j and size(left) > 1").select("left").mapInArrow(_count_pairs, schema)
        across = lists.where("i <> j").select("left", "right").mapInArrow(_count_pairs, schema)
        counted = counted.union(within).union(across)
    swap = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    ordered = counted.select(pick("a", "b").alias("item_a"), pick("b", "a").alias("item_b"), "n", pick("fa", "fb").alias("fa"), pick("fb", "fa").alias("fb"))
    return ordered.groupBy("item_a", "item_b").agg(F.sum("n").alias("n_ab"), F.max("fa").alias("n_a"), F.max("fb").alias("n_b"))


def exceeds(n_ab: Column, n_a: Column, n_b: Column, n: int, lift: int) -> Column:
    """n_ab n >= lift n_a n_b, exactly."""
    big = lambda c: c.cast("decimal(18,0)")
    return big(n_ab) * F.lit(n).cast("decimal(18,0)") >= big(n_a) * big(n_b) * F.lit(lift).cast("decimal(2,0)")


def _baskets(df: DataFrame, basket: Sequence[Column], item: str) -> tuple[DataFrame, list[str], DataFrame, DataFrame]:
    """(baskets, their key, sizes, items)."""
    key = [f"b{i}" for i in range(len(basket))]
    src = df.select(*(c.alias(k) for c, k in zip(basket, key)), F.col(item).alias("item")).dropna()
    baskets = materialize(src.distinct(), "baskets")
    return baskets, key, baskets.groupBy(*key).agg(F.count(F.lit(1)).alias("k")), materialize(baskets.groupBy("item").agg(F.count(F.lit(1)).alias("f")), "items")


def cooccurring(df: DataFrame, basket: Sequence[Column], item: str, min_count: int = 6, min_lift: int | None = None, fdr: float = 0.01, block: int = BLOCK) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n_baskets, expected, lift, log10_p, q_value, surprising), item_a < item_b.

    Every pair that meets in at least min_count baskets and, where given, at least min_lift times as often as
    independent items would. `surprising`: its q value is at most fdr.
    """
    spark = df.sparkSession
    baskets, key, sizes, items = _baskets(df, basket, item)
    # one row per distinct size and frequency: at most about the square root of twice the rows
    by_size = {r["k"]: r["n"] for r in sizes.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_freq = {r["f"]: r["n"] for r in items.groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(by_size.values())
    null = Null(by_size, by_freq)
    names = ["item_a", "item_b", "n_ab", "n_a", "n_b"]
    pairs = materialize(pair_counts(baskets, key, items, sizes, block).select(*names), "pairs")
    model = spark.sparkContext.broadcast(null)
    # a tail depends on the two frequencies and the count alone, so it is computed once for all pairs that have the same
    less, more = F.least("n_a", "n_b").alias("less"), F.greatest("n_a", "n_b").alias("more")
    alike = pairs.groupBy(less, more, "n_ab").agg(F.count(F.lit(1)).alias("n")).repartition(2 * spark.sparkContext.defaultParallelism)

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            triples = np.stack([b.column(c).to_numpy() for c in ("less", "more", "n_ab")])
            expected, log_p = np.empty(b.num_rows), np.empty(b.num_rows)
            for i in range(0, b.num_rows, 2000):
                part = slice(i, i + 2000)
                expected[part], log_p[part] = model.value.log10_tail(*triples[:, part])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(expected), pa.array(np.maximum(log_p, -1e6))], names=[*b.schema.names, "expected", "log10_p"])

    scored = materialize(alike.mapInArrow(tails, "less long, more long, n_ab long, n long, expected double, log10_p double"), "tails")
    slot = F.least(F.floor(-F.col("log10_p") * BINS_A_DECADE), F.lit(DEEPEST * BINS_A_DECADE)).cast("int")
    seen = {r["slot"]: r["n"] for r in scored.groupBy(slot.alias("slot")).agg(F.sum("n").alias("n")).collect()}
    hypotheses = null.n_items * (null.n_items - 1) / 2
    q, rank, rows = 1.0, sum(seen.values()), []
    for s in sorted(seen):  # from the largest tail to the smallest
        q = min(q, 10 ** max(math.log10(max(hypotheses, 1)) - s / BINS_A_DECADE - math.log10(rank), -300))
        rows.append((int(s), float(q)))
        rank -= seen[s]
    table = F.broadcast(spark.createDataFrame(rows or [(-1, 1.0)], "slot int, q_value double"))
    lift = F.col("n_ab") * F.lit(float(n)) / (F.col("n_a").cast("double") * F.col("n_b"))
    asked = pairs.where(F.col("n_ab") >= min_count)
    if min_lift:
        asked = asked.where(exceeds(F.col("n_ab"), F.col("n_a"), F.col("n_b"), n, min_lift))
    out = asked.withColumns({"less": less, "more": more}).join(scored.drop("n"), ["less", "more", "n_ab"]).withColumn("slot", slot).join(table, "slot")
    return out.select("item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(n).cast("long").alias("n_baskets"), "expected", lift.alias("lift"), "log10_p", "q_value", (F.col("q_value") <= fdr).alias("surprising"))
