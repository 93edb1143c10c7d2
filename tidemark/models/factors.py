"""Factorization model with side features: each entity is the sum of its features' embeddings and biases.

Training is stochastic pairwise ranking, the same at every size: the pairs fall into `shards` by a hash of the user,
in each epoch every shard trains a copy of the parameters on its pairs, and the copies are averaged by feature,
weighted by how often each shard used it. The number of shards is a setting, so the result doesn't depend on how the
data happens to be partitioned. A user of more than a quarter of a shard's even share is spread over all shards by
item; his negatives are then checked against the items of his that the shard holds.

A shard holds its pairs as three arrays, 20 bytes a pair. Parameters, at most MAX_PARAMETERS numbers, go to the
shards in each epoch; every entity has a feature of its own, so the lists of features are bounded too. The driver holds
the parameters once: what an epoch changed comes back FETCH features at a time, copies shared in an epoch are destroyed
after it, and names stay in Arrow.

Defined results: pairs with a null part, or of an entity without features, aren't trained on; no pairs leave the
parameters as they begin; features of `start` that don't occur are kept as they are.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import norm
from ..operators import ranking
from ..operators.ids import numbered
from ..session import delete_at_end, discard, materialize, shared_dir
from .solvers import Factors, Steps, train_pairs

MAX_PARAMETERS = 50_000_000
#: Features whose parameters come to the driver, or leave it, at once.
FETCH = 200_000


@dataclass(frozen=True)
class FactorConfig:
    """schedule: 'adagrad' by `rate`, or 'adadelta' by `rho` and `epsilon`. Loss 'warp-kos' isn't offered."""

    dim: int = 10
    loss: str = "warp"
    rate: float = 0.05
    epochs: int = 10
    max_sampled: int = 10
    user_l2: float = 1e-7
    item_l2: float = 1e-7
    use_bias: bool = True
    seed: int = 0
    schedule: str = "adagrad"
    rho: float = 0.95
    epsilon: float = 1e-6
    shards: int = 8
    #: Pairs of a shard that take one step together.
    block: int = 32

    def __post_init__(self):
        if self.loss not in ("warp", "bpr", "logistic"):
            raise ValueError(f"unknown loss: {self.loss}")
        if self.schedule not in ("adagrad", "adadelta"):
            raise ValueError(f"unknown schedule: {self.schedule}")


class Side:
    """The features of users or of items, as numbers: feature names, and the features of each entity."""

    def __init__(self, features: DataFrame, dim: int):
        vocabulary = numbered(features.select("feature").distinct(), ["feature"], "no")
        count = vocabulary.count()
        if count * (dim + 1) > MAX_PARAMETERS:
            raise ValueError(f"{count} features exceed the size that the driver holds")
        self.entities = materialize(numbered(features.select("entity").distinct(), ["entity"], "e"), "entities")
        self.names = vocabulary.orderBy("no").toArrow().column("feature").combine_chunks()
        rows = features.select("entity", "feature").distinct().join(vocabulary, "feature").join(self.entities, "entity").select("e", "no").toArrow()
        e, no = (rows.column(c).to_numpy() for c in ("e", "no"))
        order = np.lexsort((no, e))
        self.n = int(e.max(initial=-1)) + 1
        self.start, self.features = np.append(0, np.cumsum(np.bincount(e, minlength=self.n))), no[order]


def fit(x: DataFrame, user_features: DataFrame, item_features: DataFrame, config: FactorConfig = FactorConfig(), start: DataFrame | None = None) -> DataFrame:
    """params(side, feature, bias, vec). x: (user, item, weight); features: (entity, feature, weight).

    With `start`, known features go on from there and new ones begin afresh.
    """
    spark = x.sparkSession
    sides = [Side(f, config.dim) for f in (user_features, item_features)]
    p = Factors(len(sides[0].names), len(sides[1].names), config.dim, config.seed).arrays()
    kept = None
    if start is not None:
        held = start.select("side", "feature", "bias", "vec").toArrow().combine_chunks()
        known = np.zeros(held.num_rows, bool)
        for which, (side, s) in enumerate(zip(("user", "item"), sides)):
            no = pa.compute.index_in(held.column("feature"), s.names)
            at = np.flatnonzero(pa.compute.and_(pa.compute.equal(held.column("side"), side), no.is_valid()).to_numpy(zero_copy_only=False))
            no, of = no.take(pa.array(at)).to_numpy(), held.take(pa.array(at))
            if len(at):
                p[which][no] = of.column("vec").combine_chunks().flatten().to_numpy().reshape(len(at), -1)
                p[2 + which][no] = of.column("bias").to_numpy()
            known[at] = True
        kept = held.filter(pa.array(~known))
    users, items = (s.entities.select(F.col("entity").alias(c), F.col("e").alias(n)) for s, c, n in zip(sides, ("user", "item"), "ui"))
    data = x.where("user is not null and item is not null and weight is not null").select("user", "item", F.col("weight").cast("double").alias("w"))
    data = materialize(data.join(users, "user").join(items, "item").select("u", "i", "w"), "pairs")
    sizes = data.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # users of so many pairs number less than 4 times the shards
    large = F.broadcast(sizes.where(F.col("n") > total / (4 * config.shards)).select("u", F.lit(True).alias("large")))
    key = F.when(F.col("large"), F.xxhash64("u", "i")).otherwise(F.xxhash64("u"))
    shards = materialize(data.join(large, "u", "left").select(F.pmod(key, F.lit(config.shards)).cast("int").alias("shard"), "u", "i", "w"), "shards")
    steps = Steps(p, config.schedule, config.rate, config.rho, config.epsilon)
    if total:
        for epoch in range(config.epochs):
            shared = spark.sparkContext.broadcast((steps, [(s.start, s.features, s.n) for s in sides]))
            _epoch(shards, shared, config, epoch, steps)
            shared.destroy()
    p = steps.p
    if not config.use_bias:
        p[2][:], p[3][:] = 0, 0
    folder = f"{shared_dir(spark).rstrip('/')}/factors-{uuid.uuid4().hex}"
    schema = "side string, feature string, bias float, vec array<float>"
    parts = [(n, at) for n, side in enumerate(sides) for at in range(0, len(side.names), FETCH)]
    tables = (_table(("user", "item")[n], sides[n].names[at : at + FETCH], p[n][at : at + FETCH], p[2 + n][at : at + FETCH]) for n, at in parts)
    for t in itertools.chain([_table("user", pa.array([], pa.string()), p[0][:0], p[2][:0])], tables, [] if kept is None or not kept.num_rows else [kept.combine_chunks()]):
        spark.createDataFrame(t.select(["side", "feature", "bias", "vec"]), schema).coalesce(4).write.mode("append").parquet(folder)
    delete_at_end(spark, folder)
    return spark.read.schema(schema).parquet(folder)


def _table(side: str, names: pa.Array, vec: np.ndarray, bias: np.ndarray) -> pa.Table:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vec) + 1) * vec.shape[1], pa.int32()), pa.array(vec.reshape(-1), pa.float32()))
    return pa.table({"side": pa.array([side] * len(names), pa.string()), "feature": names.cast(pa.string()), "bias": pa.array(bias, pa.float32()), "vec": lists})


def _epoch(shards: DataFrame, shared, config: FactorConfig, epoch: int, steps: Steps) -> None:
    """Train a copy in every shard, and put the weighted means of what changed into steps."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        # trained in place: the next shard of this worker reads the shared parameters anew
        mine, sides = shared.value
        shared.__dict__.pop("_value", None)
        u, i, w = (rows.column(c).to_numpy() for c in ("u", "i", "w"))
        order = np.lexsort((w, i, u))
        train_pairs(mine, sides, u[order], i[order], w[order], config.loss, config.max_sampled, config.user_l2, config.item_l2, config.seed + 1000 * epoch + int(key[0].as_py()), config.block)
        out = []
        for which, used in enumerate(mine.used):
            changed = np.flatnonzero(used)
            vec = np.hstack([a[which].reshape(len(used), -1)[changed] for a in mine.all()]).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(changed) + 1) * vec.shape[1], pa.int32()), pa.array(vec.ravel()))
            out.append(pa.table({"which": pa.array(np.full(len(changed), which, np.int32)), "no": pa.array(changed), "n": pa.array(used[changed]), "vec": lists}))
        return pa.concat_tables(out)

    # by a number of its own: by the hash of a few numbers, twelve partitions hold eight shards in four
    changed = shards.repartition(4 * config.shards, "shard").groupBy("shard").applyInArrow(run, "which int, no long, n long, vec array<float>")
    size = max(len(steps.all()) * config.dim, 1)
    sums = [F.sum(F.get("vec", F.lit(i)).cast("double") * F.col("n")) / F.sum("n") for i in range(size)]
    mean = materialize(changed.groupBy("which", "no").agg(F.array(*sums).cast("array<float>").alias("vec")), "means")
    for w in range(4):
        width = config.dim if w < 2 else 1
        for low in range(0, len(steps.p[w]), FETCH):
            part = mean.where((F.col("which") == w) & F.col("no").between(low, low + FETCH - 1)).toArrow()
            if not part.num_rows:
                continue
            no = part.column("no").to_numpy()
            vec = part.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(no), size)
            for k, arrays in enumerate(steps.all()):
                of = vec[:, k * width : (k + 1) * width]
                arrays[w][no] = of if w < 2 else of[:, 0]
    discard(mean)


def representations(features: DataFrame, params: DataFrame, side: str) -> DataFrame:
    """(entity, bias, vec): sums of the features' parameters, unknown features skipped."""
    of = params.where(F.col("side") == side).select("feature", "bias", "vec")
    joined = features.join(of, "feature").select("entity", (F.col("bias") * F.col("weight")).alias("bias"), F.posexplode(F.transform("vec", lambda v: v)).alias("pos", "v"), "weight")
    each = joined.groupBy("entity", "pos").agg(F.sum(F.col("v") * F.col("weight")).alias("v"), F.sum("bias").alias("bias"))
    whole = each.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("vec"), F.max("bias").alias("bias"))
    return whole.select("entity", F.col("bias").cast("double").alias("bias"), "vec")


def top_by_product(queries: DataFrame, targets: DataFrame, k: int, block: int = 4096, exclude: DataFrame | None = None) -> DataFrame:
    """(user, item, score, rank): the k targets with the largest bias + bias + dot product for each query.

    Queries and targets are packed into blocks of about `block` vectors, and every pair of blocks is one matrix
    product that keeps k a query. What a query excludes is put into the target blocks it falls in, so each excluded
    pair goes to one task alone.
    """
    kind, side = dict(targets.dtypes)["entity"], dict(queries.dtypes)["entity"]
    n_q, n_t = (max(1, -(-df.count() // block)) for df in (queries, targets))
    of_query = lambda c: F.pmod(F.xxhash64(c), F.lit(n_q)).cast("int")
    of_target = lambda c: F.pmod(F.xxhash64(c), F.lit(n_t)).cast("int")
    pack = lambda df, at, n: df.select(at.alias(n), F.struct("entity", F.col("bias").cast("double").alias("bias"), F.col("vec").cast("array<double>").alias("vec")).alias("v")).groupBy(n).agg(F.collect_list("v").alias(f"{n}s"))
    # block by block: both sides are blocks of thousands of vectors, so this pairs few rows
    pairs = pack(queries, of_query("entity"), "q").crossJoin(pack(targets, of_target("entity"), "t"))
    if exclude is not None:
        gone = exclude.select(F.col("user").alias("entity"), F.col("item").alias("other")).join(queries.select("entity"), "entity", "left_semi")
        gone = gone.select(of_query("entity").alias("q"), of_target("other").alias("t"), F.struct("entity", "other").alias("g"))
        pairs = pairs.join(gone.groupBy("q", "t").agg(F.collect_list("g").alias("gone")), ["q", "t"], "left")
    else:
        pairs = pairs.withColumn("gone", F.lit(None).cast(f"array<struct<entity:{side},other:{kind}>>")).repartition("q", "t")

    def matrix(c: pa.Array) -> np.ndarray:
        return c.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                qs, ts, gone = (b.column(c).slice(r, 1) for c in ("qs", "ts", "gone"))
                qs, ts, gone = qs.flatten(), ts.flatten(), gone.flatten()
                s = matrix(qs) @ matrix(ts).T + ts.field("bias").to_numpy()[None, :] + qs.field("bias").to_numpy()[:, None]
                if len(gone):
                    row = pa.compute.index_in(gone.field("entity"), qs.field("entity"))
                    column = pa.compute.index_in(gone.field("other"), ts.field("entity"))
                    met = pa.compute.and_(row.is_valid(), column.is_valid())
                    s[row.filter(met).to_numpy(), column.filter(met).to_numpy()] = -np.inf
                cut = np.partition(s, -k, axis=1)[:, -k][:, None] if s.shape[1] > k else -np.inf
                q, t = np.nonzero((s >= cut) & (s > -np.inf))
                yield pa.RecordBatch.from_arrays([qs.field("entity").take(pa.array(q)), ts.field("entity").take(pa.array(t)), pa.array(s[q, t])], names=["user", "item", "score"])

    return ranking.top_k(pairs.select("qs", "ts", "gone").mapInArrow(run, f"user {side}, item {kind}, score double"), k)


def recommend(params: DataFrame, user_features: DataFrame, item_features: DataFrame, x: DataFrame | None, k: int, candidates: DataFrame | None = None) -> DataFrame:
    """(user, item, score, rank): among the candidates if given, without the items in x if given."""
    targets = representations(item_features, params, "item")
    if candidates is not None:
        targets = targets.join(candidates.select(F.col("item").alias("entity")).distinct(), "entity", "left_semi")
    return top_by_product(representations(user_features, params, "user"), targets, k, exclude=x)


def similar_items(params: DataFrame, item_features: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, item, score, rank): cosine of bias and embedding, the query itself aside."""
    vecs = representations(item_features, params, "item").select("entity", F.concat(F.array("bias"), "vec").alias("vec"))
    unit = vecs.withColumn("n", norm(F.col("vec"))).where("n > 0").select("entity", F.lit(0.0).alias("bias"), F.transform("vec", lambda v: v / F.col("n")).alias("vec"))
    asked = unit.join(queries.select(F.col("item").alias("entity")).distinct(), "entity", "left_semi")
    own = asked.select(F.col("entity").alias("user"), F.col("entity").alias("item"))
    return top_by_product(asked, unit, k, exclude=own).withColumnRenamed("user", "query")
