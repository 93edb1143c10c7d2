"""Interactions and their state: the decayed, clipped value of every (user, item) pair.

An interactions frame has user, item, tstamp (seconds), rating and seq, the unique order of arrival. Adding an
interaction to a pair clips decay(v) + rating. A chain of such steps is again of the form clip(a u + b, low, high),
with u the value decayed to the chain's first moment, so chains can be folded piece by piece and joined: a pair with
any share of all rows is folded in chunks of CHUNK arrivals at most.

The clock is the largest tstamp + 1 that has arrived, over all users. It is found by chunk and then carried over the
chunks' maxima, of which there is one per CHUNK arrivals. An increment goes on from the clock of those before it.

One shuffle, by chunk of arrivals, serves the clock and the first pieces of the chains; a second one brings the pieces
of a pair together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, decay_rate, decayed
from .ids import numbered

CHUNK = 50_000
COLUMNS = ("user", "item", "tstamp", "rating")
FUTURE_SECONDS = 180
#: Lists of popular items up to this length are broadcast.
SHARED_RANKS = 1_000_000


@dataclass(frozen=True)
class StateConfig:
    """Bounds of values and the half life of their decay, or None for no decay."""

    min_value: float = -5.0
    max_value: float = 10.0
    decay_in_days: float | None = None

    def __post_init__(self):
        if self.max_value <= self.min_value:
            raise ValueError("max_value must exceed min_value")

    @property
    def rate(self) -> float | None:
        return decay_rate(self.decay_in_days)


def standard(df: DataFrame, seq: str | None = None, after: int = -1) -> DataFrame:
    """The four columns, and seq: the given column, or numbers above `after` in the order of tstamp where there is none."""
    missing = [c for c in COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    out = df.select(*COLUMNS, *([F.col(seq).cast("long").alias("seq")] if seq else []))
    return out if seq else arrival_order(out, after)


def arrival_order(df: DataFrame, after: int = -1) -> DataFrame:
    """seq by tstamp, user, item, rating: dense numbers that begin after the given one."""
    return numbered(df, ["tstamp", "user", "item", "rating"], "seq").withColumn("seq", F.col("seq") + F.lit(after + 1))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows whose user, item, tstamp and rating are all known, and the rest."""
    ok = F.col("user").isNotNull() & F.col("item").isNotNull() & F.col("tstamp").isNotNull() & F.col("rating").isNotNull()
    ok = ok & ~F.isnan(F.col("rating").cast("double"))
    return df.where(ok), df.where(~ok)


def future_rows(df: DataFrame, now: float) -> DataFrame:
    """Rows more than three minutes ahead of now; they are kept, this is for a warning."""
    return df.where(F.col("tstamp") > F.lit(now + FUTURE_SECONDS))


def _chunk() -> Column:
    return F.floor(F.col("seq") / CHUNK)


def with_clock(df: DataFrame, clock: float | None = None) -> DataFrame:
    """Adds chunk, and clk: the clock after each row arrived. clock: that of earlier increments, which it never falls below."""
    tops = df.groupBy(_chunk().alias("chunk")).agg(F.max("tstamp").alias("top"))
    before = tops.select("chunk", F.max("top").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    own = F.max("tstamp").over(Window.partitionBy("chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    reached = F.greatest(F.col("own") + 1.0, F.col("before") + 1.0, F.lit(clock).cast("double"))
    return df.withColumn("chunk", _chunk()).withColumn("own", own).join(before, "chunk").withColumn("clk", reached).drop("before", "own")


def upsert(df: DataFrame) -> DataFrame:
    """The last rating of each pair, unclipped: (user, item, value, tstamp)."""
    # not of a struct, which would be aggregated by sorting
    return df.groupBy("user", "item").agg(F.max_by("rating", "seq").alias("value"), F.max_by("tstamp", "seq").alias("tstamp"))


def fold(df: DataFrame, config: StateConfig = StateConfig(), state: DataFrame | None = None, clock: float | None = None) -> DataFrame:
    """(user, item, value, tstamp) after adding all interactions in order of arrival.

    state and clock: those that earlier increments left; the clock is that of all users, so it can't be read off the state.
    """
    rate, lo, hi = config.rate, config.min_value, config.max_value
    rows = with_clock(df, clock) if rate is not None else df.withColumn("clk", F.col("tstamp")).withColumn("chunk", _chunk())

    def factor(since: Column, now: Column) -> Column:
        return decayed(F.lit(1.0), since, now, rate)

    # one chunk of a pair: value after = clip(a u + b, low, high), u the value before at the moment `first`
    steps = F.array_sort(F.collect_list(F.struct("seq", "clk", "tstamp", F.col("rating").cast("double").alias("x"))))
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.lit(None).cast("double").alias("t"))

    def step(s: Column, r: Column) -> Column:
        f = F.when(s["t"].isNull(), F.lit(1.0)).otherwise(factor(s["t"], r["clk"]))
        low, high = clip(f * s["low"] + r["x"], lo, hi), clip(f * s["high"] + r["x"], lo, hi)
        return F.struct((f * s["a"]).alias("a"), (f * s["b"] + r["x"]).alias("b"), low.alias("low"), high.alias("high"), r["tstamp"].cast("double").alias("t"))

    chunks = rows.groupBy("user", "item", "chunk").agg(steps.alias("steps"))
    chunks = chunks.select("user", "item", F.struct("chunk", F.col("steps")[0]["clk"].alias("first"), F.aggregate("steps", start, step).alias("s")).alias("c"))
    if state is not None:
        # the earlier state is a first chunk: a constant
        old = F.struct(F.lit(0.0).alias("a"), F.col("value").alias("b"), F.col("value").alias("low"), F.col("value").alias("high"), F.col("tstamp").cast("double").alias("t"))
        chunks = chunks.unionByName(state.select("user", "item", F.struct(F.lit(-1).cast("long").alias("chunk"), F.col("tstamp").cast("double").alias("first"), old.alias("s")).alias("c")))
    begin = F.struct(F.lit(0.0).alias("v"), F.lit(None).cast("double").alias("t"))

    def follow(s: Column, c: Column) -> Column:
        u = F.when(s["t"].isNull(), F.lit(0.0)).otherwise(s["v"] * factor(s["t"], c["first"]))
        v = F.least(F.greatest(c["s"]["a"] * u + c["s"]["b"], c["s"]["low"]), c["s"]["high"])
        return F.struct(v.alias("v"), c["s"]["t"].alias("t"))

    folded = chunks.groupBy("user", "item").agg(F.aggregate(F.array_sort(F.collect_list("c")), begin, follow).alias("s"))
    return folded.select("user", "item", F.col("s.v").alias("value"), F.col("s.t").alias("tstamp"))


def stats(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_users, n_items, max_user, max_item (at least 0), clock."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("user").alias("n_users"), F.countDistinct("item").alias("n_items"),
        F.greatest(F.coalesce(F.max("user"), F.lit(0)), F.lit(0)).alias("max_user"), F.greatest(F.coalesce(F.max("item"), F.lit(0)), F.lit(0)).alias("max_item"),
        (F.max("tstamp") + 1.0).alias("clock"),
    )


def last_arrival(df: DataFrame) -> int:
    """The largest seq, -1 without rows."""
    top = df.agg(F.max("seq")).first()[0]
    return -1 if top is None else int(top)


def clock(df: DataFrame) -> float | None:
    """The final clock: the largest tstamp + 1."""
    top = df.agg(F.max("tstamp")).first()[0]
    return None if top is None else float(top) + 1.0


def matrix(state: DataFrame, config: StateConfig = StateConfig(), now: float | None = None, users: DataFrame | None = None, items: DataFrame | None = None, weighted: bool = True) -> DataFrame:
    """(user, item, weight): values decayed to `now`, of the selected users and items; None selects all, empty none."""
    for side, chosen in (("user", users), ("item", items)):
        if chosen is not None:
            state = state.join(chosen.select(side).distinct(), side, "left_semi")
    weight = decayed(F.col("value"), F.col("tstamp"), F.lit(now), config.rate if now is not None else None) if weighted else F.lit(1)
    return state.select("user", "item", weight.alias("weight"))


def rating_of(state: DataFrame, pairs: DataFrame, config: StateConfig, now: float, default: float = 0.0) -> DataFrame:
    """The decayed value of each given pair, or the default."""
    value = decayed(F.col("value"), F.col("tstamp"), F.lit(now), config.rate)
    return pairs.select("user", "item").join(state, ["user", "item"], "left").select("user", "item", F.coalesce(value, F.lit(default)).alias("rating"))


def has_interaction(state: DataFrame, pairs: DataFrame) -> DataFrame:
    known = state.select("user", "item", F.lit(True).alias("known"))
    return pairs.select("user", "item").join(known, ["user", "item"], "left").select("user", "item", F.coalesce("known", F.lit(False)).alias("interacted"))


def recent_items(state: DataFrame, n: int | None = None) -> DataFrame:
    """Each user's items, or the n most recent: (user, item, tstamp, rank)."""
    w = Window.partitionBy("user").orderBy(F.desc("tstamp"), "item")
    ranked = state.select("user", "item", "tstamp", F.row_number().over(w).alias("rank"))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def all_items(state: DataFrame) -> DataFrame:
    return state.select("item").distinct()


def all_users(state: DataFrame) -> DataFrame:
    return state.select("user").distinct()


def users_by_items(state: DataFrame, items: DataFrame) -> DataFrame:
    """The distinct users who touched any of the items."""
    return state.join(items.select("item").distinct(), "item", "left_semi").select("user").distinct()


def non_interacted(state: DataFrame, users: DataFrame) -> DataFrame:
    """(user, item): for the given users, all items that they didn't touch. The answer itself is users x items."""
    every = users.select("user").distinct().crossJoin(all_items(state))
    return every.join(state.select("user", "item"), ["user", "item"], "left_anti")


def non_negative(state: DataFrame, users: DataFrame, config: StateConfig, now: float) -> DataFrame:
    """(user, item): for the given users, all items whose decayed value isn't negative; an untouched item counts as 0."""
    bad = state.where(decayed(F.col("value"), F.col("tstamp"), F.lit(now), config.rate) < 0).select("user", "item")
    return users.select("user").distinct().crossJoin(all_items(state)).join(bad, ["user", "item"], "left_anti")


def contact_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("user", "item").agg(F.count(F.lit(1)).alias("contacts"))


def popularity(df: DataFrame) -> DataFrame:
    """(item, freq, last_seq): arrivals with a positive rating by item, and the last of them."""
    return df.where(F.col("rating") > 0).groupBy("item").agg(F.count(F.lit(1)).alias("freq"), F.max("seq").alias("last_seq"))


def hot_items(pop: DataFrame, n: int) -> DataFrame:
    """The n most frequent items, of equals the least recently touched first: (item, freq, rank)."""
    top = pop.orderBy(F.desc("freq"), F.asc("last_seq")).limit(n)
    return top.select("item", "freq", F.row_number().over(Window.orderBy(F.desc("freq"), F.asc("last_seq"))).alias("rank"))


def hot_items_for(state: DataFrame, pop: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """(user, item, rank): each user's k hottest items not touched yet.

    A user with m touched items finds k among the k + m hottest, so the users' items are looked up in the list of the
    hottest k + max(m) only; its length is bounded by the longest history.
    """
    asked = users.select("user").distinct()
    seen = state.select("user", "item").join(asked, "user", "left_semi")
    most = seen.groupBy("user").agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0] or 0
    hot = hot_items(pop, k + most)
    # ranks that a user has touched push the later ones up; only as many ranks as the user needs are spread
    need = asked.join(seen.join(hot, "item").groupBy("user").agg(F.collect_list("rank").alias("touched")), "user", "left")
    wanted = F.slice(F.array_except(F.sequence(F.lit(1), F.lit(k) + F.coalesce(F.size("touched"), F.lit(0))), F.coalesce("touched", F.array().cast("array<int>"))), 1, k)
    placed = need.select("user", F.posexplode(wanted).alias("pos", "rank"))
    # every user asks for the first ranks: the list goes to the users while it is short
    listed = F.broadcast(hot) if k + most <= SHARED_RANKS else hot
    return placed.join(listed, "rank").select("user", "item", (F.col("pos") + 1).alias("rank"))
