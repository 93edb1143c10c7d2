"""The façade: ingest, fit in bulk or by increments, recommend, find similar items, evaluate, save and load.

A model holds the state table (user, item, value, tstamp), contact counts, popularity and tags; kinds are 'linear',
'factors' and 'hybrid'. A hybrid without any tags answers by its linear model alone. Unknown users get the hottest
items, or, with tags that factors have learned, items by these. An increment solves the items that it touches, and
trains the factors on the pairs of touched users and touched items from where they are.

Defined results: a model that isn't fitted raises NotFittedError when asked; k of 0 or less gives no rows.
"""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import interactions as ops
from ..operators import metrics, ranking
from ..operators.tags import clear, cold_features, entity_features, put
from ..session import discard, materialize, materialize_all
from . import factors, linear, store

KINDS = ("linear", "factors", "hybrid")


@dataclass(frozen=True)
class Settings:
    kind: str = "linear"
    state: ops.StateConfig = field(default_factory=ops.StateConfig)
    linear: linear.LinearConfig = field(default_factory=linear.LinearConfig)
    factors: factors.FactorConfig = field(default_factory=factors.FactorConfig)
    similarity_weight: float = 2.0

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind: {self.kind}")


class NotFittedError(RuntimeError):
    """The model was asked before it was fitted."""


class Recommender:
    def __init__(self, spark: SparkSession, settings: Settings = Settings()):
        self.spark, self.settings = spark, settings
        self.state: DataFrame | None = None
        self.contacts: DataFrame | None = None
        self.pop: DataFrame | None = None
        self.clock: float | None = None
        self.last_arrival = -1
        self._outdated: tuple = ()
        self.sim: DataFrame | None = None
        self.params: DataFrame | None = None
        self.user_tags: DataFrame | None = None
        self.item_tags: DataFrame | None = None
        self.touched: DataFrame | None = None
        self.touched_users: DataFrame | None = None
        self.samples_per_second: float | None = None

    # -- ingest ------------------------------------------------------------------------------------------------

    def register_tags(self, users: DataFrame | None = None, items: DataFrame | None = None, append: bool = False) -> None:
        """(entity, tags) of users and items."""
        if users is not None:
            self.user_tags = users if self.user_tags is None else put(self.user_tags, users, append)
        if items is not None:
            self.item_tags = items if self.item_tags is None else put(self.item_tags, items, append)

    def clear_tags(self, users: DataFrame | bool = False, items: DataFrame | bool = False) -> None:
        """Forget the tags of the given entities (entity), or of all with True."""
        self.user_tags, self.item_tags = (self._cleared(t, which) for t, which in ((self.user_tags, users), (self.item_tags, items)))

    @staticmethod
    def _cleared(stored: DataFrame | None, which: DataFrame | bool) -> DataFrame | None:
        if stored is None or which is True:
            return None
        return stored if which is False else clear(stored, which)

    def add(self, df: DataFrame, seq: str | None = "seq", update: bool = False) -> None:
        """Fold interactions into the state; rows with unknown parts are left out. With update, the last rating wins.

        The clock and the numbers of arrival go on from those of earlier calls. Tables that this call replaces are
        deleted by the next one.
        """
        good = materialize(ops.split_valid(ops.standard(df, seq if seq in df.columns else None, self.last_arrival))[0], "arrivals")
        if update:
            fresh = ops.upsert(good)
            kept = self.state.join(fresh.select("user", "item"), ["user", "item"], "left_anti") if self.state is not None else None
            state = fresh if kept is None else kept.unionByName(fresh)
        else:
            state = ops.fold(good, self.settings.state, self.state, self.clock)
        contacts, pop = ops.contact_counts(good), ops.popularity(good)
        if self.contacts is not None:
            contacts = self.contacts.unionByName(contacts).groupBy("user", "item").agg(F.sum("contacts").alias("contacts"))
            pop = self.pop.unionByName(pop).groupBy("item").agg(F.sum("freq").alias("freq"), F.max("last_seq").alias("last_seq"))
        touched, users = good.select("item").distinct(), good.select("user").distinct()
        before = (self.state, self.contacts, self.pop, self.touched, self.touched_users)
        self.state, self.contacts, self.pop, self.touched, self.touched_users, tops = materialize_all({
            "state": state, "contacts": contacts, "popularity": pop,
            "touched-items": touched if self.touched is None else self.touched.union(touched).distinct(),
            "touched-users": users if self.touched_users is None else self.touched_users.union(users).distinct(),
            "tops": good.agg(F.max("tstamp").alias("t"), F.max("seq").alias("n")),
        })
        top = tops.first()
        now = None if top["t"] is None else float(top["t"]) + 1.0
        self.clock = max((x for x in (now, self.clock) if x is not None), default=None)
        self.last_arrival = max(self.last_arrival, -1 if top["n"] is None else int(top["n"]))
        discard(good, tops, *self._outdated)
        self._outdated = before

    @property
    def matrix(self) -> DataFrame:
        return ops.matrix(self.state, self.settings.state, self.clock)

    # -- fit ---------------------------------------------------------------------------------------------------

    def fit_recorded(self) -> None:
        """Solve what was touched since the last fit; all of it the first time."""
        self._fit(self.touched is not None and (self.sim is not None or self.params is not None))

    def fit_users(self, users: DataFrame) -> None:
        """Solve the items that the given users touched anew."""
        self._asked()
        items = self.state.join(users.select("user").distinct(), "user", "left_semi").select("item").distinct()
        self._fit(True, items, users.select("user").distinct())

    def bulk_fit(self, df: DataFrame | None = None, seq: str | None = "seq", user_tags: DataFrame | None = None, item_tags: DataFrame | None = None) -> None:
        began = time.time()
        self.register_tags(user_tags, item_tags)
        n = 0
        if df is not None:
            counted = Observation()
            self.add(df.observe(counted, F.count(F.lit(1)).alias("n")), seq)
            n = counted.get["n"]
        self._fit(False)
        self.samples_per_second = n / max(time.time() - began, 1e-9)

    def fit(self, df: DataFrame, seq: str | None = "seq", update: bool = False) -> None:
        """Add interactions and solve the items they touch."""
        self.add(df, seq, update)
        self.fit_recorded()

    partial_fit = fit

    def _fit(self, increment: bool, items: DataFrame | None = None, users: DataFrame | None = None) -> None:
        items = items if items is not None else self.touched
        users = users if users is not None else self.touched_users
        x = self.matrix
        before = (self.sim, self.params)
        if self.settings.kind in ("linear", "hybrid"):
            sim = linear.refit(self.sim, x, items, self.settings.linear) if increment and self.sim is not None else linear.fit(x, self.settings.linear)
            self.sim = materialize(sim, "similarity")
        if self.settings.kind in ("factors", "hybrid"):
            if increment and self.params is not None:
                of = [(s, chosen.select(F.col(s).alias("entity")).distinct()) for s, chosen in (("user", users), ("item", items))]
                touched = ops.matrix(self.state, self.settings.state, self.clock, users, items)
                own = [entity_features(e, self.user_tags if s == "user" else self.item_tags) for s, e in of]
                self.params = factors.fit(touched, *own, self.settings.factors, self.params)
            else:
                self.params = factors.fit(x, self._features("user"), self._features("item"), self.settings.factors, self.params)
        self._outdated += (*(b for b, now in zip(before, (self.sim, self.params)) if b is not now), self.touched, self.touched_users)
        self.touched = self.touched_users = None

    def _asked(self) -> None:
        if self.state is None or (self.sim is None and self.params is None):
            raise NotFittedError("the model isn't fitted")

    @property
    def _by_factors(self) -> bool:
        """Whether factors take part in answers: a hybrid without any tags is linear."""
        return self.settings.kind == "factors" or self.settings.kind == "hybrid" and not (self.user_tags is None and self.item_tags is None)

    def _features(self, side: str, explicit: DataFrame | None = None) -> DataFrame:
        stored = self.user_tags if side == "user" else self.item_tags
        if explicit is not None:
            stored = explicit if stored is None else put(stored, explicit)
        return entity_features(self.state.select(F.col(side).alias("entity")).distinct(), stored)

    # -- answers -----------------------------------------------------------------------------------------------

    def recommend(self, users: DataFrame, k: int = 10, candidates: DataFrame | None = None, exclude_seen: bool = True, user_tags: DataFrame | None = None, pad_zero: bool | None = None) -> DataFrame:
        """(user, item, rank, score) of known and unknown users alike, once for each distinct user.

        user_tags(entity, tags) stand in for the stored tags of the asked users. The scores of popular items are their counts.
        """
        self._asked()
        if k <= 0:
            return self.state.select("user", "item", F.lit(0).alias("rank"), F.lit(0.0).alias("score")).where("false")
        asked = users.select("user").distinct()
        hot = asked.join(self.state.select("user").distinct(), "user", "left_semi")
        cold = asked.join(self.state.select("user").distinct(), "user", "left_anti")
        pad = pad_zero if pad_zero is not None else dict(self.state.dtypes)["item"] == "string"
        kind, x = self.settings.kind, self.matrix
        by_linear = linear.recommend(x, self.sim, hot, k, candidates, exclude_seen, pad) if kind != "factors" else None
        if not self._by_factors:
            found = by_linear
        else:
            own = self._features("user", user_tags).join(hot.withColumnRenamed("user", "entity"), "entity", "left_semi")
            usable = self._candidates(candidates)
            by_factors = factors.recommend(self.params, own, self._features("item"), x if exclude_seen else None, k, usable)
            found = by_factors if kind == "factors" else ranking.ensemble(by_factors.drop("rank"), by_linear.drop("rank"), self.contacts, k, self.settings.similarity_weight)
        columns = ("user", "item", "rank", F.col("score").cast("double").alias("score"))
        return found.select(*columns).unionByName(self._cold(cold, k, candidates, user_tags).select(*columns))

    def recommend_batch(self, users: DataFrame, k: int = 10, **options) -> DataFrame:
        """(pos, user, items, scores): a list for each row of users(pos, user), repeated users too; empty lists where nothing is found."""
        found = self.recommend(users, k, **options)
        lists = found.groupBy("user").agg(F.array_sort(F.collect_list(F.struct("rank", "item", "score"))).alias("l"))
        items, scores = (F.coalesce(F.col(f"l.{c}"), F.array().cast(f"array<{kind}>")) for c, kind in (("item", dict(self.state.dtypes)["item"]), ("score", "double")))
        return users.select("pos", "user").join(lists, "user", "left").select("pos", "user", items.alias("items"), scores.alias("scores"))

    def _candidates(self, candidates: DataFrame | None) -> DataFrame | None:
        if candidates is None:
            return None
        usable = candidates.select("item").distinct().join(ops.all_items(self.state), "item", "left_semi")
        return None if usable.isEmpty() else usable

    def _cold(self, users: DataFrame, k: int, candidates: DataFrame | None, user_tags: DataFrame | None) -> DataFrame:
        usable = self._candidates(candidates)
        tagged = None
        if user_tags is not None and self.params is not None and self._by_factors:
            learned = self.params.where("side = 'user'").select("feature")
            own = cold_features(user_tags.join(users.withColumnRenamed("user", "entity"), "entity", "left_semi"), learned)
            tagged = factors.recommend(self.params, own, self._features("item"), None, k, usable if usable is not None else self.pop.select("item")).select("user", "item", "rank", "score")
            users = users.join(tagged.select("user").distinct(), "user", "left_anti")
        hot = ops.hot_items(self.pop, k) if usable is None else ops.hot_items(self.pop.join(usable, "item", "left_semi"), k)
        # k rows at most are broadcast
        plain = users.crossJoin(F.broadcast(hot)).select("user", "item", "rank", F.col("freq").cast("double").alias("score"))
        return plain if tagged is None else plain.unionByName(tagged)

    def similar_items(self, items: DataFrame, k: int = 10) -> DataFrame:
        """(query, item, score, rank); unknown queries have no rows."""
        self._asked()
        parts = []
        if self.settings.kind != "factors":
            parts.append(linear.similar_items(self.sim, items, k))
        if self._by_factors:
            parts.append(factors.similar_items(self.params, self._features("item"), items, k))
        if len(parts) == 1:
            return parts[0]
        lists = [ranking.min_max(p.select(F.col("query").alias("user"), "item", "score")) for p in parts]
        return ranking.top_k(ranking.comb_sum(lists), k).withColumnRenamed("user", "query")

    def users_by_items(self, items: DataFrame) -> DataFrame:
        return ops.users_by_items(self.state, items)

    def evaluate(self, test: DataFrame, k: int = 10, exclude_seen: bool = True) -> DataFrame:
        """One row of average metrics over the users of the test rows."""
        found = self.recommend(test.select("user"), k, exclude_seen=exclude_seen)
        return metrics.summary(metrics.per_query(found, test.select("user", "item"), k, users=test.select("user")))

    # -- persistence -------------------------------------------------------------------------------------------

    def save(self, path: str) -> int:
        tables = {n: getattr(self, n) for n in ("state", "contacts", "pop", "sim", "params", "user_tags", "item_tags") if getattr(self, n) is not None}
        return store.save(path, tables, {"settings": asdict(self.settings), "clock": self.clock, "last_arrival": self.last_arrival})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Recommender:
        tables, meta = store.load(spark, path)
        s = meta["settings"]
        out = cls(spark, Settings(s["kind"], ops.StateConfig(**s["state"]), linear.LinearConfig(**s["linear"]), factors.FactorConfig(**s["factors"]), s["similarity_weight"]))
        for name, df in tables.items():
            setattr(out, name, df)
        out.clock, out.last_arrival = meta["clock"], meta["last_arrival"]
        return out
