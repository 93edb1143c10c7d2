"""Attributes as known at event time: a backward as-of join that survives hot entities.

Events and attribute versions meet in shards. An entity has one shard, unless its rows exceed an even share of a
task; such a hot entity is cut by time at quantiles of its own rows, as many as its share asks for, and each of its
shards receives the last version before it as a carry-in. An instant that holds several quantiles has as many shards
of its own, over which its events are spread. A shard is then merged on its own: sorted by time, with versions before
events, the last version seen of each property is the one in force.

Broadcast: the cuts of hot entities. Entities above 1/(2P) of all rows number at most 2P, with P shuffle partitions;
an entity of share s has at most 4Ps + 1 cuts, so all have at most 6P together, whatever the data's size.

Times are compared as they are: whole numbers, fractions, dates or timestamps. Times of different types are brought
to one that holds both (whole and fractional numbers to double, dates to timestamps); a number and a timestamp can't be compared
and are an error.

Defined results: events with a null entity or time (NaN counts as null) get no version (and come out with nulls in
`asof_attributes`); versions with a null entity, time or property are ignored; a null value of a version in force is a
null value; among versions of one time the greatest tie wins; repeated events each come out. Empty events give an
empty result, empty versions nulls. Clashing column names are harmless: inputs are renamed inside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shuffle_partitions


def hot_cuts(keys: DataFrame, partitions: int) -> list[tuple]:
    """(entity, cuts) of entities that hold more than 1/(2 partitions) of the rows of keys(e, t); equal cuts stay."""
    counts = keys.groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = {r["e"]: r["n"] for r in counts.where(F.col("n") > max(total / (2 * partitions), 1000)).collect()}
    if not hot:
        return []
    pieces = {e: max(2, -(-4 * partitions * n // total)) for e, n in hot.items()}
    most = max(pieces.values())
    quantiles = F.percentile_approx("t", [i / most for i in range(1, most)], max(10_000, 4 * most))
    found = keys.where(F.col("e").isin(list(hot))).groupBy("e").agg(quantiles.alias("cuts")).collect()
    # of the finest cuts an entity keeps as many as its own share asks for
    return [(r["e"], [r["cuts"][i * most // pieces[r["e"]] - 1] for i in range(1, pieces[r["e"]])]) for r in found]


def _below(t: Column, cuts: Column) -> Column:
    """How many cuts lie before t; 0 without cuts."""
    return F.coalesce(F.size(F.filter(cuts, lambda c: c < t)), F.lit(0))


def _at(t: Column, cuts: Column) -> Column:
    return F.coalesce(F.size(F.filter(cuts, lambda c: c == t)), F.lit(0))


def _event_shard(t: Column, cuts: Column, spread: Column) -> Column:
    """The shard of the cuts at or before t; where several lie at t, one of theirs."""
    return _below(t, cuts) + F.when(_at(t, cuts) > 0, 1 + F.pmod(spread, F.greatest(_at(t, cuts), F.lit(1))).cast("int")).otherwise(0)


def _hash(events: DataFrame) -> Column:
    """A hash of the row, which is the same when a lost task runs again; equal rows share a shard."""
    fields = events.schema["payload"].dataType.fields
    return F.xxhash64(*(F.col("payload")[f.name] for f in fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))))


def _version_shard(t: Column, cuts: Column) -> Column:
    """The first shard that holds t; the others of one instant get the version as a carry-in."""
    return _below(t, cuts) + F.when(_at(t, cuts) > 0, 1).otherwise(0)


def merge_asof(events: DataFrame, versions: DataFrame, properties: Sequence[str], partitions: int | None = None) -> DataFrame:
    """The core merge. events(e, t, payload), versions(e, t, tie, prop, val) -> payload, at: array of (tie, val) by property.

    Neither side may hold null e or t; both t have one type.
    """
    spark = events.sparkSession
    versions = versions.where(F.col("prop").isin(list(properties)))
    kind = dict(events.dtypes)["e"]
    found = hot_cuts(events.select("e", "t").union(versions.select("e", "t")), partitions or shuffle_partitions(spark))
    if found:
        cuts = F.broadcast(spark.createDataFrame(found, f"e {kind}, cuts array<{dict(events.dtypes)['t']}>"))
        events = events.join(cuts, "e", "left").withColumn("shard", _event_shard(F.col("t"), F.col("cuts"), _hash(events))).drop("cuts")
        placed = versions.join(cuts, "e", "left").withColumn("shard", _version_shard(F.col("t"), F.col("cuts")))
        # of the versions of one instant only the greatest tie can be in force: copies of one vanish before the shuffle
        cold = placed.where(F.col("cuts").isNull()).drop("cuts")
        cut = placed.where(F.col("cuts").isNotNull()).groupBy("e", "t", "prop", "shard").agg(F.max_by(F.struct("tie", "val"), "tie").alias("v"), F.max(F.size("cuts")).alias("top"))
        cut = cut.select("e", "t", F.col("v.tie").alias("tie"), "prop", F.col("v.val").alias("val"), "shard", "top")
        # the last version of each shard goes on into the following shards until one that has its own
        last = cut.groupBy("e", "prop", "shard").agg(F.max_by(F.struct("t", "tie", "val"), F.struct("t", "tie")).alias("v"), F.max("top").alias("top"))
        following = F.coalesce(F.lead("shard").over(Window.partitionBy("e", "prop").orderBy("shard")), F.col("top"))
        last = last.withColumn("to", following).where(F.col("to") > F.col("shard"))
        carried = last.select("e", "v.t", "v.tie", "prop", "v.val", F.explode(F.sequence(F.col("shard") + 1, F.col("to"))).alias("shard"))
        versions = cold.unionByName(cut.drop("top")).unionByName(carried)
    else:
        events, versions = events.withColumn("shard", F.lit(0)), versions.withColumn("shard", F.lit(0))
    val = dict(versions.dtypes)["val"]
    tie = dict(versions.dtypes)["tie"]
    payload = events.schema["payload"].dataType.simpleString()
    left = events.select("e", "shard", "t", F.lit(1).alias("side"), F.lit(None).cast(tie).alias("tie"), F.lit(None).cast("int").alias("p"), F.lit(None).cast(val).alias("val"), "payload")
    index = F.array_position(F.array(*map(F.lit, properties)), F.col("prop")).cast("int")
    right = versions.select("e", "shard", "t", F.lit(0).alias("side"), "tie", index.alias("p"), "val", F.lit(None).cast(payload).alias("payload"))
    w = Window.partitionBy("e", "shard").orderBy("t", "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    at = [F.last(F.when(F.col("p") == i + 1, F.struct("tie", "val")), ignorenulls=True).over(w) for i in range(len(properties))]
    return left.unionByName(right).select("side", "payload", *(a.alias(f"at{i}") for i, a in enumerate(at))).where("side = 1").drop("side")


def common_time(left: T.DataType, right: T.DataType) -> str:
    """The type in which the two kinds of times are compared; times of both kinds keep their exact order in it."""
    whole, number, moment = T.IntegralType, T.NumericType, (T.DateType, T.TimestampType, T.TimestampNTZType)
    if left == right and not isinstance(left, (T.ByteType, T.ShortType, T.IntegerType)):
        return left.simpleString()
    if isinstance(left, whole) and isinstance(right, whole):
        return "bigint"
    if isinstance(left, number) and isinstance(right, number):
        return "double"
    if isinstance(left, moment) and isinstance(right, moment):
        return "timestamp"
    raise ValueError(f"times of type {left.simpleString()} and {right.simpleString()} can't be compared")


def _time(df: DataFrame, name: str, kind: str) -> Column:
    """The time in the common type, NaN as null."""
    t = F.col(name).cast(kind)
    return F.when(~F.isnan(t), t) if kind in ("double", "float") else t


def _kind(events: DataFrame, event_time: str, versions: DataFrame, version_time: str) -> str:
    return common_time(events.schema[event_time].dataType, versions.schema[version_time].dataType)


def asof_versions(
    events: DataFrame, versions: DataFrame, entity: str, event_time: str, event_id: str, version_time: str, tie: str, prop: str, properties: Sequence[str], version_entity: str | None = None
) -> DataFrame:
    """(event_seq, property, prop_seq): the tie of the version in force for each event and property; no row where there is none."""
    kind = _kind(events, event_time, versions, version_time)
    left = events.select(F.col(entity).alias("e"), _time(events, event_time, kind).alias("t"), F.struct(F.col(event_id).alias("id")).alias("payload")).where("e is not null and t is not null")
    right = versions.select(F.col(version_entity or entity).alias("e"), _time(versions, version_time, kind).alias("t"), F.col(tie).alias("tie"), F.col(prop).alias("prop"), F.lit(None).cast("boolean").alias("val"))
    merged = merge_asof(left, right.where("e is not null and t is not null"), properties)
    each = F.array(*(F.struct(F.lit(p).alias("property"), F.col(f"at{i}.tie").alias("prop_seq")) for i, p in enumerate(properties)))
    return merged.select(F.col("payload.id").alias("event_seq"), F.inline(each)).where("prop_seq is not null")


def asof_attributes(
    events: DataFrame, versions: DataFrame, entity: str, event_time: str, version_time: str, tie: str, prop: str, value: str, properties: Sequence[str], version_entity: str | None = None
) -> DataFrame:
    """Every row of events with a column for each property: its value in force at the event's time, else null."""
    row = F.struct(*(F.col(f"`{c}`") for c in events.columns))
    time = _kind(events, event_time, versions, version_time)
    left = events.select(F.col(entity).alias("e"), _time(events, event_time, time).alias("t"), row.alias("payload"))
    right = versions.select(F.col(version_entity or entity).alias("e"), _time(versions, version_time, time).alias("t"), F.col(tie).alias("tie"), F.col(prop).alias("prop"), F.col(value).alias("val"))
    merged = merge_asof(left.where("e is not null and t is not null"), right.where("e is not null and t is not null"), properties)
    known = merged.select("payload.*", *(F.col(f"at{i}.val").alias(p if p not in events.columns else f"{p}_asof") for i, p in enumerate(properties)))
    kind = dict(versions.dtypes)[value]
    rest = left.where("e is null or t is null").select("payload.*", *(F.lit(None).cast(kind).alias(c) for c in known.columns[len(events.columns) :]))
    return known.union(rest)
