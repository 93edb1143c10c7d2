"""Queries of the general training-data problems (1, 3, 4, 6, 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import asof_attributes, asof_versions
from ..operators.feature_table import feature_cells, feature_table
from ..operators.heavy_keys import per_key
from ..operators.packed import infer_delimiters, score_delimiters, split_packed
from ..operators.sessions import sessions
from ..sources.tables import table

GAP_MS = 1_800_000
HEAVY_SHARE = 0.025
PROPERTIES = ("categoryid", "available")

#: The sources of packed fields: name, table, key, field.
PACKED = (("movies", "movies", "item", "genres"), ("item_properties_part1", "item_properties_part1", "seq", "value"))


def _packed(spark: SparkSession, folder: str, least: int) -> DataFrame:
    parts = [split_packed(table(spark, folder, t), f, k, least=least).select(F.lit(src).alias("src"), "rec_id", "pos", "val") for src, t, k, f in PACKED]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder, 2)


def p1_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of every field, single ones too."""
    return _packed(spark, folder, 1)


def p1_delimiters(spark: SparkSession, folder: str) -> DataFrame:
    """The scores of the candidate delimiters of each source."""
    parts = [score_delimiters(table(spark, folder, t), f).select(F.lit(src).alias("src"), "cand", "fields", F.round("consistency", 6).alias("consistency"), F.round("regularity", 6).alias("regularity"), F.round("score", 6).alias("score")) for src, t, _, f in PACKED]
    return parts[0].unionByName(parts[1])


def _keyed(spark: SparkSession, folder: str) -> DataFrame:
    both = F.array(F.struct(F.lit("item").alias("field"), F.col("item").alias("key")), F.struct(F.lit("user").alias("field"), F.col("user").alias("key")))
    return table(spark, folder, "interactions").select("seq", "tstamp", "rating", F.inline(both))


def p3_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Per item and per user: counts, rating totals and extremes, first and last rating in time, longest pause."""
    out = per_key(_keyed(spark, folder), ["field", "key"], "tstamp", "rating", tie="seq").where("key is not null")
    rounded = {c: F.round(c, 4) for c in ("total", "max_gap")}
    return out.withColumns(rounded)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    states = per_key(_keyed(spark, folder), ["field", "key"], "tstamp", "rating", tie="seq").select("field", "key", "n")
    rows = table(spark, folder, "interactions").count()
    return states.where(F.col("key").isNotNull() & (F.col("n") > F.lit(HEAVY_SHARE) * F.lit(rows))).select("field", "key")


def _asof_args() -> dict:
    return {"entity": "itemid", "event_time": "timestamp", "version_time": "timestamp", "tie": "seq", "prop": "property", "properties": PROPERTIES}


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return asof_versions(table(spark, folder, "visitor_events"), table(spark, folder, "item_properties_part1"), event_id="seq", **_asof_args())


def p4_asof(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of visitor_events with the category and availability of its item at the moment."""
    return asof_attributes(table(spark, folder, "visitor_events"), table(spark, folder, "item_properties_part1"), value="value", **_asof_args())


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return sessions(table(spark, folder, "visitor_events"), "visitorid", "timestamp", GAP_MS).select("visitorid", "start_ts", "end_ts")


def p6_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions with duration and events, in total and one row by event."""
    out = sessions(table(spark, folder, "visitor_events"), "visitorid", "timestamp", GAP_MS, by="event")
    return out.select("visitorid", "start_ts", "end_ts", "duration", "n_events", F.explode("counts").alias("event", "n"))


def p6_user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The sessions of the users of interactions, whose times hold fractions of seconds: bits of a millisecond."""
    return sessions(table(spark, folder, "interactions"), "user", "tstamp", 3600, resolution=0.001).withColumn("duration", F.round("duration", 3))


def p7_features(spark: SparkSession, folder: str) -> DataFrame:
    """The cells of the feature table, with latest time, recency and total."""
    cells = feature_cells(table(spark, folder, "visitor_events"), "visitorid", "event", "timestamp", "value")
    return cells.withColumn("total", F.round("total", 2))


def p7_wide(spark: SparkSession, folder: str) -> DataFrame:
    """The feature table itself: one row per visitor, one struct column per event type."""
    return feature_table(table(spark, folder, "visitor_events"), "visitorid", "event", "timestamp", "value")


def p7_wide_text(spark: SparkSession, folder: str) -> DataFrame:
    """The feature table with each cell as text: count, latest time, recency and total in hundredths; null without events."""
    wide = p7_wide(spark, folder)
    cents = lambda c: F.coalesce(F.round(F.col(c)["total"] * 100).cast("long").cast("string"), F.lit(""))
    text = lambda c: F.when(F.col(c)["n"] > 0, F.concat_ws(":", F.col(c)["n"], F.col(c)["last_ts"], F.col(c)["recency"], cents(c)))
    return wide.select("visitorid", *(text(c).alias(c) for c in wide.columns if c != "visitorid"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return feature_cells(table(spark, folder, "visitor_events"), "visitorid", "event", "timestamp", "value").select("visitorid", "event_type")


QUERIES = {f.__name__: f for f in (p1_found, p1_values, p1_delimiters, p3_found, p3_profile, p4_found, p4_asof, p6_found, p6_sessions, p6_user_sessions, p7_found, p7_features, p7_wide, p7_wide_text)}

_RUNS = f"""
with e as (select visitorid, timestamp as t, event from visitor_events where visitorid is not null and timestamp is not null),
m as (select *, case when t - lag(t) over (partition by visitorid order by t) <= {GAP_MS} then 0 else 1 end as fresh from e),
s as (select *, sum(fresh) over (partition by visitorid order by t, fresh desc rows unbounded preceding) as sid from m)
"""

_USER_RUNS = """
with e as (select "user", round(tstamp * 1000)::bigint as t from interactions where "user" is not null and tstamp is not null and not isnan(tstamp)),
m as (select *, case when t - lag(t) over (partition by "user" order by t) <= 3600000 then 0 else 1 end as fresh from e),
s as (select *, sum(fresh) over (partition by "user" order by t, fresh desc rows unbounded preceding) as sid from m)
select "user", min(t) / 1000.0::double as start_ts, max(t) / 1000.0::double as end_ts, round((max(t) - min(t)) / 1000.0::double, 3) as duration, count(*) as n_events from s group by "user", sid
"""

_CELLS = """
select visitorid, regexp_replace(lower(event), '[^a-z0-9]', '', 'g') as event_type, count(*) as n, max(timestamp) as last_ts,
  (select max(timestamp) from visitor_events) - max(timestamp) as recency, round(sum(value), 2) as total
from visitor_events where visitorid is not null and event is not null group by 1, 2
"""

_ASOF = """
with p as (
  select itemid, property, timestamp, max(seq) as prop_seq, arg_max(value, seq) as value from item_properties_part1
  where property = '{0}' and itemid is not null and timestamp is not null group by all
)
select e.*, p.prop_seq, p.value as found from {1} e asof left join p on e.itemid = p.itemid and e.timestamp >= p.timestamp
"""


def _found_asof(prop: str) -> str:
    return f"select seq as event_seq, '{prop}' as property, prop_seq from ({_ASOF.format(prop, 'visitor_events')}) where prop_seq is not null"


_KEYED = """
with k as (
  select 'item' as field, item as key, * from interactions where item is not null
  union all select 'user', "user", * from interactions where "user" is not null
), g as (select *, tstamp - lag(tstamp) over (partition by field, key order by tstamp nulls first, seq) as gap from k)
"""

ORACLE = {
    "p3_found": """
        select 'item' as field, item as key from interactions where item is not null group by item having count(*) > 0.025 * (select count(*) from interactions)
        union all
        select 'user', "user" from interactions where "user" is not null group by "user" having count(*) > 0.025 * (select count(*) from interactions)
    """,
    "p3_profile": _KEYED
    + """
        select field, key, count(*) as n, count(rating) as n_values, round(coalesce(sum(rating), 0), 4) as total, min(rating) as least, max(rating) as most,
          min(tstamp) as first_order, first(rating order by tstamp nulls first, seq) as first_value, max(tstamp) as last_order,
          last(rating order by tstamp nulls first, seq) as last_value, round(max(gap), 4) as max_gap
        from g group by field, key
    """,
    "p4_found": f"{_found_asof('categoryid')} union all {_found_asof('available')}",
    "p4_asof": f"""
        with c as (select * exclude (prop_seq, found), found as categoryid from ({_ASOF.format('categoryid', 'visitor_events')})),
        a as (select * exclude (prop_seq, found), found as available from ({_ASOF.format('available', 'c')}))
        select * from a
    """,
    "p6_found": _RUNS + "select visitorid, min(t) as start_ts, max(t) as end_ts from s group by visitorid, sid",
    "p6_sessions": _RUNS
    + """
        , w as (select *, min(t) over x as start_ts, max(t) over x as end_ts, count(*) over x as n_events from s window x as (partition by visitorid, sid))
        select visitorid, start_ts, end_ts, end_ts - start_ts as duration, n_events, coalesce(event, '') as event, count(*) as n from w group by all
    """,
    "p6_user_sessions": _USER_RUNS,
    "p7_found": f"select visitorid, event_type from ({_CELLS})",
    "p7_features": _CELLS,
    "p7_wide_text": f"""
        with w as (pivot (select visitorid, 'e_' || event_type as type, n || ':' || last_ts || ':' || recency || ':' || coalesce(round(total * 100)::bigint::varchar, '') as v from ({_CELLS}))
          on type using first(v) group by visitorid)
        select * from w
    """,
}
