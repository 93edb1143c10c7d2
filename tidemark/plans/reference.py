"""Queries of the recommendation engine over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..models import factors, linear
from ..models.recommender import Recommender, Settings
from ..operators import interactions as ops
from ..operators import metrics, ranking, splits, tags
from ..operators.gram import gram, nearest_items, neighbours
from ..operators.ids import decode, dictionary, encode, numbered
from ..session import materialize, shared_dir
from ..sources.datasets import shop_events
from ..sources.tables import table
from ..streaming.ingest import StateTable, start, stream_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

HALF_LIFE = 30.0
DECAY = ops.StateConfig(decay_in_days=HALF_LIFE)
RATE = DECAY.rate
K = 10


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


# -- inputs -----------------------------------------------------------------------------------------------------

EVENT_SCORES = {"view": 1.0, "click": 3.0, "purchase": 5.0, "error": -1.0}

_IX = """
with ix as (
  select "user", item, tstamp, rating, seq from interactions
  where "user" is not null and item is not null and tstamp is not null and rating is not null and not isnan(rating)
)"""
_EV = """
with ev as (
  select user_id as "user", cast(json_extract_string(props, '$.k') as bigint) as item, epoch(ts) as tstamp,
    case event_type when 'view' then 1.0::double when 'click' then 3.0 when 'purchase' then 5.0 else -1.0 end as rating, event_id as seq
  from events where event_type in ('view', 'click', 'purchase', 'error')
)"""
_OD = """
with od as (
  select o_custkey as "user", l_partkey as item, epoch(o_orderdate) as tstamp, l_quantity / 10.0::double as rating,
    row_number() over (order by o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 as seq
  from orders join lineitem on o_orderkey = l_orderkey
)"""
#: The last rating of each pair, used where any exact state will do.
_STATE = _EV + """, st as (select "user", item, arg_max(rating, seq) as value, arg_max(tstamp, seq) as tstamp from ev group by 1, 2)"""
_POP = """, pop as (select item, count(*) as freq, max(seq) as last_seq from ev where rating > 0 group by 1),
hot as (select item, freq, row_number() over (order by freq desc, last_seq) as rank from pop)"""
_NOW = "(select max(tstamp) + 1.0 from ev)"


def _ix(spark: SparkSession, d: str) -> DataFrame:
    return ops.split_valid(ops.standard(table(spark, d, "interactions"), "seq"))[0]


def _ev(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where(F.col("event_type").isin(list(EVENT_SCORES)))
    item = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("user_id").alias("user"), item.alias("item"), S.epoch_seconds(F.col("ts")).alias("tstamp"), S.event_rating(F.col("event_type"), EVENT_SCORES).alias("rating"), F.col("event_id").alias("seq"))


def _od(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    j = numbered(o.join(li, F.col("o_orderkey") == F.col("l_orderkey")), ["o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "seq")
    return j.select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), S.epoch_seconds(F.col("o_orderdate")).alias("tstamp"), (F.col("l_quantity") / 10.0).alias("rating"), "seq")


def _st(spark: SparkSession, d: str) -> DataFrame:
    return ops.upsert(_ev(spark, d))


def _round(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# -- state ------------------------------------------------------------------------------------------------------


@query(_EV + ' select "user", item, round(tstamp, 3) as tstamp, rating, seq from ev')
def interactions_from_events(spark, d):
    return _round(_ev(spark, d), "tstamp", digits=3)


@query(_OD + ' select "user", item, tstamp, rating, seq from od')
def interactions_from_orders(spark, d):
    return _od(spark, d)


@query(_IX + ' select "user", item, arg_max(rating, seq) as value, arg_max(tstamp, seq) as tstamp from ix group by 1, 2')
def state_upsert(spark, d):
    return ops.upsert(_ix(spark, d))


def _fold_sql(cte: str, name: str, rate: float | None) -> str:
    factor = f"pow({rate}::double, (x.clk - a.t) / 86400.0::double)" if rate is not None else "1.0::double"
    return cte + f"""
    , c as (select *, max(tstamp) over (order by seq rows unbounded preceding) + 1.0 as clk from {name}),
    l as (select "user", item, list(struct_pack(v := rating::double, t := tstamp::double, clk := clk::double) order by seq) as h from c group by 1, 2),
    f as (select "user", item, list_reduce(h, lambda a, x: struct_pack(
        v := least(greatest((case when a.clk is null then 0.0::double else a.v * {factor} end) + x.v, -5.0::double), 10.0::double), t := x.t, clk := x.clk),
        struct_pack(v := 0.0::double, t := 0.0::double, clk := null::double)) as s from l)
    select "user", item, round(s.v, 4) as value, s.t as tstamp from f
    """


@query(_fold_sql(_IX, "ix", RATE))
def state_fold_decay(spark, d):
    return _round(ops.fold(_ix(spark, d), DECAY), "value")


@query(_fold_sql(_OD, "od", None))
def state_clip_no_decay(spark, d):
    return _round(ops.fold(_od(spark, d)), "value")


def _in_parts(rows: DataFrame, parts: int) -> list[DataFrame]:
    """The arrivals in consecutive parts of about equal size."""
    cuts = rows.approxQuantile("seq", [i / parts for i in range(1, parts)], 0.001) or [0.0] * (parts - 1)
    bounds = [None, *map(int, cuts), None]
    cut = lambda lo, hi: (F.lit(True) if lo is None else F.col("seq") > lo) & (F.lit(True) if hi is None else F.col("seq") <= hi)
    return [rows.where(cut(lo, hi)) for lo, hi in zip(bounds, bounds[1:])]


@query(_fold_sql(_IX, "ix", RATE))
def state_fold_increments(spark, d):
    """The same state by two increments: the first half of the arrivals, then the rest upon its state and clock."""
    first, rest = _in_parts(_ix(spark, d), 2)
    return _round(ops.fold(rest, DECAY, ops.fold(first, DECAY), ops.clock(first)), "value")


@query(_fold_sql(_IX, "ix", RATE))
def state_increments_decay(spark, d):
    """The same state by three calls of the façade; late rows lie in later ones."""
    model = Recommender(spark, Settings(state=DECAY))
    for part in _in_parts(_ix(spark, d), 3):
        model.add(part)
    return _round(model.state, "value")


@query(_IX + ' select count(*) as n_rows, count(distinct "user") as n_users, count(distinct item) as n_items, greatest(max("user"), 0) as max_user, greatest(max(item), 0) as max_item, max(tstamp) + 1.0 as clock from ix')
def interaction_stats(spark, d):
    return ops.stats(_ix(spark, d))


@query('select count(*) filter (where good) as good, count(*) filter (where not good) as bad from (select "user" is not null and item is not null and tstamp is not null and rating is not null and not isnan(coalesce(rating, 0)) as good from interactions)')
def validated_rows(spark, d):
    good, bad = ops.split_valid(ops.standard(table(spark, d, "interactions"), "seq"))
    return good.select(F.lit(1).alias("g")).unionByName(bad.select(F.lit(0).alias("g"))).agg(F.coalesce(F.sum("g"), F.lit(0)).alias("good"), F.coalesce(F.sum(1 - F.col("g")), F.lit(0)).alias("bad"))


@query(_IX + " select count(*) as n_future from ix where tstamp > (select max(tstamp) - 86400 from ix) + 180")
def future_rows(spark, d):
    rows = _ix(spark, d)
    return ops.future_rows(rows, (ops.clock(rows) or 1.0) - 1.0 - 86400).agg(F.count(F.lit(1)).alias("n_future"))


@query(_STATE + f' select "user", item, round(value * pow({RATE}::double, ({_NOW} - tstamp) / 86400.0), 6) as weight from st')
def coo_decayed(spark, d):
    ev = _ev(spark, d)
    return _round(ops.matrix(ops.upsert(ev), DECAY, ops.clock(ev)), "weight", digits=6)


@query(_STATE + ' select "user", item, 1 as weight from st where "user" in (select "user" from st where item = 7) and item in (1, 2, 3, 7)')
def coo_selected_unweighted(spark, d):
    st = _st(spark, d)
    return ops.matrix(st, users=st.where("item = 7"), items=spark.createDataFrame([(1,), (2,), (3,), (7,)], "item long"), weighted=False)


@query(_STATE + f' select a.c_custkey as "user", a.k as item, round(coalesce(st.value * pow({RATE}::double, ({_NOW} - st.tstamp) / 86400.0), 0.0), 6) as rating from (select c_custkey, c_custkey % 100 as k from customer) a left join st on st."user" = a.c_custkey and st.item = a.k')
def pair_ratings(spark, d):
    ev = _ev(spark, d)
    pairs = table(spark, d, "customer").select(F.col("c_custkey").alias("user"), (F.col("c_custkey") % 100).alias("item"))
    return _round(ops.rating_of(ops.upsert(ev), pairs, DECAY, ops.clock(ev)), "rating", digits=6)


@query(_STATE + ' select a.c_custkey as "user", a.k as item, st.item is not null as interacted from (select c_custkey, c_custkey % 100 as k from customer) a left join st on st."user" = a.c_custkey and st.item = a.k')
def has_interaction(spark, d):
    pairs = table(spark, d, "customer").select(F.col("c_custkey").alias("user"), (F.col("c_custkey") % 100).alias("item"))
    return ops.has_interaction(_st(spark, d), pairs)


@query(_STATE + ' select "user", item, rank from (select "user", item, row_number() over (partition by "user" order by tstamp desc, item) as rank from st) where rank <= 5')
def user_recent_items(spark, d):
    return ops.recent_items(_st(spark, d), 5).select("user", "item", "rank")


@query(_STATE + " select distinct item from st")
def all_items(spark, d):
    return ops.all_items(_st(spark, d))


@query(_STATE + ' select distinct "user" from st')
def all_users(spark, d):
    return ops.all_users(_st(spark, d))


@query(_STATE + ' select distinct "user" from st where item in (3, 5)')
def users_by_items(spark, d):
    return ops.users_by_items(_st(spark, d), spark.createDataFrame([(3,), (5,)], "item long"))


@query(_STATE + ' select u."user", i.item from (select distinct "user" from st where item = 11) u cross join (select distinct item from st) i where not exists (select 1 from st where st."user" = u."user" and st.item = i.item)')
def non_interacted_items(spark, d):
    st = _st(spark, d)
    return ops.non_interacted(st, st.where("item = 11").select("user"))


@query(_STATE + ' select u."user", i.item from (select distinct "user" from st where item = 11) u cross join (select distinct item from st) i left join st on st."user" = u."user" and st.item = i.item where coalesce(st.value, 0) >= 0')
def non_negative_items(spark, d):
    ev = _ev(spark, d)
    st = ops.upsert(ev)
    return ops.non_negative(st, st.where("item = 11").select("user"), DECAY, ops.clock(ev))


@query(_STATE + ' select u."user", i.item from (select distinct "user" from st) u cross join (select distinct item from st) i where not exists (select 1 from st where st."user" = u."user" and st.item = i.item)')
def non_interacted_all(spark, d):
    """non_interacted_items for all users, not those of item 11 only."""
    st = _st(spark, d)
    return ops.non_interacted(st, st.select("user"))


@query(_STATE + ' select u."user", i.item from (select distinct "user" from st) u cross join (select distinct item from st) i left join st on st."user" = u."user" and st.item = i.item where coalesce(st.value, 0) >= 0')
def non_negative_all(spark, d):
    """non_negative_items for all users, not those of item 11 only."""
    ev = _ev(spark, d)
    st = ops.upsert(ev)
    return ops.non_negative(st, st.select("user"), DECAY, ops.clock(ev))


@query(_IX + ' select "user", item, count(*) as contacts from ix group by 1, 2')
def contact_counts(spark, d):
    return ops.contact_counts(_ix(spark, d))


@query(_IX + ' select "user", item, round(2.0::double * count(*) / (count(*) + 2.0::double), 6) as weight from ix group by 1, 2')
def similarity_weight(spark, d):
    return ops.contact_counts(_ix(spark, d)).select("user", "item", F.round(S.contact_weight(F.col("contacts")), 6).alias("weight"))


@query(_IX + " , p as (select item, count(*) as freq, max(seq) as last_seq from ix where rating > 0 group by 1) select item, freq, row_number() over (order by freq desc, last_seq) as rank from p qualify rank <= 100")
def hot_items(spark, d):
    return ops.hot_items(ops.popularity(_ix(spark, d)), 100)


@query(_STATE + _POP + ' select "user", item, rank from (select u."user", h.item, row_number() over (partition by u."user" order by h.rank) as rank from (select distinct "user" from st) u cross join hot h where not exists (select 1 from st where st."user" = u."user" and st.item = h.item)) where rank <= 10')
def hot_items_excl_seen(spark, d):
    ev = _ev(spark, d)
    st = ops.upsert(ev)
    return ops.hot_items_for(st, ops.popularity(ev), st.select("user"), K)


# -- ids and tags -----------------------------------------------------------------------------------------------


@query("select obj, row_number() over (order by first, obj) - 1 as id from (select event as obj, min(seq) as first from visitor_events where event is not null group by 1)")
def id_dictionary(spark, d):
    return dictionary(table(spark, d, "visitor_events").select("event", "seq"), "event", "seq")


@query("select seq, event from visitor_events")
def id_round_trip(spark, d):
    e = table(spark, d, "visitor_events").select("seq", "event")
    ids = dictionary(e, "event", "seq")
    return decode(encode(e, "event", ids, "id").select("seq", "id"), "id", ids, "event").select("seq", "event")


def _balance(c: Column) -> Column:
    return F.when(c < 0, "negative").when(c < 3000, "low").when(c < 7000, "middle").otherwise("high")


_USER_TAGS = """(select c_custkey as entity, ['segment#' || c_mktsegment, 'nation#' || c_nationkey::varchar,
  'balance#' || case when c_acctbal < 0 then 'negative' when c_acctbal < 3000 then 'low' when c_acctbal < 7000 then 'middle' else 'high' end] as tags from customer)"""
_ITEM_TAGS = """(select p_partkey as entity, ['brand#' || p_brand, 'type#' || p_type, 'size#' || (p_size // 10)::varchar] as tags from part)"""


def _user_tags(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("entity"), F.array(S.tag("segment", F.col("c_mktsegment")), S.tag("nation", F.col("c_nationkey")), S.tag("balance", _balance(F.col("c_acctbal")))).alias("tags"))


def _item_tags(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("entity"), F.array(S.tag("brand", F.col("p_brand")), S.tag("type", F.col("p_type")), S.tag("size", F.floor(F.col("p_size") / 10))).alias("tags"))


@query(f"select entity, unnest(tags) as tag from {_USER_TAGS}")
def user_tags(spark, d):
    return _user_tags(spark, d).select("entity", F.explode("tags").alias("tag"))


@query(f"select entity, unnest(tags) as tag from {_ITEM_TAGS}")
def item_tags(spark, d):
    return _item_tags(spark, d).select("entity", F.explode("tags").alias("tag"))


_VOCAB = f"(select tag, row_number() over (order by e, p, tag) - 1 as tag_id from (select tag, min(entity) as e, arg_min(pos, entity) as p from (select entity, unnest(tags) as tag, generate_subscripts(tags, 1) as pos from {_ITEM_TAGS}) group by tag))"


@query(f"select * from {_VOCAB}")
def tag_vocab(spark, d):
    return tags.vocabulary(_item_tags(spark, d))


@query(f"select count(*) as n from {_VOCAB}")
def tag_vocab_size(spark, d):
    return tags.n_features(tags.vocabulary(_item_tags(spark, d)))


@query(f"select entity, tag_id, count(*)::double as weight from (select entity, unnest(tags) as tag from {_ITEM_TAGS}) join {_VOCAB} using (tag) group by 1, 2")
def tag_multi_hot(spark, d):
    stored = _item_tags(spark, d)
    return tags.multi_hot(stored, tags.vocabulary(stored))


@query(f"select entity, 'id:' || entity::varchar as feature, 1.0::double as weight from {_ITEM_TAGS} union all select entity, 'tag:' || unnest(tags), 1.0::double from {_ITEM_TAGS}")
def identity_and_tag_features(spark, d):
    stored = _item_tags(spark, d)
    return tags.entity_features(stored.select("entity"), stored)


@query(f"select entity, unnest(case when entity % 2 = 0 then list_concat(tags, ['new#1']) else tags end) as tag from {_ITEM_TAGS} where entity % 3 <> 0")
def tags_put_and_clear(spark, d):
    stored = _item_tags(spark, d)
    new = stored.where("entity % 2 = 0").select("entity", F.array(F.lit("new#1")).alias("tags"))
    kept = tags.clear(tags.put(stored, new, append=True), stored.where("entity % 3 = 0"))
    return kept.select("entity", F.explode("tags").alias("tag"))


# -- splits and filters -----------------------------------------------------------------------------------------


def _both(parts: tuple[DataFrame, DataFrame]) -> DataFrame:
    a, b = (p.select("seq", F.lit(n).alias("part")) for n, p in zip(("train", "test"), parts))
    return a.unionByName(b)


@query(_IX + """ select seq, case when row_number() over (partition by "user" order by tstamp desc, seq desc) = 1 then 'test' else 'train' end as part from ix""")
def leave_last_out(spark, d):
    return _both(splits.leave_last_out(_ix(spark, d)))


@query(_IX + " select seq, case when tstamp < 1391000000 then 'train' else 'test' end as part from ix")
def temporal_split_ts(spark, d):
    return _both(splits.temporal(_ix(spark, d), timestamp=1391000000.0))


@query(_IX + " select seq, case when row_number() over (order by tstamp, seq) - 1 < trunc((1 - 0.2::double) * (select count(*) from ix)) then 'train' else 'test' end as part from ix")
def temporal_split_frac(spark, d):
    return _both(splits.temporal(_ix(spark, d)))


@query(_IX + """ select seq, case when row_number() over (partition by "user" order by tstamp, seq) - 1 < floor((1 - 0.2::double) * count(*) over (partition by "user")) then 'train' else 'test' end as part from ix""")
def temporal_user_split(spark, d):
    return _both(splits.temporal_by_user(_ix(spark, d)))


@query()
def random_split(spark, d):
    return _both(splits.random(_ix(spark, d), seed=7))


@query(_IX + ', u as (select "user" from ix group by 1 having count(*) >= 20), i as (select item from ix group by 1 having count(*) >= 20) select * from ix where "user" in (select "user" from u) or item in (select item from i)')
def n_core(spark, d):
    return splits.n_core(_ix(spark, d), ["user", "item"], 20).select("user", "item", "tstamp", "rating", "seq")


# -- joins and scalar functions ---------------------------------------------------------------------------------


@query("""
with v as (select user_id, ts, event_id from events where event_type = 'view'), p as (select user_id, ts, event_id from events where event_type = 'purchase')
select p.event_id, v.event_id as view_id from p asof left join v on p.user_id = v.user_id and p.ts >= v.ts
""")
def asof_property(spark, d):
    """The last view of the user at each purchase."""
    from ..operators.asof import merge_asof

    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    left = e.where("event_type = 'purchase'").select(F.col("user_id").alias("e"), "t", F.struct("event_id").alias("payload"))
    right = e.where("event_type = 'view'").select(F.col("user_id").alias("e"), "t", F.col("event_id").alias("tie"), F.lit("view").alias("prop"), F.col("event_id").alias("val"))
    return merge_asof(left, right, ["view"]).select("payload.event_id", F.col("at0.val").alias("view_id"))


#: An event with the last property row of its item, in order of time and seq, and parts of its time.
_SHOP = """
with p as (select itemid, timestamp, arg_max(property, seq) as property, arg_max(coalesce(value, chr(0)), seq) as v from item_properties_part1 where itemid is not null and timestamp is not null group by 1, 2),
j as (select e.*, p.property, nullif(p.v, chr(0)) as held, make_timestamp(e.timestamp * 1000) as moment from visitor_events e asof left join p on e.itemid = p.itemid and e.timestamp >= p.timestamp),
c as (select *, case when property = 'available' then held end as available, case when property = 'categoryid' then held end as categoryid,
  case when property is null or held is null or property in ('available', 'categoryid') then ''
    else array_to_string(list_transform(list_filter(regexp_split_to_array(trim(held, ' '), '\\s+'), lambda t: t <> '' and not starts_with(t, 'n')), lambda t: property || '#' || t), ' ') end as tags from j)
select seq, visitorid as "user", itemid as item, timestamp / 1000.0::double as tstamp, case event when 'view' then 1.0::double when 'addtocart' then 3.0 when 'transaction' then 5.0 end as rating,
  property, available, c.categoryid, t.parentid, tags, (isodow(moment) - 1)::int as day_of_week, hour(moment)::int as hour,
  case when hour(moment) < 4 then 'midnight' when hour(moment) < 8 then 'early morning' when hour(moment) < 12 then 'morning' when hour(moment) < 14 then 'noon' when hour(moment) < 17 then 'afternoon' when hour(moment) < 20 then 'evening' else 'night' end as time_of_day
from c left join category_tree t on c.categoryid = t.categoryid
"""


@query(_SHOP)
def shop_table(spark, d):
    """Events with the last property of their item, category, tags and parts of time."""
    out = shop_events(table(spark, d, "visitor_events"), table(spark, d, "item_properties_part1"), table(spark, d, "category_tree"))
    return out.select("seq", "user", "item", "tstamp", "rating", "property", "available", "categoryid", "parentid", F.concat_ws(" ", "tags").alias("tags"), "day_of_week", "hour", "time_of_day")


@query("""select seq, coalesce(hour(make_timestamp(timestamp * 1000)), -1) as hour, (isodow(make_timestamp(timestamp * 1000)) - 1)::int as day_of_week,
  case when hour(make_timestamp(timestamp * 1000)) < 4 then 'midnight' when hour(make_timestamp(timestamp * 1000)) < 8 then 'early morning' when hour(make_timestamp(timestamp * 1000)) < 12 then 'morning'
  when hour(make_timestamp(timestamp * 1000)) < 14 then 'noon' when hour(make_timestamp(timestamp * 1000)) < 17 then 'afternoon' when hour(make_timestamp(timestamp * 1000)) < 20 then 'evening' else 'night' end as period
  from visitor_events""")
def hour_period(spark, d):
    at = F.timestamp_millis("timestamp")
    return table(spark, d, "visitor_events").select("seq", F.coalesce(F.hour(at), F.lit(-1)).cast("long").alias("hour"), S.day_of_week(at).alias("day_of_week"), S.hour_period(F.hour(at)).alias("period"))


@query("select c_custkey, case when a < 0 then 'invalid' when a < 20 then '<20' when a < 40 then '20-39' when a < 60 then '40-59' else '60+' end as bin from (select c_custkey, c_acctbal / 100.0 as a from customer)")
def age_bins(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.age_bin(F.col("c_acctbal") / 100.0).alias("bin"))


@query("select seq, case event when 'view' then 1.0::double when 'addtocart' then 3.0 when 'transaction' then 5.0 end as rating from visitor_events")
def event_rating(spark, d):
    return table(spark, d, "visitor_events").select("seq", S.event_rating(F.col("event")).alias("rating"))


@query("select c_custkey, (c_custkey * 1000003) as id from customer")
def hex_ids(spark, d):
    h = F.concat(F.lit("ffffffff8"), F.lpad(F.lower(F.hex(F.col("c_custkey") * 1000003)), 15, "0"))
    return table(spark, d, "customer").select("c_custkey", S.hex_to_id(h).alias("id"))


@query("select doc_id, round(epoch(review_ts), 3) as t, strftime(review_ts, '%Y-%m-%d') as day from documents")
def review_times(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(S.epoch_seconds(F.col("review_ts")), 3).alias("t"), F.to_date("review_ts").cast("string").alias("day"))


@query("select vec_id, round(1 / (1 + exp(-least(greatest(10 * embedding[1]::double, -34.538776394910684::double), 34.538776394910684::double))), 6) as s from embeddings")
def sigmoid(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(S.sigmoid(10 * F.col("embedding")[0].cast("double")), 6).alias("s"))


@query("select item, title, regexp_extract(title, '\\((\\d{4})\\)\\s*$', 1) as year from movies where title is not null")
def title_years(spark, d):
    _, year = S.title_year(F.col("title"))
    return table(spark, d, "movies").where("title is not null").select("item", "title", F.coalesce(year.cast("string"), F.lit("")).alias("year"))


@query(r"""
with y as (select item, regexp_extract(title, '\((\d{4})\)\s*$', 1) as year, trim(regexp_replace(title, '\s*\(\d{4}\)\s*$', '')) as name from movies where title is not null)
select item, case when regexp_matches(name, '^(.*), (The|A|An)$') then regexp_extract(name, '^(.*), (The|A|An)$', 2) || ' ' || regexp_extract(name, '^(.*), (The|A|An)$', 1) else name end as name,
  try_cast(nullif(year, '') as int) as year from y
""")
def titles_turned(spark, d):
    """The titles with the article in front and without the year."""
    name, year = S.title_year(F.col("title"))
    return table(spark, d, "movies").where("title is not null").select("item", name.alias("name"), year.alias("year"))


@query("select item from movies where title ilike '%kettle%'")
def title_search(spark, d):
    return table(spark, d, "movies").where(S.contains_text(F.col("title"), "KETTLE")).select("item")


@query("""select seq, list_aggregate(list_filter(regexp_split_to_array(trim(value), '\\s+'), lambda t: t <> '' and not starts_with(t, 'n')), 'count') as n_tags
  from item_properties_part1 where value is not null and property not in ('available', 'categoryid')""")
def property_tags(spark, d):
    p = table(spark, d, "item_properties_part1").where("value is not null and property not in ('available', 'categoryid')")
    return p.select("seq", F.size(S.property_tags(F.col("property"), F.col("value"))).cast("long").alias("n_tags"))


@query("""with p as (select seq, property, regexp_split_to_array(trim(value, ' '), '\\s+') as parts from item_properties_part1 where value is not null and property not in ('available', 'categoryid'))
  select seq, array_to_string(list_transform(list_filter(parts, lambda t: t <> '' and not starts_with(t, 'n')), lambda t: property || '#' || t), ' ') as tags from p""")
def property_tag_values(spark, d):
    """The tags of a property's value, in order."""
    p = table(spark, d, "item_properties_part1").where("value is not null and property not in ('available', 'categoryid')")
    return p.select("seq", F.concat_ws(" ", S.property_tags(F.col("property"), F.col("value"))).alias("tags"))


@query(_IX + " select ix.seq, m.title, m.genres from ix join movies m using (item)")
def ratings_of_known_titles(spark, d):
    return _ix(spark, d).join(table(spark, d, "movies").select("item", "title", "genres"), "item").select("seq", "title", "genres")


@query("""with g as (select distinct m.item, trim(x) as genre from (select item, unnest(string_split(genres, '|')) as x from movies) m where trim(x) <> ''),
  u as (select distinct "user", genre from interactions join g using (item) where "user" is not null)
  select "user", string_agg(genre, '|' order by genre) as genres, count(*) as n from u group by 1""")
def genres_by_user(spark, d):
    """Each user's set of genres, split at bars."""
    g = table(spark, d, "movies").select("item", F.explode(F.split("genres", "\\|")).alias("x")).select("item", F.trim("x").alias("genre")).where("genre <> ''").distinct()
    pairs = table(spark, d, "interactions").where("user is not null").select("user", "item").distinct().join(g, "item")
    return pairs.groupBy("user").agg(F.array_sort(F.collect_set("genre")).alias("s")).select("user", F.concat_ws("|", "s").alias("genres"), F.size("s").cast("long").alias("n"))


@query()
def sampled_rows(spark, d):
    """A tenth of the rows, drawn by a hash of their number."""
    return splits.sample(_ix(spark, d), 0.1, seed=42).select("seq")


@query(_IX + ' select ix.seq, m.title, m.genres from ix left join movies m using (item)')
def ratings_with_titles(spark, d):
    return _ix(spark, d).join(table(spark, d, "movies").select("item", "title", "genres"), "item", "left").select("seq", "title", "genres")


@query("select o_custkey, count(*) as n, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) as last_order from orders group by 1")
def last_row_by_group(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))


@query(_IX + ', r as (select "user", item, rating, row_number() over (partition by "user" order by tstamp desc, seq desc) as n from ix) select "user", item, rating, n from r where n <= 3')
def recent_rows_by_user(spark, d):
    w = Window.partitionBy("user").orderBy(F.desc("tstamp"), F.desc("seq"))
    return _ix(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 3").select("user", "item", "rating", "n")


@query(_IX + ' select count(distinct item) as unrated from movies where item not in (select item from ix)')
def set_difference(spark, d):
    m = table(spark, d, "movies").select("item")
    return m.join(_ix(spark, d).select("item").distinct(), "item", "left_anti").agg(F.countDistinct("item").alias("unrated"))


# -- Gram, linear model, vectors --------------------------------------------------------------------------------

_GRAM = _STATE + ', g as (select a.item as i, b.item as j, sum(a.value * b.value) as g from st a join st b on a."user" = b."user" group by 1, 2)'
_NEAR = _GRAM + ", near as (select j as dst, i as src, g, row_number() over (partition by j order by g desc, i) as rank from g where i <> j qualify rank <= 10)"


def _x(spark, d) -> DataFrame:
    return _st(spark, d).select("user", "item", F.col("value").alias("weight"))


@query(_GRAM + " select i, j, round(g, 4) as g from g")
def gram_matrix(spark, d):
    return _round(gram(_x(spark, d)), "g")


@query(_NEAR + " select dst, src, round(g, 4) as g, rank from near")
def gram_topn(spark, d):
    return _round(neighbours(gram(_x(spark, d)), 10), "g")


@query(_NEAR + """, s as (select st."user", near.dst as item, sum(st.value * near.g) as score from st join near on st.item = near.src group by 1, 2),
  r as (select *, row_number() over (partition by "user" order by round(score, 6) desc, item) as rank from s where not exists (select 1 from st where st."user" = s."user" and st.item = s.item))
  select "user", item, round(score, 4) as score, rank from r where rank <= 10""")
def cooc_recommend(spark, d):
    """The best unseen items of each user with the neighbours' products as similarities."""
    x = _x(spark, d)
    sim = neighbours(gram(x), 10).select("src", "dst", F.col("g").alias("weight"))
    scored = ranking.exclude_seen(_round(linear.scores(x, sim), "score", digits=6), x)
    return _round(ranking.top_k(scored, K), "score")


@query(_NEAR + ' select "user", item, round(score, 4) as score, rank from (select *, row_number() over (partition by "user" order by round(score, 6) desc, item) as rank from (select st."user", near.dst as item, sum(st.value * near.g) as score from st join near on st.item = near.src where near.dst between 10 and 30 group by 1, 2)) where rank <= 10')
def candidate_recs(spark, d):
    """Among candidates, seen items not left out."""
    x = _x(spark, d)
    sim = neighbours(gram(x), 10).select("src", "dst", F.col("g").alias("weight"))
    some = spark.range(10, 31).withColumnRenamed("id", "item")
    scored = ranking.restrict(_round(linear.scores(x, sim), "score", digits=6), some, x)
    return _round(ranking.top_k(scored, K), "score")


_HOT = _STATE + _POP


@query(_HOT + " select c_custkey as \"user\", item, rank from customer cross join (select * from hot where rank <= 10) where c_custkey not in (select \"user\" from st)")
def cold_user_recs(spark, d):
    ev = _ev(spark, d)
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user"))
    cold = users.join(ops.all_users(ops.upsert(ev)), "user", "left_anti")
    hot = ops.hot_items(ops.popularity(ev), K).select("item", "rank")
    return cold.crossJoin(F.broadcast(hot)).select("user", "item", "rank")


@query(_HOT + " select item, row_number() over (order by rank) as rank from hot where item % 3 = 0 qualify row_number() over (order by rank) <= 10")
def hot_candidates(spark, d):
    ev = _ev(spark, d)
    pop = ops.popularity(ev)
    candidates = pop.where("item % 3 = 0").select("item")
    return ranking.intersect_ranked(ops.hot_items(pop.join(candidates, "item", "left_semi"), K), candidates, K)


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: v::double * v::double))), 5) as norm from embeddings")
def embedding_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(S.norm(F.col("embedding")), 5).alias("norm"))


@query("""with q as (select vec_id as query, embedding::double[] as e from embeddings where vec_id % 100 = 0), r as (
  select q.query, t.vec_id as item, round(list_cosine_similarity(q.e, t.embedding::double[]), 5) as score from q join embeddings t on t.vec_id <> q.query)
  select query, item, score from (select *, row_number() over (partition by query order by score desc, item) as n from r) where n <= 5""")
def similar_items_cosine(spark, d):
    """Every vector whose id divides by 100 against all vectors."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("entity"), F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    unit = e.withColumn("n", S.norm(F.col("vec"))).where("n > 0").select("entity", F.lit(0.0).alias("bias"), F.transform("vec", lambda v: v / F.col("n")).alias("vec"))
    asked = unit.where("entity % 100 = 0")
    found = factors.top_by_product(asked, unit, 8, exclude=asked.select(F.col("entity").alias("user"), F.col("entity").alias("item")))
    return ranking.top_k(_round(found.drop("rank"), "score", digits=5), 5).select(F.col("user").alias("query"), "item", "score")


#: The same on interactions, whose items grow with the data.
_STATE_IX = _IX + """, st as (select "user", item, arg_max(rating, seq) as value, arg_max(tstamp, seq) as tstamp from ix group by 1, 2)"""
_GRAM_IX = _STATE_IX + ', g as (select a.item as i, b.item as j, sum(a.value * b.value) as g from st a join st b on a."user" = b."user" group by 1, 2)'
_NEAR_IX = _GRAM_IX + ", near as (select j as dst, i as src, g, row_number() over (partition by j order by round(g, 6) desc, i) as rank from g where i <> j qualify rank <= 10)"


def _xi(spark, d) -> DataFrame:
    return ops.upsert(_ix(spark, d)).select("user", "item", F.col("value").alias("weight"))


def _near_ix(spark, d) -> tuple[DataFrame, DataFrame]:
    """Sums of products in different orders differ in their last digits: neighbours are ranked by six digits."""
    x = materialize(_xi(spark, d), "matrix")
    return x, nearest_items(x, 10, digits=6)


@query(_GRAM_IX + " select i, j, round(g, 3) as g from g")
def gram_matrix_ix(spark, d):
    return _round(gram(_xi(spark, d)), "g", digits=3)


@query(_NEAR_IX + " select dst, src, round(g, 3) as g, rank from near")
def gram_topn_ix(spark, d):
    return _round(_near_ix(spark, d)[1], "g", digits=3)


@query(_NEAR_IX + """, s as (select st."user", near.dst as item, sum(st.value * round(near.g, 6)) as score from st join near on st.item = near.src group by 1, 2),
  r as (select *, row_number() over (partition by "user" order by round(score, 4) desc, item) as rank from s where not exists (select 1 from st where st."user" = s."user" and st.item = s.item))
  select "user", item, round(score, 3) as score, rank from r where rank <= 10""")
def cooc_recommend_ix(spark, d):
    x, near = _near_ix(spark, d)
    sim = near.select("src", "dst", F.col("g").alias("weight"))
    return _round(linear.recommend(x, materialize(sim, "similarity"), x.select("user"), K, digits=4), "score", digits=3)


SLIM = linear.LinearConfig(neighbours=20, max_iter=2000, tol=1e-9)


def _linear(spark, d) -> tuple[DataFrame, DataFrame, linear.LargeMatrix]:
    """The matrix, the weights, and the matrix as the fit shares it."""
    x = materialize(_xi(spark, d), "matrix")
    matrix = linear.LargeMatrix(x)
    return x, materialize(linear.fit(x, SLIM, matrix=matrix), "weights"), matrix


def _fitted(spark, d) -> tuple[DataFrame, DataFrame]:
    """The matrix and the weights, where the fit's own tables aren't read again."""
    x, sim, matrix = _linear(spark, d)
    matrix.discard()
    return x, sim


@query()
def slim_weights(spark, d):
    return _round(_fitted(spark, d)[1], "weight", digits=6)


@query(_STATE_IX + ', t as (select distinct a.item as dst from st a join st b on a."user" = b."user" and a.item <> b.item) select dst, 0.0::double as violation from t')
def slim_optimality(spark, d):
    """By target, how far the weights are from the conditions of the optimum, as a share of the penalty."""
    x, sim, matrix = _linear(spark, d)
    n = x.agg(F.max("user") + 1).first()[0] or 1
    return _round(linear.violations(x, sim, SLIM, n, matrix), "violation", digits=3)


@query()
def slim_recommend(spark, d):
    x, sim = _fitted(spark, d)
    return _round(linear.recommend(x, sim, x.select("user"), K), "score")


@query()
def slim_similar_items(spark, d):
    x, sim = _fitted(spark, d)
    return _round(linear.similar_items(sim, x.select("item"), K), "score")


@query()
def slim_refit_touched(spark, d):
    """The weights after solving the items of the last tenth of the arrivals anew upon the whole matrix."""
    x, sim, matrix = _linear(spark, d)
    rows = _ix(spark, d)
    last = rows.approxQuantile("seq", [0.9], 0.001) or [0.0]
    return _round(linear.refit(sim, x, rows.where(F.col("seq") > last[0]).select("item"), SLIM, matrix=matrix), "weight", digits=6)


def _genre_tags(spark, d) -> DataFrame:
    g = table(spark, d, "movies").select(F.col("item").alias("entity"), F.transform(F.split("genres", "\\|"), F.trim).alias("tags"))
    return g.select("entity", F.filter("tags", lambda t: t != "").alias("tags")).where("tags is not null")


def _fm(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    x = materialize(_xi(spark, d), "matrix")
    users = tags.entity_features(x.select(F.col("user").alias("entity")).distinct())
    items = tags.entity_features(x.select(F.col("item").alias("entity")).distinct(), _genre_tags(spark, d))
    return x, users, items, factors.fit(x, users, items, factors.FactorConfig())


@query()
def fm_embeddings(spark, d):
    return _fm(spark, d)[3]


@query()
def fm_recommend(spark, d):
    x, users, items, params = _fm(spark, d)
    return factors.recommend(params, users, items, x, K)


@query()
def fm_similar_items(spark, d):
    x, _, items, params = _fm(spark, d)
    return factors.similar_items(params, items, x.select("item"), K)


@query()
def hybrid_recommend(spark, d):
    """Among all items, seen ones too: linear scores weigh by the user's contacts with the item, and an unseen item has none.

    The fit counts users, not the unused ids below the largest one: with these its penalty leaves hardly any weights.
    """
    x, users, items, params = _fm(spark, d)
    by_factors = factors.recommend(params, users, items, None, K).drop("rank")
    sim = materialize(linear.fit(x, SLIM, x.select("user").distinct().count()), "weights")
    by_linear = linear.recommend(x, sim, x.select("user"), K, exclude_seen=False).drop("rank")
    return ranking.ensemble(by_factors, by_linear, ops.contact_counts(_ix(spark, d)), K)


# -- rank fusion and metrics --------------------------------------------------------------------------------------

#: Two scored lists: a user's items by value, and by recency in days.
_LISTS = _STATE + """
, a as (select "user", item, value as score, row_number() over (partition by "user" order by value desc, item) as rank from st qualify rank <= 20),
b as (select "user", item, tstamp / 86400.0 as score, row_number() over (partition by "user" order by tstamp / 86400.0 desc, item) as rank from st qualify rank <= 20),
na as (select "user", item, (score - min(score) over w) / (max(score) over w - min(score) over w + 1e-8) as score from a window w as (partition by "user")),
nb as (select "user", item, (score - min(score) over w) / (max(score) over w - min(score) over w + 1e-8) as score from b window w as (partition by "user")),
ra as (select "user", item, case when count(*) over (partition by "user") > 1 then 1 - (rank - 1) / (count(*) over (partition by "user") - 1)::double else 1.0 end as score from a),
rb as (select "user", item, case when count(*) over (partition by "user") > 1 then 1 - (rank - 1) / (count(*) over (partition by "user") - 1)::double else 1.0 end as score from b)"""


def _lists(spark, d) -> tuple[DataFrame, DataFrame]:
    st = _st(spark, d)
    by_value = ranking.top_k(st.select("user", "item", F.col("value").alias("score")), 20)
    by_time = ranking.top_k(st.select("user", "item", (F.col("tstamp") / 86400.0).alias("score")), 20)
    return by_value, by_time


@query(_LISTS + ' select "user", item, round(score, 4) as score from nb')
def minmax_scores(spark, d):
    return _round(ranking.min_max(_lists(spark, d)[1]).select("user", "item", "score"), "score")


@query(_LISTS + ' select "user", item, round(score, 6) as score from ra')
def rank_normalize(spark, d):
    return _round(ranking.rank_scores(_lists(spark, d)[0]).select("user", "item", "score"), "score", digits=6)


@query(_LISTS + ' select "user", item, round(sum(score), 4) as score from (select * from na union all select * from nb) group by 1, 2')
def comb_sum(spark, d):
    return _round(ranking.comb_sum([ranking.min_max(x) for x in _lists(spark, d)]), "score")


@query(_LISTS + ' select "user", item, round(sum(score) * count(*), 4) as score from (select * from na union all select * from nb) group by 1, 2')
def comb_mnz(spark, d):
    return _round(ranking.comb_mnz([ranking.min_max(x) for x in _lists(spark, d)]), "score")


@query(_LISTS + ' select "user", item, round(sum(score), 6) as score from (select "user", item, 0.7::double * score as score from ra union all select "user", item, 0.3::double * score from rb) group by 1, 2')
def weighted_borda(spark, d):
    return _round(ranking.weighted_borda(_lists(spark, d), [0.7, 0.3]), "score", digits=6)


@query(_LISTS + """, c as (select "user", item, count(*) as n from ev group by 1, 2),
  e as (select "user", item, sum(score) as score from (select * from na union all select nb."user", nb.item, nb.score * 2.0::double * coalesce(n, 0) / (coalesce(n, 0) + 2.0::double) from nb left join c using ("user", item)) group by 1, 2)
  select "user", item, round(score, 4) as score from (select *, row_number() over (partition by "user" order by score desc, item) as rank from e) where rank <= 10""")
def ensemble_topk(spark, d):
    a, b = _lists(spark, d)
    found = ranking.ensemble(a.drop("rank"), b.drop("rank"), ops.contact_counts(_ev(spark, d)), K)
    return _round(found.select("user", "item", "score"), "score")


#: Popular items of the first 80 % of the events against each user's later ones.
_EVAL = _EV + """
, o as (select *, row_number() over (order by tstamp, seq) - 1 as n from ev), train as (select * from o where n < trunc((1 - 0.2::double) * (select count(*) from ev))),
test as (select "user", item from o where n >= trunc((1 - 0.2::double) * (select count(*) from ev))),
pop as (select item, count(*) as freq, max(seq) as last_seq from train where rating > 0 group by 1),
hot as (select item, row_number() over (order by freq desc, last_seq) as rank from pop qualify rank <= 10),
u as (select distinct "user" from test), size as (select "user", count(*) as t from test group by 1),
h as (select u."user", hot.rank, (exists (select 1 from test where test."user" = u."user" and test.item = hot.item))::int as hit from u cross join hot),
c as (select *, sum(hit) over (partition by "user" order by rank) as tp_here from h),
q as (select "user", count(*) as n, sum(hit) as tp, coalesce(sum(1 / log2(rank + 1.0)) filter (hit = 1), 0) as dcg, min(rank) filter (hit = 1) as first,
  coalesce(sum(tp_here / rank::double) filter (hit = 1), 0) as ap, coalesce(sum(tp_here) filter (hit = 0), 0) as pairs from c group by 1),
m as (select "user", n, t, tp, tp / n::double as precision, tp / t::double as recall,
  case when tp > 0 then 2 * (tp / n::double) * (tp / t::double) / (tp / n::double + tp / t::double) else 0.0 end as f1,
  dcg / (select sum(1 / log2(r.range + 1.0)) from range(1, 11) r where r.range <= least(t, 10)) as ndcg, (tp > 0)::int::double as hit, coalesce(1 / first::double, 0) as rr, ap / least(t, 10) as ap,
  case when tp = 0 then 0.0 when tp = n then 1.0 else pairs / (tp * (n - tp))::double end as auc from q join size using ("user"))"""


def _evaluated(spark, d) -> DataFrame:
    train, test = splits.temporal(_ev(spark, d))
    hot = ops.hot_items(ops.popularity(train), K).select("item", "rank")
    users = test.select("user").distinct()
    return metrics.per_query(users.crossJoin(F.broadcast(hot)), test.select("user", "item"), K, users)


@query(_EVAL + ' select "user", n as n_ranked, t as n_truth, tp, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, round(ndcg, 6) as ndcg, hit, round(rr, 6) as rr, round(ap, 6) as ap, round(auc, 6) as auc from m')
def metrics_per_user(spark, d):
    return _round(_evaluated(spark, d), "precision", "recall", "f1", "ndcg", "rr", "ap", "auc", digits=6)


@query(_EVAL + " select round(avg(precision), 5) as precision, round(avg(recall), 5) as recall, round(avg(f1), 5) as f1, round(avg(ndcg), 5) as ndcg, round(avg(hit), 5) as hit_rate, round(avg(rr), 5) as mrr, round(avg(ap), 5) as map, round(avg(auc), 5) as auc, sum(tp) as tp from m")
def eval_summary(spark, d):
    out = metrics.summary(_evaluated(spark, d))
    return _round(out, *(c for c in out.columns if c != "tp"), digits=5)


@query(_EVAL + """ select "user", string_agg(item::varchar, ',' order by item) as items from test group by 1""")
def ground_truth(spark, d):
    _, test = splits.temporal(_ev(spark, d))
    return test.groupBy("user").agg(F.concat_ws(",", F.sort_array(F.collect_list("item")).cast("array<string>")).alias("items"))


# -- streaming ----------------------------------------------------------------------------------------------------


def _streamed(spark, d, config: ops.StateConfig) -> DataFrame:
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    for part in _in_parts(_ix(spark, d), 4):
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
    state = StateTable(spark, f"{base}/state", config)
    start(stream_files(spark, f"{base}/in"), state, f"{base}/checkpoint").awaitTermination()
    return _round(state.read(), "value")


@query(_fold_sql(_IX, "ix", None))
def stream_state(spark, d):
    """The state of all interactions, arrived as a stream of four files."""
    return _streamed(spark, d, ops.StateConfig())


@query(_fold_sql(_IX, "ix", RATE))
def stream_state_decay(spark, d):
    """The same with decay: the clock is carried from batch to batch."""
    return _streamed(spark, d, DECAY)


# row numbers are INT here and sums of whole numbers BIGINT; SQL's are wider
for _names, _column, _kind in (
    (("user_recent_items", "hot_items", "hot_items_excl_seen", "gram_topn", "cooc_recommend", "candidate_recs", "cold_user_recs", "hot_candidates", "gram_topn_ix", "cooc_recommend_ix"), "rank", "int"),
    (("recent_rows_by_user",), "n", "int"),
    (("metrics_per_user", "eval_summary"), "tp", "bigint"),
):
    for _name in _names:
        ORACLE[_name] = f"select * replace ({_column}::{_kind} as {_column}) from ({ORACLE[_name]})"

__all__ = ["ORACLE", "QUERIES"]
