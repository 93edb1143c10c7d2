"""One row per entity with count, latest time, recency and total for every event type.

The spellings of the event column are read first: each gets the position of its type in the explicit list. Events
are then aggregated by (entity, position) to a compact long table, with partial aggregation before the shuffle, so a
busy entity costs no task more than its types. The long table is gathered by entity, at most one cell a type, and
pivoted: sorted cells are placed at their positions with blanks in between, in one pass over list and cells.

The spellings are broadcast as a table of (spelling, position) while there are at most MAX_SPELLINGS; beyond that
each row's spelling is normalised on its own, with the same result.

Times keep their type: whole numbers, fractions or timestamps; recency is in the unit of the times, seconds for
timestamps.

Defined results: rows with a null entity or type are left out; a null value adds nothing, and a total of none but
null values is null; a type that an entity doesn't have is a count of 0 with null latest time, recency and total;
repeated rows count each. A type that is empty after normalising is a type. Types outside an explicit list have no
cell, and an entity with no other types has no row. An empty table gives no rows and no types.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Event types beyond this number aren't a feature table: more columns than a row should have.
MAX_TYPES = 5_000
#: Spellings up to this number are looked up in a broadcast table.
MAX_SPELLINGS = 100_000


def normal_type(c: Column) -> Column:
    """Lower case, with everything but a-z and 0-9 removed."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def spellings(df: DataFrame, event: str) -> DataFrame:
    """(spelled, event_type): the distinct spellings and their types."""
    return df.select(F.col(event).alias("spelled")).where("spelled is not null").distinct().withColumn("event_type", normal_type(F.col("spelled")))


def event_types(df: DataFrame, event: str) -> list[str]:
    """The types of the table, sorted. More than MAX_TYPES is an error, never a cut."""
    found = [r[0] for r in spellings(df, event).select("event_type").distinct().limit(MAX_TYPES + 1).collect()]
    if len(found) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} event types: give an explicit list")
    return sorted(found)


def _known(df: DataFrame, event: str) -> list[tuple[str, str]] | None:
    """The distinct spellings with their types, or None where there are more than MAX_SPELLINGS."""
    found = spellings(df, event).limit(MAX_SPELLINGS + 1).collect()
    return None if len(found) > MAX_SPELLINGS else [(r["spelled"], r["event_type"]) for r in found]


def _positions(df: DataFrame, event: str, known: list[tuple[str, str]] | None, types: Sequence[str]) -> DataFrame:
    """df with pos, the position of the row's type in the list; rows of other types are left out."""
    spark, at = df.sparkSession, {t: i for i, t in enumerate(types)}
    if known is not None:
        table = spark.createDataFrame([(s, at[t]) for s, t in known if t in at], "spelled string, pos int")
        return df.join(F.broadcast(table), "spelled")
    table = spark.createDataFrame(list(at.items()), "event_type string, pos int")
    return df.withColumn("event_type", normal_type(F.col("spelled"))).join(F.broadcast(table), "event_type")


def _time(df: DataFrame, time: str) -> Column:
    """The time in its own type, whole numbers as long; NaN as null."""
    kind, t = df.schema[time].dataType, F.col(time)
    if isinstance(kind, T.IntegralType):
        return t.cast("long")
    return F.when(~F.isnan(t), t) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else t


def _since(now: Column, last: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.NumericType):
        return now - last
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / 1_000_000


def long_table(df: DataFrame, entity: str, event: str, time: str, value: str, types: Sequence[str], known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(entity, pos, n, last_ts, total): the compact table of all cells, by position in the list of types."""
    src = df.select(F.col(entity).alias("entity"), F.col(event).alias("spelled"), _time(df, time).alias("t"), F.col(value).cast("double").alias("v"))
    src = _positions(src.where("entity is not null and spelled is not null"), event, known, types)
    return src.groupBy("entity", "pos").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("last_ts"), F.sum("v").alias("total"))


def _resolve(df: DataFrame, event: str, types: Sequence[str] | None) -> tuple[list[str], list[tuple[str, str]] | None]:
    """The list of types, by default all of the table, and the spellings that are known."""
    known = _known(df, event)
    if types is not None:
        return list(types), known
    found = event_types(df, event) if known is None else sorted({t for _, t in known})
    if len(found) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} event types: give an explicit list")
    return found, known


def pivoted(df: DataFrame, entity: str, event: str, time: str, value: str, types: Sequence[str], as_of: float | datetime | None = None, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(entity, cells): one row per entity, its cells (n, last_ts, recency, total) aligned to the list of types."""
    if as_of is None:
        as_of = df.agg(F.max(_time(df, time))).first()[0]
    cells = long_table(df, entity, event, time, value, types, known)
    kind = cells.schema["last_ts"].dataType
    recency = _since(F.lit(as_of).cast(kind), F.col("last_ts"), kind)
    cell = F.struct("n", "last_ts", recency.alias("recency"), "total")
    shape = cells.select(cell.alias("c")).schema["c"].dataType
    packed = cells.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("pos", cell.alias("cell")))).alias("c"))
    none = F.struct(F.lit(0).cast("long").alias("n"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in shape.fields[1:]))
    blanks = lambda n: F.array_repeat(none, n)
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get("c", i - 1)["pos"])
    placed = F.flatten(F.transform("c", lambda x, i: F.concat(blanks(x["pos"] - before(i) - 1), F.array(x["cell"]))))
    row = F.concat(placed, blanks(F.lit(len(types)) - F.element_at("c", -1)["pos"] - 1))
    return packed.select(F.col("entity").alias(entity), row.alias("cells"))


def feature_table(df: DataFrame, entity: str, event: str, time: str, value: str, types: Sequence[str] | None = None, as_of: float | datetime | None = None) -> DataFrame:
    """The wide table: entity, then a struct e_{type} of (n, last_ts, recency, total) for each type.

    `as_of` is the moment that recency counts from, by default the latest time of the table.
    """
    types, known = _resolve(df.where(F.col(entity).isNotNull()), event, types)
    if not types:
        return df.where("false").select(entity)
    row = pivoted(df, entity, event, time, value, types, as_of, known)
    return row.select(entity, *(F.col("cells")[i].alias(f"e_{t}") for i, t in enumerate(types)))


def feature_cells(df: DataFrame, entity: str, event: str, time: str, value: str, types: Sequence[str] | None = None, as_of: float | datetime | None = None) -> DataFrame:
    """(entity, event_type, n, last_ts, recency, total): the cells of the pivoted rows with a count above zero."""
    types, known = _resolve(df.where(F.col(entity).isNotNull()), event, types)
    row = pivoted(df, entity, event, time, value, types or [""], as_of, known)
    cells = row.select(entity, F.posexplode("cells").alias("pos", "cell")).where("cell.n > 0")
    return cells.select(entity, F.get(F.lit(types or [""]), F.col("pos")).alias("event_type"), "cell.*")


def unpivot_features(wide: DataFrame, entity: str) -> DataFrame:
    """The cells of the wide table with a count above zero, as feature_cells gives them."""
    columns = [c for c in wide.columns if c != entity and c.startswith("e_")]
    names = ("n", "last_ts", "recency", "total")
    if not columns:
        return wide.select(F.col(entity), *(F.lit(None).cast(k).alias(c) for c, k in zip(("event_type", *names), ("string", "long", "long", "long", "double"))))
    long = wide.select(F.col(entity), F.posexplode(F.array(*(F.col(f"`{c}`") for c in columns))).alias("pos", "cell")).where("cell.n > 0")
    return long.select(F.col(entity), F.get(F.lit([c[2:] for c in columns]), F.col("pos")).alias("event_type"), *(f"cell.{c}" for c in names))
