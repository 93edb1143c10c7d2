"""Scalar column functions: math, conditions, dates, strings and ids."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: arguments of the sigmoid are cut to this distance from 0.
SIGMOID_BOUND = 34.538776394910684

#: First hour of each part of the day and its name; hours outside 0..23 are 'unknown'.
PERIODS = ((0, "midnight"), (4, "early morning"), (8, "morning"), (12, "noon"), (14, "afternoon"), (17, "evening"), (20, "night"))
#: Event ratings of a shop.
EVENT_RATINGS = {"view": 1.0, "addtocart": 3.0, "transaction": 5.0}
SECONDS_A_DAY = 86400.0


def sigmoid(x: Column) -> Column:
    bound = F.lit(SIGMOID_BOUND)
    return 1 / (1 + F.exp(-F.least(F.greatest(x, -bound), bound)))


def decay_rate(days: float | None) -> float | None:
    """The factor of one day for a half life of `days`, to first order: 1 - ln 2 / days."""
    return None if days is None else 1 - math.log(2) / days


def decayed(value: Column, since: Column, now: Column, rate: float | None) -> Column:
    """The value after now - since seconds."""
    return value if rate is None else value * F.pow(F.lit(rate), (now - since) / SECONDS_A_DAY)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def log2_discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def contact_weight(n: Column, most: float = 2.0, k: float = 2.0) -> Column:
    """most n / (n + k)."""
    return F.lit(float(most)) * n / (n + F.lit(float(k)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column, avoid_zero: bool = False) -> Column:
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, F.lit(1e-10)).otherwise(n) if avoid_zero else n


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def hour_period(hour: Column) -> Column:
    out = F.when((hour < 0) | (hour > 23) | hour.isNull(), "unknown")
    for first, name in reversed(PERIODS):
        out = out.when(hour >= first, name)
    return out


def age_bin(age: Column) -> Column:
    return F.when(age < 0, "invalid").when(age < 20, "<20").when(age < 40, "20-39").when(age < 60, "40-59").otherwise("60+")


def event_rating(event: Column, ratings: dict[str, float] | None = None) -> Column:
    """The rating of an event by its name, null for others."""
    out = F.lit(None).cast("double")
    for name, value in (ratings or EVENT_RATINGS).items():
        out = F.when(event == name, F.lit(float(value))).otherwise(out)
    return out


def hex_to_id(text: Column) -> Column:
    """The last 16 hex digits as a non-negative 63-bit number."""
    wide = F.conv(F.right(text, F.lit(16)), 16, 10).cast("decimal(20,0)")
    half = F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(wide >= half, wide - half).otherwise(wide).cast("long")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, read as UTC."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def day_of_week(ts: Column) -> Column:
    """0 on Monday."""
    return F.weekday(ts)


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def date_seconds(text: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.unix_timestamp(F.to_date(text, pattern).cast("timestamp")).cast("double")


def tag(name: str, value: Column, missing: str = "None") -> Column:
    """'name#value'."""
    return F.concat(F.lit(f"{name}#"), F.coalesce(value.cast("string"), F.lit(missing)))


def property_tags(prop: Column, value: Column, plain: Sequence[str] = ("available", "categoryid")) -> Column:
    """'property#token' of each blank-separated token that doesn't begin with n; none for plain or null properties."""
    tokens = F.filter(F.split(F.trim(F.coalesce(value, F.lit("nan"))), r"\s+"), lambda t: (t != "") & ~t.startswith("n"))
    some = prop.isNotNull() & ~prop.isin(list(plain))
    return F.when(some, F.transform(tokens, lambda t: F.concat(prop, F.lit("#"), t))).otherwise(F.array().cast("array<string>"))


def title_year(title: Column) -> tuple[Column, Column]:
    """('The Name', 1995) of 'Name, The (1995)'; the title as it stands and null without a year."""
    year = F.regexp_extract(title, r"\((\d{4})\)\s*$", 1)
    bare = F.trim(F.regexp_replace(title, r"\s*\(\d{4}\)\s*$", ""))
    article = F.regexp_extract(bare, r"^(.*), (The|A|An)$", 2)
    turned = F.when(article != "", F.concat(article, F.lit(" "), F.regexp_extract(bare, r"^(.*), (The|A|An)$", 1))).otherwise(bare)
    return turned, F.when(year != "", year.cast("int"))


def one_hot_names(names: Sequence[str], sep: str = "|") -> Column:
    """The names of the columns that are 1, joined."""
    return F.concat_ws(sep, *(F.when(F.col(f"`{n}`") == 1, F.lit(n)) for n in names))


def first_or(array: Column, default: Column) -> Column:
    return F.coalesce(F.get(array, F.lit(0)), default)


def contains_text(c: Column, part: str) -> Column:
    """Case-insensitive substring test; false for null."""
    return F.coalesce(F.contains(F.lower(c), F.lit(part.lower())), F.lit(False))


def downcast(df: DataFrame) -> DataFrame:
    """Whole-number columns in the narrowest type that holds them; two numbers a column come to the driver."""
    whole = [c for c, k in df.dtypes if k in ("bigint", "int", "smallint")]
    if not whole:
        return df
    found = df.agg(*(f(F.col(f"`{c}`")).alias(f"{n}_{i}") for i, c in enumerate(whole) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    kinds = (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63))
    for i, c in enumerate(whole):
        lo, hi = found[f"lo_{i}"], found[f"hi_{i}"]
        if lo is not None:
            df = df.withColumn(c, F.col(f"`{c}`").cast(next(k for k, b in kinds if -(1 << b) <= lo and hi < (1 << b))))
    return df
