"""Several values packed in one field: infer the delimiters of a source, then split and explode.

A candidate delimiter is scored over all fields of the source on
  consistency: 1 / (1 + squared coefficient of variation of the piece counts of the fields that hold it), and
  regularity:  the share of pieces whose type also occurs as a whole field of the source or between other delimiters.
The type of a piece with a digit is its shape (digit runs as 0, letter runs as a); of other pieces the lower-case
piece. The product must reach `threshold`. The whole source is first aggregated to its distinct shapes, and the
scores are gathered from these, weighted; the result holds one row per candidate.

Defined results: a null, blank or placeholder field gives no rows; an empty slot takes no position; a value given
twice comes out twice; a quote mark that is never closed is an ordinary character; other columns of the input,
whatever their names, are dropped. An empty table gives an empty result. Texts of any length are split whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Characters that may separate. Hyphen, dot, underscore and apostrophe never do.
CANDIDATES = ("|", ",", ";", "/", "\t", "\n", "｜", "；", "，", "、", " ")
#: Whole fields or pieces that stand for no value.
PLACEHOLDERS = ("-", "n/a", "(none)")
#: Brackets that may enclose a whole list.
BRACKETS = (("[", "]"), ("{", "}"), ("(", ")"))

_BLANK = r"[\s\u00a0\u3000]"
_BLANKS = " \t\n\r\x0b\x0c\u00a0\u3000"


@dataclass(frozen=True)
class DelimiterModel:
    """The delimiters of one source and the scores they were chosen by."""

    delimiters: tuple[str, ...]
    scores: dict[str, float] = field(default_factory=dict)


def _class(chars: Sequence[str]) -> str:
    """A regex class body of the characters; a blank stands for every kind of white space."""
    known = {"\t": r"\t", "\n": r"\n", " ": r"\s\u00a0\u3000"}
    return "".join(known.get(c) or (c if c.isalnum() or ord(c) > 127 else "\\" + c) for c in chars)


def _quoted(stop: str) -> str:
    """A value in quotes that a delimiter, or the end, follows; doubled and escaped marks stay inside."""
    after = rf"(?={_BLANK}*(?:{stop}$))"
    one = r'''{q}[^{q}\\]*+(?:(?:\\[\s\S]|{q}{q})[^{q}\\]*+)*+{q}'''
    return "|".join(one.format(q=q) + after for q in ('"', "'"))


def token_pattern(delimiters: Sequence[str]) -> str:
    """The regex whose matches, in order, are the slots of a field split at the delimiters."""
    if not delimiters:
        return r"([\s\S]+)"
    d = _class(delimiters)
    stop = f"[{d}]|"
    placeholder = rf"(?i:n/a)(?={_BLANK}*(?:{stop}$))"
    return rf"{_BLANK}*({_quoted(stop)}|{placeholder}|[^{d}]+)"


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def _unbracket(text: Column) -> Column:
    """The trimmed field without the brackets around a whole list."""
    out = text
    for left, right in BRACKETS:
        inner = F.substring(text, F.lit(2), F.length(text) - 2)
        whole = text.startswith(left) & text.endswith(right) & (F.length(text) >= 2)
        out = F.when(whole & ~inner.contains(left) & ~inner.contains(right), inner).otherwise(out)
    return out


def _placeholder(text: Column, placeholders: Sequence[str]) -> Column:
    return F.lower(text).isin([p.lower() for p in placeholders]) if placeholders else F.lit(False)


def _unquote(token: Column) -> Column:
    def bare(mark: str) -> Column:
        body = F.substring(token, F.lit(2), F.length(token) - 2)
        return F.regexp_replace(F.replace(body, F.lit(mark + mark), F.lit(mark)), r"\\([\s\S])", "$1")

    out = token
    for mark in ('"', "'"):
        closed = token.startswith(mark) & token.endswith(mark) & (F.length(token) >= 2)
        out = F.when(closed, bare(mark)).otherwise(out)
    return out


def split_values(text: Column, model: DelimiterModel, placeholders: Sequence[str] = PLACEHOLDERS) -> Column:
    """The array of the values of a trimmed field, in order; null for a null, blank or placeholder field."""
    slots = F.regexp_extract_all(_unbracket(text), F.lit(token_pattern(model.delimiters)), F.lit(1))
    values = F.filter(F.transform(slots, lambda t: _trim(_unquote(_trim(t)))), lambda v: v != "")
    return F.when((text != "") & ~_placeholder(text, placeholders), values)


def score_delimiters(df: DataFrame, field_name: str, candidates: Sequence[str] = CANDIDATES, placeholders: Sequence[str] = PLACEHOLDERS) -> DataFrame:
    """One row per candidate: cand, fields, consistency, regularity, score."""
    stop = f"[{_class(candidates)}]|"
    strong = [c for c in candidates if c != " "]
    text = df.select(_trim(F.col(field_name)).alias("t")).where((F.col("t") != "") & ~_placeholder(F.col("t"), placeholders))
    # fields that differ in their digits only are one shape, scored once with its weight
    shapes = text.select(F.regexp_replace(F.lower(_unbracket(F.col("t"))), r"\d+", "0").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("w"))
    # what stands in quotes at a value's start is one piece of its own type
    masked = F.regexp_replace("t", rf"(^|[{_class(candidates)}])({_quoted(stop)})", "$1\u0001")
    src = shapes.select("w", _trim(masked).alias("m"))
    present = F.filter(F.array(*map(F.lit, strong)), lambda c: F.contains(F.col("m"), c))
    src = src.select("w", "m", present.alias("p"))
    src = src.select("w", "m", F.when(F.size("p") > 0, F.col("p")).when(F.col("m").rlike(_BLANK), F.array(F.lit(" "))).otherwise(F.array().cast("array<string>")).alias("cands"))
    pieces = F.when(F.size("cands") == 0, F.array("m")).when(F.col("cands")[0] == " ", F.split("m", f"{_BLANK}+")).otherwise(F.split("m", f"[{_class(strong)}]"))
    src = src.select("w", "m", "cands", F.filter(F.transform(pieces, _trim), lambda p: p != "").alias("pieces"))

    def kind(p: Column) -> Column:
        return F.when(p.contains("0"), F.regexp_replace(p, r"\p{L}+", "a")).otherwise(p)

    # (what, candidate, key): piece counts of the fields, and the types of pieces and of whole fields
    row = lambda what, cand, key: F.struct(F.lit(what).alias("what"), cand.alias("cand"), key.alias("key"))
    counts = F.transform("cands", lambda c: row("n", c, F.size("pieces").cast("string")))
    alone = (F.size("cands") == 0) | (F.col("cands")[0] == " ")
    whole = F.when(alone, F.array(row("whole", F.lit(""), kind(F.col("m"))))).otherwise(F.array().cast("array<struct<what:string,cand:string,key:string>>"))
    typed = F.flatten(F.transform("cands", lambda c: F.transform("pieces", lambda p: row("type", c, kind(p)))))
    rows = src.select("w", F.explode(F.concat(counts, whole, typed)).alias("r")).select("r.*", "w").groupBy("what", "cand", "key").agg(F.sum("w").alias("w"))
    # three aggregates read the counted pieces: written once, they are made once
    rows = materialize(rows, "pieces")

    # a type is known to a candidate if it stands alone somewhere, or between other delimiters, or is quoted
    seen = rows.where(F.col("what") != "n").groupBy("key").agg(F.max(F.col("what") == "whole").alias("whole"), F.collect_set(F.when((F.col("what") == "type") & (F.col("cand") != " "), F.col("cand"))).alias("by"))
    known = F.col("whole") | (F.size(F.array_except("by", F.array("cand"))) > 0) | (F.col("key") == "\u0001")
    regular = rows.where(F.col("what") == "type").join(seen, "key").groupBy("cand").agg((F.sum(F.when(known, F.col("w")).otherwise(0)) / F.sum("w")).alias("regularity"))
    k = F.col("key").cast("double")
    mean, square = F.sum(k * F.col("w")) / F.sum("w"), F.sum(k * k * F.col("w")) / F.sum("w")
    steady = rows.where(F.col("what") == "n").groupBy("cand").agg(F.sum("w").alias("fields"), F.coalesce(F.try_divide(mean * mean, square), F.lit(0.0)).alias("consistency"))
    return steady.join(regular, "cand").select("cand", "fields", "consistency", "regularity", (F.col("consistency") * F.col("regularity")).alias("score"))


def infer_delimiters(df: DataFrame, field_name: str, candidates: Sequence[str] = CANDIDATES, placeholders: Sequence[str] = PLACEHOLDERS, threshold: float = 0.5) -> DelimiterModel:
    """The delimiters of the source df.field_name. Collects one row per candidate."""
    found = score_delimiters(df, field_name, candidates, placeholders).collect()
    scores = {r["cand"]: float(r["score"] or 0) for r in found}
    return DelimiterModel(tuple(c for c in candidates if scores.get(c, 0) >= threshold), scores)


def split_packed(df: DataFrame, field_name: str, key: str, model: DelimiterModel | None = None, placeholders: Sequence[str] = PLACEHOLDERS, least: int = 1) -> DataFrame:
    """(rec_id, pos, val): the values of every field that holds at least `least` of them, with their position from 0."""
    model = model or infer_delimiters(df, field_name, placeholders=placeholders)
    trimmed = df.select(F.col(key).alias("rec_id"), _trim(F.col(field_name)).alias("t"))
    values = trimmed.select("rec_id", split_values(F.col("t"), model, placeholders).alias("vals"))
    return values.where(F.size("vals") >= least).select("rec_id", F.posexplode("vals").alias("pos", "val"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
