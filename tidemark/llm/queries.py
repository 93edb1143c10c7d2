"""Queries of problems 2, 5, 8, 9 and 10, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import infer_delimiters, split_packed
from ..session import materialize
from ..sources.tables import table
from .cooccurrence import cooccurring
from .encoding import find_garbled
from .frequency import mark, term_frequencies
from .mixing import corpus_cells, mix
from .packing import pack, pack_report

MIN_BASKETS, MIN_LIFT = 6, 15
RARE_BELOW, COMMON_KEY, COMMON_GENRE = 3, 0.02, 0.12


def _day():
    return F.floor(F.col("tstamp") / 86400)


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of items that meets in any basket, with its lift and surprise."""
    return cooccurring(table(spark, folder, "interactions"), [F.col("user"), _day()], "item", 1)


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Of p2_pairs those that meet in at least six baskets, as its SQL has them."""
    return p2_pairs(spark, folder).where(F.col("n_ab") >= MIN_BASKETS).select("item_a", "item_b", "n_ab", "n_a", "n_b", "n_baskets", F.round("lift", 6).alias("lift"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The whole method, asked for six baskets and fifteen times the chance; as its SQL has it, surprise decides nothing."""
    found = cooccurring(table(spark, folder, "interactions"), [F.col("user"), _day()], "item", MIN_BASKETS, MIN_LIFT)
    return found.select("item_a", "item_b")


def p5_terms(spark: SparkSession, folder: str) -> DataFrame:
    """(field, val, occurrences, records, mark) of every item, user and genre."""
    rows = table(spark, folder, "interactions").select("item", "user", "tstamp", "rating")
    parts = []
    for field, other in (("item", "user"), ("user", "item")):
        freq = term_frequencies(rows, field, [other, "tstamp", "rating"])
        parts.append((field, freq, COMMON_KEY))
    movies = table(spark, folder, "movies").select("item", "genres")
    genres = split_packed(movies, "genres", "item", infer_delimiters(movies, "genres")).select(F.lower("val").alias("val"), F.col("rec_id").alias("item"))
    genres = genres.where(~F.col("val").isin("-", "n/a", "(none)"))
    out = []
    for field, freq, share in parts:
        # distinct records of all terms, the null term among them, are all distinct records
        freq = materialize(freq, "frequencies")
        limit = share * (freq.agg(F.sum("records")).first()[0] or 0)
        out.append(freq.where("term is not null").select(F.lit(field).alias("field"), F.col("term").cast("string").alias("val"), "occurrences", "records", mark(F.col("records"), RARE_BELOW, F.lit(limit)).alias("mark")))
    n = movies.count()
    freq = term_frequencies(genres, "val", ["item"])
    out.append(freq.select(F.lit("genre").alias("field"), F.col("term").alias("val"), "occurrences", "records", mark(F.col("records"), RARE_BELOW, F.lit(COMMON_GENRE * n)).alias("mark")))
    return out[0].unionByName(out[1]).unionByName(out[2])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_terms(spark, folder).where("mark is not null").select("field", "val", "mark")


def p5_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The items and users of p5_terms, which SQL can count too."""
    return p5_terms(spark, folder).where("field <> 'genre'")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every part of every text with its container."""
    return pack(table(spark, folder, "documents"), "doc_id", "text")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return pack_report(pack(table(spark, folder, "documents"), "doc_id", "text"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), "doc_id", "text").where("part = 1").select("doc_id")


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The topic of a document is the first genre of its movie."""
    movies = table(spark, folder, "movies").select("item", "genres")
    topics = split_packed(movies, "genres", "item", infer_delimiters(movies, "genres")).where("pos = 0").select(F.col("rec_id").alias("item"), F.lower("val").alias("topic"))
    corpus = corpus_cells(table(spark, folder, "documents"), "doc_id", "text", "source", "lang", "item", topics)
    return mix(corpus, table(spark, folder, "mix_targets"), "doc_id")


def p9_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The selected documents and how often each is used."""
    return _mixed(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that the sources reach."""
    return _mixed(spark, folder)[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1].where("not reachable").select("source")


def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The garbled documents, with the original text where it can be restored."""
    return find_garbled(table(spark, folder, "documents"), "doc_id", "text").where("garbled").select("doc_id", F.round("gain", 3).alias("gain"), "restored")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_garbled(table(spark, folder, "documents"), "doc_id", "text").where("garbled").select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_counts, p2_pairs, p5_found, p5_terms, p5_keys, p8_found, p8_containers, p8_report, p9_found, p9_selection, p9_shares, p10_found, p10_restored)
}

_PAIRS = """
with d as (select distinct "user" as u, floor(tstamp / 86400) as day, item from interactions where "user" is not null and item is not null and tstamp is not null),
n as (select count(*) as n from (select distinct u, day from d)),
f as (select item, count(*) as f from d group by item),
p as (select a.item as item_a, b.item as item_b, count(*) as n_ab from d a join d b on a.u = b.u and a.day = b.day and a.item < b.item group by 1, 2 having count(*) >= 6),
x as (select p.*, fa.f as n_a, fb.f as n_b, n.n as n_baskets from p join f fa on fa.item = item_a join f fb on fb.item = item_b cross join n)
"""

_KEYS = """
with r as (select distinct "user", item, tstamp, rating from interactions), total as (select count(*) as n from r),
k as (
  select 'item' as field, item::varchar as val, (select count(*) from interactions i where i.item = r.item) as occurrences, count(*) as records from r where item is not null group by item
  union all
  select 'user', "user"::varchar, (select count(*) from interactions i where i."user" = r."user"), count(*) from r where "user" is not null group by "user"
)
select field, val, occurrences, records, case when records < 3 then 'rare' when records > 0.02 * (select n from total) then 'common' end as mark from k
"""

ORACLE = {
    "p2_found": _PAIRS + "select item_a, item_b from x where n_ab::hugeint * n_baskets >= 15::hugeint * n_a * n_b",
    "p2_counts": _PAIRS + "select item_a, item_b, n_ab, n_a, n_b, n_baskets, round(n_ab * n_baskets::double / (n_a::double * n_b), 6) as lift from x",
    "p5_keys": _KEYS,
}
