"""Public interaction data sets from local files, in the columns user, item, tstamp (seconds), rating and extras."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.asof import asof_attributes

#: Genre columns of the smallest film set.
FILM_GENRES = (
    "unknown", "Action", "Adventure", "Animation", "Children", "Comedy", "Crime", "Documentary", "Drama", "Fantasy", "Film-Noir", "Horror", "Musical", "Mystery",
    "Romance", "Sci-Fi", "Thriller", "War", "Western",
)
#: Product categories and the names of their files.
PRODUCT_CATEGORIES = {
    "Fashion": "AMAZON_FASHION", "Beauty": "All_Beauty", "Appliances": "Appliances", "Arts": "Arts_Crafts_and_Sewing", "Automotive": "Automotive", "Books": "Books",
    "CDs": "CDs_and_Vinyl", "Phones": "Cell_Phones_and_Accessories", "Clothing": "Clothing_Shoes_and_Jewelry", "Music": "Digital_Music", "Electronics": "Electronics",
    "GiftCards": "Gift_Cards", "Groceries": "Grocery_and_Gourmet_Food", "HomeKitchen": "Home_and_Kitchen", "IndustrialScientific": "Industrial_and_Scientific",
    "Kindle": "Kindle_Store", "LuxuryBeauty": "Luxury_Beauty", "Magazines": "Magazine_Subscriptions", "Movies": "Movies_and_TV", "MusicalInstruments": "Musical_Instruments",
    "Office": "Office_Products", "PatioGarden": "Patio_Lawn_and_Garden", "Pets": "Pet_Supplies", "PrimePantry": "Prime_Pantry", "Software": "Software",
    "Sports": "Sports_and_Outdoors", "Tools": "Tools_and_Home_Improvement", "Toys": "Toys_and_Games", "VideoGames": "Video_Games",
}


@dataclass(frozen=True)
class FilmFiles:
    """File names, separators and columns of one scale of the film data."""

    ratings: str
    users: str
    items: str
    sep: str
    header: bool
    encoding: str
    attribute_sep: str | None = None
    user_columns: str = "user long, gender string, age int, occupation string, zip_code string"
    item_columns: str = "item long, title string, genres string"


FILM_SCALES = {
    "100k": FilmFiles("u.data", "u.user", "u.item", "\t", False, "ISO-8859-1", "|", "user long, age int, gender string, occupation string, zip_code string",
                      "item long, title string, release_date string, video_release_date string, url string, " + ", ".join(f"`{g}` int" for g in FILM_GENRES)),
    "1m": FilmFiles("ratings.dat", "users.dat", "movies.dat", "::", False, "ISO-8859-1"),
    "10m": FilmFiles("ratings.dat", "users.dat", "movies.dat", "::", False, "UTF-8"),
    "20m": FilmFiles("ratings.csv", "users.csv", "movies.csv", ",", True, "UTF-8"),
    "25m": FilmFiles("ratings.csv", "users.csv", "movies.csv", ",", True, "UTF-8"),
}


def _must_exist(path: str) -> str:
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(f"{path}: download the data first, this library reads local files")
    return path


def films(spark: SparkSession, folder: str, scale: str, by_time: bool = False, users: bool = False, items: bool = False) -> DataFrame:
    """Film ratings of one scale, with user and item attributes on demand."""
    if scale not in FILM_SCALES:
        raise ValueError(f"unknown scale {scale!r}: one of {', '.join(FILM_SCALES)}")
    f = FILM_SCALES[scale]

    def read(name: str, schema: str, sep: str) -> DataFrame:
        return spark.read.schema(schema).csv(_must_exist(f"{folder}/{name}"), sep=sep, header=f.header, encoding=f.encoding)

    out = read(f.ratings, "user long, item long, rating double, tstamp double", f.sep)
    other = f.attribute_sep or f.sep
    if users:
        out = out.join(read(f.users, f.user_columns, other), "user", "left")
    if items:
        of = read(f.items, f.item_columns, other)
        if scale == "100k":
            of = of.withColumn("genres", S.one_hot_names(FILM_GENRES))
        out = out.join(of.select("item", "title", "genres"), "item", "left")
    return out.orderBy("tstamp") if by_time else out


def businesses(spark: SparkSession, path: str, by_time: bool = False) -> DataFrame:
    """Business reviews from JSON lines with user_id, business_id, stars and date."""
    raw = spark.read.schema("user_id string, business_id string, stars double, date string").json(_must_exist(path))
    out = raw.select(F.col("user_id").alias("user"), F.col("business_id").alias("item"), S.date_seconds(F.substring("date", 1, 10)).alias("tstamp"), F.col("stars").alias("rating"))
    return out.orderBy("tstamp") if by_time else out


def products(spark: SparkSession, folder: str, category: str = "Music", small: bool = True, images: bool = False, by_time: bool = False) -> DataFrame:
    """Product reviews from gzipped JSON lines, of one category or of 'all' that are there."""
    names = list(PRODUCT_CATEGORIES) if category == "all" else [category]
    parts = []
    for name in names:
        if name not in PRODUCT_CATEGORIES:
            print(f"unknown category {name!r} skipped")
            continue
        path = f"{folder}/{PRODUCT_CATEGORIES[name]}{'_5' if small else ''}.json.gz"
        if category == "all" and not os.path.exists(path):
            print(f"{path} isn't there, skipped")
            continue
        raw = spark.read.schema("reviewerID string, asin string, overall double, unixReviewTime double, image array<string>").json(_must_exist(path))
        image = S.first_or(F.col("image"), F.concat(F.lit("http://images.amazon.com/images/P/"), "asin", F.lit(".01._SCTZZZZZZZ_.jpg")))
        cols = [F.col("reviewerID").alias("user"), F.col("asin").alias("item"), F.col("overall").alias("rating"), F.col("unixReviewTime").alias("tstamp")]
        parts.append(raw.select(*cols, *([image.alias("image_url")] if images else []), *([F.lit(name).alias("category")] if category == "all" else [])))
    if not parts:
        raise FileNotFoundError(f"no category of {names} in {folder}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("tstamp") if by_time else out


def plays(spark: SparkSession, path: str) -> DataFrame:
    """Plays of artists by user: user, artist_id, artist_name, plays. Not in the standard columns."""
    return spark.read.schema("user string, artist_id string, artist_name string, plays long").csv(_must_exist(path), sep="\t", quote="")


def shop(spark: SparkSession, folder: str, standard: bool = True) -> DataFrame:
    """Shop events with the item's property as of the event, its category's parent, tags and parts of time."""
    read = lambda name, schema: spark.read.schema(schema).csv(_must_exist(f"{folder}/{name}"), header=True)
    events = read("events.csv", "timestamp long, visitorid long, event string, itemid long, transactionid long")
    props = read("item_properties_part1.csv", "timestamp long, itemid long, property string, value string").unionByName(read("item_properties_part2.csv", "timestamp long, itemid long, property string, value string"))
    return shop_events(events, props, read("category_tree.csv", "categoryid string, parentid string"), standard)


def shop_events(events: DataFrame, props: DataFrame, categories: DataFrame, standard: bool = True) -> DataFrame:
    """The last property row of the item before each event, whichever property it is, and what follows from it.

    Of several rows at one instant the one with the greatest seq counts, where props has a seq.
    """
    tie = F.col("seq") if "seq" in props.columns else F.xxhash64("property", "value")
    latest = props.select("itemid", "timestamp", F.lit("any").alias("kind"), F.struct("property", "value").alias("pv"), tie.alias("tie"))
    joined = asof_attributes(events, latest, "itemid", "timestamp", "timestamp", "tie", "kind", "pv", ["any"])
    at = F.timestamp_millis("timestamp")
    out = joined.select(
        *events.columns, F.col("any.property").alias("property"), F.when(F.col("any.property") == "available", F.col("any.value")).alias("available"),
        F.when(F.col("any.property") == "categoryid", F.col("any.value")).alias("categoryid"), S.property_tags(F.col("any.property"), F.col("any.value")).alias("tags"),
        at.alias("date_time"), S.day_of_week(at).alias("day_of_week"), F.hour(at).alias("hour"), S.hour_period(F.hour(at)).alias("time_of_day"),
    )
    out = out.join(categories, "categoryid", "left")
    if not standard:
        return out
    return out.withColumnsRenamed({"visitorid": "user", "itemid": "item"}).withColumn("tstamp", F.col("timestamp") / 1000.0).drop("timestamp").withColumn("rating", S.event_rating(F.col("event")))


def fashion(spark: SparkSession, path: str, standard: bool = True) -> DataFrame:
    """Fashion transactions; customers by the 63-bit number of their hex id, one point each."""
    raw = spark.read.schema("t_dat date, customer_id string, article_id int, price float, sales_channel_id byte").csv(_must_exist(path), header=True)
    out = raw.withColumn("customer_id", S.hex_to_id(F.col("customer_id")))
    if not standard:
        return out
    return out.select(F.col("customer_id").alias("user"), F.col("article_id").alias("item"), F.unix_timestamp(F.col("t_dat").cast("timestamp")).cast("double").alias("tstamp"), F.lit(1.0).alias("rating"))


def fashion_user_tags(customers: DataFrame) -> DataFrame:
    """(entity, tags) of customers with customer_id, FN, Active, club_member_status, fashion_news_frequency, age, postal_code."""
    age = F.when(F.col("age").isNull(), F.lit("unknown")).otherwise(S.age_bin(F.col("age")))
    tags = [S.tag("FN", F.col("FN"), "0"), S.tag("Active", F.col("Active"), "0"), S.tag("club_member", F.col("club_member_status")), S.tag("news_freq", F.col("fashion_news_frequency")), S.tag("age", age), S.tag("postal_code", F.col("postal_code"))]
    return customers.select(S.hex_to_id(F.col("customer_id")).alias("entity"), F.array(*tags).alias("tags"))


#: Tag name and column of fashion articles; those marked True only on demand.
ARTICLE_TAGS = (
    ("product_code", "product_code", False), ("product_type", "product_type_no", False), ("product_group", "product_group_name", False), ("product_name", "prod_name", True),
    ("product_type_name", "product_type_name", True), ("graphical_appearance", "graphical_appearance_no", False), ("colour_group", "colour_group_code", False),
    ("perceived_colour_value", "perceived_colour_value_id", False), ("perceived_colour_master", "perceived_colour_master_id", False),
    ("graphical_appearance_name", "graphical_appearance_name", True), ("colour_group_name", "colour_group_name", True),
    ("perceived_colour_value_name", "perceived_colour_value_name", True), ("perceived_colour_master_name", "perceived_colour_master_name", True),
    ("department", "department_no", False), ("department_name", "department_name", True), ("index", "index_code", False), ("index_group", "index_group_no", False),
    ("index_name", "index_name", True), ("index_group_name", "index_group_name", True), ("section", "section_no", False), ("section_name", "section_name", True),
    ("garment_group", "garment_group_no", False), ("garment_group_name", "garment_group_name", True), ("detail_desc", "detail_desc", True),
)


def fashion_item_tags(articles: DataFrame, texts: bool = False) -> DataFrame:
    """(entity, tags) of articles."""
    tags = [S.tag(name, F.col(column)) for name, column, text in ARTICLE_TAGS if texts or not text]
    return articles.select(F.col("article_id").alias("entity"), F.array(*tags).alias("tags"))


#: name -> loader(spark, local path)
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"movielens_{scale}": (lambda s, p, scale=scale: films(s, p, scale)) for scale in FILM_SCALES},
    "yelp": businesses,
    "amazon_music": lambda s, p: products(s, p, "Music"),
    "amazon_electronics": lambda s, p: products(s, p, "Electronics"),
    "lastfm_360k": plays,
    "retailrocket": shop,
    "hm": fashion,
}


def load(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in REGISTRY:
        raise ValueError(f"unknown data set {name!r}: one of {', '.join(REGISTRY)}")
    return REGISTRY[name](spark, path)


def batches(df: DataFrame, size: int = 1000):
    """Rows as lists of tuples, for replay; streamed, never all at once."""
    held = []
    for row in df.toLocalIterator():
        held.append(tuple(row))
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def from_iterable(spark: SparkSession, rows) -> DataFrame:
    """(user, item, tstamp, rating) tuples in order of arrival."""
    listed = [(*r[:2], float(r[2]), float(r[3]), n) for n, r in enumerate(rows)]
    kind = "string" if listed and isinstance(listed[0][0], str) else "long"
    item = "string" if listed and isinstance(listed[0][1], str) else "long"
    return spark.createDataFrame(listed, f"user {kind}, item {item}, tstamp double, rating double, seq long")
