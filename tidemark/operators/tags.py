"""Tags of users and items: vocabularies, multi-hot rows and identity features.

A tag table is (entity, tags ARRAY<STRING>); a vocabulary is (tag, tag_id) in the order of first use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ids import numbered


def put(stored: DataFrame, new: DataFrame, append: bool = False) -> DataFrame:
    """New tags replace an entity's stored ones, or are added to them; each tag once, in order."""
    a, b = stored.select("entity", F.col("tags").alias("old")), new.select("entity", F.col("tags").alias("new"))
    empty = F.array().cast("array<string>")
    both = a.join(b, "entity", "full")
    kept = F.concat(F.coalesce("old", empty), F.coalesce("new", empty)) if append else F.coalesce("new", "old")
    return both.select("entity", F.array_distinct(kept).alias("tags"))


def clear(stored: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Without the tags of the given entities, or of all; the vocabulary isn't touched."""
    return stored.where("false") if entities is None else stored.join(entities.select("entity").distinct(), "entity", "left_anti")


def vocabulary(stored: DataFrame) -> DataFrame:
    """(tag, tag_id): by first use in the order of entity and place."""
    each = stored.select("entity", F.posexplode("tags").alias("pos", "tag")).where(F.col("tag").isNotNull())
    first = each.groupBy("tag").agg(F.min(F.struct("entity", "pos")).alias("first"))
    return numbered(first, ["first", "tag"], "tag_id").select("tag", "tag_id")


def n_features(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.count(F.lit(1)).alias("n"))


def multi_hot(stored: DataFrame, vocab: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """(entity, tag_id, weight): tags outside the vocabulary are skipped, repeated ones add up; explicit tags win."""
    if explicit is not None:
        stored = put(stored, explicit)
    each = stored.select("entity", F.explode("tags").alias("tag"))
    return each.join(vocab, "tag").groupBy("entity", "tag_id").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def entity_features(entities: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(entity, feature, weight): 'id:entity' of every entity and 'tag:t' of each of its tags."""
    own = entities.select("entity", F.concat(F.lit("id:"), F.col("entity").cast("string")).alias("feature"), F.lit(1.0).alias("weight"))
    if stored is None:
        return own
    tags = stored.join(entities.select("entity"), "entity", "left_semi").select("entity", F.explode(F.array_distinct("tags")).alias("t"))
    return own.unionByName(tags.select("entity", F.concat(F.lit("tag:"), F.col("t")).alias("feature"), F.lit(1.0).alias("weight")))


def cold_features(stored: DataFrame, learned: DataFrame) -> DataFrame:
    """(entity, feature, weight) of tags alone, those of learned(feature) only."""
    tags = stored.select("entity", F.explode(F.array_distinct("tags")).alias("t")).select("entity", F.concat(F.lit("tag:"), F.col("t")).alias("feature"), F.lit(1.0).alias("weight"))
    return tags.join(learned.select("feature"), "feature", "left_semi").select("entity", "feature", "weight")
