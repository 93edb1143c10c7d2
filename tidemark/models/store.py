"""Models as Parquet tables with a manifest: no pickles, so loading runs no foreign code."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def save(path: str, tables: dict[str, DataFrame], settings: dict) -> int:
    """Write the tables and then the manifest; a folder without a manifest isn't a model. Returns the manifest's bytes."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    text = json.dumps({"tables": sorted(tables), "settings": settings}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return len(text.encode())


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    manifest = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/manifest").collect()))
    return {n: spark.read.parquet(f"{path}/{n}") for n in manifest["tables"]}, manifest["settings"]
