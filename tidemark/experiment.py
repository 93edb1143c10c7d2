"""Train and evaluate a model on a split of a data set: python -m tidemark.experiment --dataset NAME --path PATH."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .models.factors import FactorConfig
from .models.linear import LinearConfig
from .models.recommender import KINDS, Recommender, Settings
from .operators import interactions as ops
from .operators import splits
from .session import get_session
from .sources.datasets import load

SPLITS = {"temporal": splits.temporal, "temporal_user": splits.temporal_by_user, "leave_one_last": splits.leave_last_out, "random": splits.random}


def run(df: DataFrame, kind: str = "linear", split: str = "temporal", epochs: int = 10, k: int = 10, neighbours: int | None = 50, half_life: float | None = None) -> dict:
    """The metrics of the test rows as a dictionary, with samples_per_second of training."""
    if split not in SPLITS:
        raise ValueError(f"unknown split: {split}")
    rows = df if "seq" in df.columns else ops.standard(df)
    train, test = SPLITS[split](rows)
    settings = Settings(kind, ops.StateConfig(decay_in_days=half_life), LinearConfig(neighbours=neighbours), FactorConfig(epochs=epochs))
    model = Recommender(df.sparkSession, settings)
    model.bulk_fit(train)
    found = model.evaluate(test, k).first()
    return {**(found.asDict() if found else {}), "samples_per_second": model.samples_per_second}


def main(spark: SparkSession | None = None, args: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--dataset", required=True)
    p.add_argument("--path", required=True)
    p.add_argument("--model", default="linear", choices=KINDS)
    p.add_argument("--split", default="temporal", choices=sorted(SPLITS))
    p.add_argument("--epochs", type=int, default=10)
    a = p.parse_args(args)
    spark = spark or get_session()
    out = run(load(spark, a.dataset, a.path), a.model, a.split, a.epochs)
    print(out)
    return out


if __name__ == "__main__":
    main()
