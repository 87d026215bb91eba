"""What a fitted pipeline's predictions rest on: value grids and shuffled columns sent through its own `transform`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.operators.metrics import confusion_counts, weighted_scores
from flowspark.operators.ordering import hash_ranked
from flowspark.plans.models import predict


def _scored(model: Transformer, df: DataFrame) -> DataFrame:
    """Every row with its prediction; a pipeline passes over rows that lack a feature, they get null."""
    return predict(model, df) if isinstance(model, PipelineModel) and hasattr(model.stages[0], "getInputCols") else model.transform(df)


def _on_grid(df: DataFrame, feature: str, grid: Sequence[float]) -> DataFrame:
    values = F.array(*[F.lit(float(v)) for v in grid])
    return df.withColumn("_value", F.explode(values)).withColumn(feature, F.col("_value").cast(df.schema[feature].dataType))


def individual_expectation(model: Transformer, df: DataFrame, keys: Sequence[str], feature: str, grid: Sequence[float]) -> DataFrame:
    """(keys, value, prediction): each row's prediction with one feature set to each grid value.

    The rows are repeated in the plan, not stored: a task makes and scores them on the way.
    """
    scored = _scored(model, _on_grid(df, feature, grid))
    return scored.select(*keys, F.col("_value").alias("value"), "prediction")


def partial_dependence(model: Transformer, df: DataFrame, feature: str, grid: Sequence[float]) -> DataFrame:
    """(value, prediction, share): the predictions over all rows per grid value, reduced to counts in each task."""
    counts = individual_expectation(model, df, [], feature, grid).where("prediction is not null").groupBy("value", "prediction").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("value").agg(F.sum("n").alias("all"))
    return counts.join(F.broadcast(totals), "value").select("value", "prediction", (F.col("n") / F.col("all")).alias("share"))


def permutation_importance(model: Transformer, df: DataFrame, label: str, features: Sequence[str], keys: Sequence[str], seed: int = 42,
                           metric: str = "f1") -> DataFrame:
    """(feature, drop): fall of a weighted metric when one column is shuffled, for every feature.

    Two seeded orders of the rows are joined by position, so a row meets one other; then each row goes through the model
    once as it is and once per feature with the other row's value, and only counts are shuffled. Keys tell rows apart.
    """
    names = list(features)
    rows = hash_ranked(df, [], keys, seed, rank="_at")
    donors = hash_ranked(df.select(*dict.fromkeys([*keys, *names])), [], keys, seed + 1, rank="_at")
    donors = donors.select("_at", *[F.col(f).alias(f"_d{i}") for i, f in enumerate(names)])
    variants = rows.join(donors, "_at").withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(names)))))
    changed = variants.withColumns({f: F.when(F.col("_i") == i, F.col(f"_d{i}")).otherwise(F.col(f)) for i, f in enumerate(names)})
    scored = _scored(model, changed.drop(*[f"_d{i}" for i in range(len(names))])).where("prediction is not null")
    scores = weighted_scores(confusion_counts(scored, label, "prediction", ["_i"]), ["_i"])
    found = {r["_i"]: r[metric] for r in scores.collect()}  # a row per feature and one more
    base = found.get(len(names))
    fall = [(f, float(base - found[i])) for i, f in enumerate(names)] if base is not None else []
    return df.sparkSession.createDataFrame(fall, "feature string, drop double")
