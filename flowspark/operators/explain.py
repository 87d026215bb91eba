"""What a model's output rests on: contributions, shuffled columns, value grids."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.operators.metrics import weighted_scores
from flowspark.operators.ordering import hash_ranked

Predictor = Callable[[np.ndarray], np.ndarray]  # rows x features to class positions


def linear_contributions(df: DataFrame, keys: Sequence[str], coefficients: Mapping[object, Mapping[str, float]],
                         means: Mapping[str, float]) -> DataFrame:
    """(keys, output, feature, value): coefficient times distance from the mean, per output."""
    cells = [F.struct(F.lit(output).alias("output"), F.lit(f).alias("feature"), (F.lit(float(w)) * (F.col(f) - F.lit(float(means[f])))).alias("value"))
             for output, weights in coefficients.items() for f, w in weights.items()]
    return df.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def normalized_contributions(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One value per row and feature: signed for a single output, mean magnitude over several."""
    outputs = long.select("output").distinct().count()
    value = F.first("value") if outputs == 1 else F.avg(F.abs("value"))
    return long.groupBy(*keys, "feature").agg(value.alias("value"))


def mean_contribution(long: DataFrame) -> DataFrame:
    """Mean magnitude per feature over rows and outputs."""
    return long.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance"))


def _labels(values: Sequence):
    return F.array(*[F.lit(v) for v in values])


def permutation_importance(df: DataFrame, label: str, features: Sequence[str], keys: Sequence[str], labels: Sequence,
                           predict: Predictor, seed: int = 42, metric: str = "f1") -> DataFrame:
    """Drop of a metric when one column is shuffled, for every feature.

    The shuffle pairs two seeded orders of the rows by position: one equality join serves
    all features, and each batch is scored once per feature.
    """
    names = list(features)
    places = {v: i for i, v in enumerate(labels)}
    rows = hash_ranked(df.select(*dict.fromkeys([*keys, label, *names])), [], keys, seed, rank="_at")
    donors = hash_ranked(df.select(*dict.fromkeys([*keys, *names])), [], keys, seed + 1, rank="_at")
    donors = donors.select("_at", *[F.col(f).alias(f"_d{i}") for i, f in enumerate(names)])
    both = rows.join(donors, "_at").select(label, *names, *[f"_d{i}" for i in range(len(names))])
    k = len(places)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((len(names) + 1, k * k), dtype=np.int64)
        for batch in batches:
            if batch.empty:
                continue
            y = batch[label].map(places).to_numpy(dtype=np.int64)
            x = batch[names].to_numpy(dtype=float)
            for i in range(len(names) + 1):
                changed = x
                if i < len(names):
                    changed = x.copy()
                    changed[:, i] = batch[f"_d{i}"].to_numpy(dtype=float)
                seen[i] += np.bincount(y * k + predict(changed), minlength=k * k)
        i, c = np.nonzero(seen)
        yield pd.DataFrame({"i": i, "yi": c // k, "pi": c % k, "n": seen[i, c]})

    cells = both.mapInPandas(count, "i int, yi int, pi int, n long").groupBy("i", "yi", "pi").agg(F.sum("n").alias("n"))
    scores = weighted_scores(cells.select("i", F.col("yi").alias("y"), F.col("pi").alias("yhat"), "n"), ["i"])
    base = scores.filter(F.col("i") == len(names)).select(F.col(metric).alias("base"))
    changed = scores.filter(F.col("i") < len(names)).withColumn("_1", F.lit(1))
    joined = changed.join(base.withColumn("_1", F.lit(1)), "_1")
    return joined.select(F.get(_labels(names), "i").alias("feature"), (F.col("base") - F.col(metric)).alias("drop"))


def individual_expectation(df: DataFrame, keys: Sequence[str], features: Sequence[str], feature: str, grid: Sequence[float],
                           labels: Sequence, predict: Predictor) -> DataFrame:
    """(keys, value, prediction): each row's prediction with one feature set to each grid value."""
    names, at = list(features), list(features).index(feature)
    types = dict(df.dtypes)

    def vary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            x = batch[names].to_numpy(dtype=float)
            for g in grid:
                x[:, at] = g
                yield batch[list(keys)].assign(value=float(g), pi=predict(x).astype("int32"))

    schema = ", ".join([*[f"{c} {types[c]}" for c in keys], "value double", "pi int"])
    rows = df.select(*dict.fromkeys([*keys, *names])).mapInPandas(vary, schema)
    return rows.select(*keys, "value", F.get(_labels(labels), "pi").alias("prediction"))


def partial_dependence(df: DataFrame, features: Sequence[str], feature: str, grid: Sequence[float], labels: Sequence,
                       predict: Predictor) -> DataFrame:
    """(value, prediction, share): mean prediction over all rows per grid value.

    Tasks return counts per grid value and class, so rows times grid is never built.
    """
    names, at, k = list(features), list(features).index(feature), len(labels)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((len(grid), k), dtype=np.int64)
        for batch in batches:
            if batch.empty:
                continue
            x = batch[names].to_numpy(dtype=float)
            for g, value in enumerate(grid):
                x[:, at] = value
                seen[g] += np.bincount(predict(x), minlength=k)
        g, c = np.nonzero(seen)
        yield pd.DataFrame({"g": g, "pi": c, "n": seen[g, c]})

    cells = df.select(*names).mapInPandas(count, "g int, pi int, n long").groupBy("g", "pi").agg(F.sum("n").alias("n"))
    totals = cells.groupBy("g").agg(F.sum("n").alias("all"))
    return cells.join(totals, "g").select(F.get(F.array(*[F.lit(float(v)) for v in grid]), "g").alias("value"),
                                          F.get(_labels(labels), "pi").alias("prediction"), (F.col("n") / F.col("all")).alias("share"))
