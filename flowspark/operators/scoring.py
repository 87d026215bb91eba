"""Nearest-centroid and naive-Bayes scoring from class statistics.

The statistics are one row per (fold, class): a few sums per feature. Rows are scored where
they lie, in Arrow batches, for many feature subsets at once; only counts leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.operators.metrics import error_rates, weighted_scores
from flowspark.operators.ordering import exact_quantiles

BATCH_ROWS = 2048  # rows scored at a time inside a task
PENALTY = {"accuracy": 0.0, "precision": 0.0, "recall": 0.0, "f1": 0.0, "fpr": 1.0, "fnr": 1.0}  # fixed values: rejected subset


def spread_vector(df: DataFrame, vector: str, size: int, prefix: str = "v") -> DataFrame:
    """An array column as one double column per position."""
    others = [c for c in df.columns if c != vector]
    return df.select(*others, *[F.get(vector, F.lit(i)).cast("double").alias(f"{prefix}{i}") for i in range(size)])


@dataclass(frozen=True)
class Centroids:
    """One centre per class; labels sorted, so that ties go to the smaller label."""

    labels: list
    centers: np.ndarray
    metric: str = "euclidean"

    def index(self, x: np.ndarray) -> np.ndarray:
        """Position of the nearest centre for each row."""
        out = np.empty(len(x), dtype=np.int64)
        for at in range(0, len(x), BATCH_ROWS):
            gap = x[at:at + BATCH_ROWS, None, :] - self.centers[None, :, :]
            far = np.abs(gap).sum(axis=2) if self.metric == "manhattan" else (gap ** 2).sum(axis=2)
            out[at:at + BATCH_ROWS] = far.argmin(axis=1)
        return out


def fit_centroids(df: DataFrame, label: str, features: Sequence[str], metric: str = "euclidean",
                  shrink: float | None = None) -> Centroids:
    """Class means (medians for manhattan), optionally shrunk toward the overall mean."""
    if metric == "manhattan":
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).cast("double").alias("value"))
                                    for i, f in enumerate(features)])).alias("e")
        middle = exact_quantiles(df.select(label, cells).select(label, "e.i", "e.value"), [label, "i"], "value", [0.5]).collect()
        labels = sorted({r[label] for r in middle})
        centers = np.zeros((len(labels), len(features)))
        for r in middle:
            centers[labels.index(r[label]), r["i"]] = r["q"]
        return Centroids(labels, centers, metric)
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)],
                                 *[F.var_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).collect()
    rows = sorted((r for r in rows if r[label] is not None), key=lambda r: r[label])
    labels = [r[label] for r in rows]
    pick = lambda p: np.array([[r[f"{p}{i}"] for i in range(len(features))] for r in rows], dtype=float)
    centers, counts = pick("m"), np.array([r["n"] for r in rows], dtype=float)
    if shrink:
        n, k = counts.sum(), len(labels)
        overall = (centers * counts[:, None]).sum(axis=0) / n
        within = np.sqrt((pick("s") * counts[:, None]).sum(axis=0) / (n - k))
        within = within + np.median(within)
        unit = np.sqrt(1.0 / counts - 1.0 / n)[:, None] * within[None, :]
        moved = (centers - overall) / unit
        centers = overall + unit * np.sign(moved) * np.clip(np.abs(moved) - shrink, 0, None)
    return Centroids(labels, centers, metric)


def predict_centroid(df: DataFrame, model: Centroids, features: Sequence[str], out: str = "prediction") -> DataFrame:
    """Add the nearest class. The centres travel with the task: classes x features numbers."""

    @F.pandas_udf("int")
    def nearest(x: pd.Series) -> pd.Series:
        return pd.Series(model.index(np.stack(x.to_numpy()).astype(float)) if len(x) else np.array([], dtype=int))

    names = F.array(*[F.lit(v) for v in model.labels])
    vector = F.array(*[F.col(f).cast("double") for f in features])
    return df.withColumn(out, F.get(names, nearest(vector)))


@dataclass(frozen=True)
class FoldStatistics:
    """Counts, sums and squared sums per (fold, class, feature)."""

    folds: list[int]
    labels: list
    counts: np.ndarray  # folds x classes
    sums: np.ndarray  # folds x classes x features
    squares: np.ndarray

    def held_out(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per fold: class counts, means and variances of all other folds."""
        n = self.counts.sum(axis=0)[None] - self.counts
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = (self.sums.sum(axis=0)[None] - self.sums) / n[:, :, None]
            var = (self.squares.sum(axis=0)[None] - self.squares) / n[:, :, None] - mean ** 2
        return n, mean, var


def fold_statistics(df: DataFrame, fold: str, label: str, features: Sequence[str]) -> FoldStatistics:
    """One aggregate over the table; folds x classes rows come back. Rows without a label or fold are passed over."""
    rows = df.where(F.col(fold).isNotNull() & F.col(label).isNotNull()).groupBy(fold, label).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f).cast("double")).alias(f"s{i}") for i, f in enumerate(features)],
        *[F.sum(F.col(f).cast("double") * F.col(f)).alias(f"q{i}") for i, f in enumerate(features)]).collect()
    folds, labels = sorted({r[fold] for r in rows}), sorted({r[label] for r in rows})
    shape = (len(folds), len(labels), len(features))
    counts, sums, squares = np.zeros(shape[:2]), np.zeros(shape), np.zeros(shape)
    for r in rows:
        at = folds.index(r[fold]), labels.index(r[label])
        counts[at] = r["n"]
        sums[at] = [r[f"s{i}"] for i in range(len(features))]
        squares[at] = [r[f"q{i}"] for i in range(len(features))]
    return FoldStatistics(folds, labels, counts, sums, squares)


def _per_feature_cost(scorer: str, stats: FoldStatistics) -> Callable[[int, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(fold, rows) to cost per row, class and feature, and cost per class; lower is better."""
    n, mean, var = stats.held_out()
    if scorer == "centroid":
        prior = np.where(n > 0, 0.0, np.inf)
        mean = np.nan_to_num(mean)
        return lambda f, x: ((x[:, None, :] - mean[f][None]) ** 2, prior[f])
    if scorer == "naive_bayes":
        floor = 1e-9 * np.nanmax(np.maximum(var, 0), initial=1.0)
        var = np.nan_to_num(np.maximum(var, 0)) + floor
        mean = np.nan_to_num(mean)
        with np.errstate(divide="ignore"):
            prior = -np.log(n / n.sum(axis=1, keepdims=True))
        return lambda f, x: (0.5 * (np.log(2 * np.pi * var[f])[None] + (x[:, None, :] - mean[f][None]) ** 2 / var[f][None]), prior[f])
    raise ValueError(f"unknown scorer {scorer!r}")


def mask_counts(df: DataFrame, fold: str, label: str, features: Sequence[str], masks: Sequence[Sequence[int]],
                scorer: str = "centroid", stats: FoldStatistics | None = None) -> DataFrame:
    """Confusion counts (mask, fold, y, yhat, n) of every feature subset, from two passes in all, or one
    when the class statistics are given.

    Costs add up over features, so one matrix product scores all subsets of a batch. A task
    keeps one small count array, whatever the number of rows. Rows without a label or fold are passed over.
    """
    df = df.where(F.col(fold).isNotNull() & F.col(label).isNotNull())
    stats = stats or fold_statistics(df, fold, label, features)
    cost = _per_feature_cost(scorer, stats)
    chosen = np.array(masks, dtype=float)
    places = {v: i for i, v in enumerate(stats.labels)}
    folds = {v: i for i, v in enumerate(stats.folds)}
    k, p, names = len(places), len(chosen), list(features)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((len(folds), p, k * k), dtype=np.int64)
        for batch in batches:
            for value, part in batch.groupby(fold):
                f, y = folds[value], part[label].map(places).to_numpy(dtype=np.int64)
                x = part[names].to_numpy(dtype=float)
                for at in range(0, len(x), BATCH_ROWS):
                    each, fixed = cost(f, x[at:at + BATCH_ROWS])
                    best = (each @ chosen.T + fixed[None, :, None]).argmin(axis=1)
                    pair = y[at:at + BATCH_ROWS, None] * k + best
                    for m in range(p):
                        seen[f, m] += np.bincount(pair[:, m], minlength=k * k)
        f, m, c = np.nonzero(seen)
        yield pd.DataFrame({"mask": m, "f": f, "yi": c // k, "pi": c % k, "n": seen[f, m, c]})

    counts = (df.select(fold, label, *names).mapInPandas(count, "mask int, f int, yi int, pi int, n long")
              .groupBy("mask", "f", "yi", "pi").agg(F.sum("n").alias("n")))
    literal = lambda values: F.array(*[F.lit(v) for v in values])
    return counts.select("mask", F.get(literal(stats.folds), "f").alias("fold"), F.get(literal(stats.labels), "yi").alias("y"),
                         F.get(literal(stats.labels), "pi").alias("yhat"), "n")


def fold_scores(counts: DataFrame, by: Sequence[str] = ("mask", "fold")) -> DataFrame:
    """Six metrics per subset and fold."""
    return weighted_scores(counts, by).join(error_rates(counts, "binary_or_weighted", by), list(by))


def score_masks(df: DataFrame, fold: str, label: str, features: Sequence[str], masks: Sequence[Sequence[int]],
                scorer: str = "centroid", early_folds: int = 3, early_accuracy: float = 0.75, stats: FoldStatistics | None = None) -> DataFrame:
    """Fitness of feature subsets: mean fold metrics and the number of features.

    An empty subset, or one whose first folds fall below the accuracy bound, gets the worst
    scores. Equal subsets are scored once.
    """
    spark = df.sparkSession
    distinct = list(dict.fromkeys(tuple(int(bool(b)) for b in m) for m in masks))
    live = [m for m in distinct if any(m)]
    names = list(PENALTY)
    rows = [(i, live.index(m) if m in live else None, sum(m)) for i, m in
            enumerate(tuple(int(bool(b)) for b in mask) for mask in masks)]
    wanted = spark.createDataFrame(rows, "id int, mask int, n_features int")
    if not live:
        return wanted.select("id", *[F.lit(v).alias(c) for c, v in PENALTY.items()], "n_features")
    folds = fold_scores(mask_counts(df, fold, label, features, live, scorer, stats))
    weak = (F.col("fold") < early_folds) & (F.col("accuracy") < early_accuracy)
    means = folds.groupBy("mask").agg(F.max(weak).alias("_weak"), *[F.avg(c).alias(c) for c in names])
    means = means.select("mask", *[F.when(F.col("_weak"), F.lit(PENALTY[c])).otherwise(F.col(c)).alias(c) for c in names])
    return wanted.join(means, "mask", "left").select("id", *[F.coalesce(c, F.lit(PENALTY[c])).alias(c) for c in names], "n_features")


def cross_validate(df: DataFrame, fold: str, label: str, features: Sequence[str], scorer: str = "centroid") -> DataFrame:
    """Metrics per fold of one scorer on all features."""
    counts = mask_counts(df, fold, label, features, [[1] * len(features)], scorer)
    return fold_scores(counts, ["fold"])


def as_vector(features: Sequence[str]) -> Column:
    """Feature columns as one array of doubles."""
    return F.array(*[F.col(f).cast("double") for f in features])
