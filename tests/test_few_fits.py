"""Vector tables dealt evenly, medians by ranges, and equal estimators of a grid fitted once."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from flowspark.plans import estimators, models, tuning


@pytest.mark.parametrize("odd", [None, float("nan"), float("inf")])
def test_medians_equal_numpy(spark, odd):
    draw = np.random.default_rng(3)
    x = np.stack([draw.normal(size=501), np.full(501, 7.0), draw.integers(0, 3, 501), np.exp(9 * draw.normal(size=501)), draw.choice([-1.7e308, 1.7e308], 501)], axis=1)
    y = draw.integers(0, 3, 501).astype(float)
    y[0] = 9.0  # a class of one row
    if odd is not None:
        x[5, 0] = odd
    rows = spark.createDataFrame([(float(a), Vectors.dense(b)) for a, b in zip(y, x)], ["y", "x"])
    got = {(r["y"], r["i"]): r["q"] for r in estimators.medians(rows).collect()}
    assert len(got) == 4 * 5
    for (c, i), q in got.items():
        v = np.sort(x[y == c][:, i])
        assert i == 4 and abs(q) >= 1.7e308 or q == v[(len(v) - 1) // 2] + (0.5 if len(v) % 2 == 0 else 0.0) * (v[len(v) // 2] - v[(len(v) - 1) // 2])


def test_medians_shuffle_few_cells(spark, monkeypatch):
    def never(*args, **kwargs):
        raise AssertionError("all cells are ranked")

    monkeypatch.setattr(estimators, "exact_quantiles", never)
    rows = spark.range(1000).select((F.col("id") % 2).cast("double").alias("y"), F.col("id").cast("double").alias("v"))
    fitted = models.nearest_centroid("manhattan").fit(models.vector_table(rows, "y", ["v"]))
    assert fitted.getOrDefault(fitted.centers) == [[499.0], [500.0]]


def test_vector_tables_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(models, "ROWS", 500, raising=False)
    one = spark.range(4000, numPartitions=1).select("id", (F.col("id") % 2).alias("y"), F.rand(1).alias("v"))
    sizes = models.vector_table(one, "y", ["v"], ["id"]).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 800
    assert models.vector_table(one.limit(0), "y", ["v"], ["id"]).count() == 0


def test_equal_estimators_are_fitted_once(spark):
    fits = []

    class Watched(estimators.NearestCentroid):
        def _fit(self, dataset):
            fits.append(self.getOrDefault(self.metric))
            return super()._fit(dataset)

    def make(metric, shrink_threshold):
        plain = models.nearest_centroid(metric, shrink_threshold)
        return Watched(**models._columns(metric=metric, shrink=plain.getOrDefault(plain.shrink)))

    df = spark.range(60).select("id", (F.col("id") % 2).alias("y"), (F.col("id") % 2 + F.rand(1)).alias("v"))
    grid = {"Nearest Centroid": {"metric": ["manhattan", "euclidean"], "shrink_threshold": [None, 0.5, 2.0]}}
    found = tuning.grid_search(df, "y", ["v"], ["id"], grid, {"Nearest Centroid": make}, folds=2).collect()
    assert len(found) == 6 and sorted(fits) == ["euclidean"] * 6 + ["manhattan"] * 2
