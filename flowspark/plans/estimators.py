"""Nearest centroid and k nearest neighbours as ML estimators, for pipelines, grids and stored models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.operators.nearest import knn_classify
from flowspark.operators.ordering import exact_quantiles
from flowspark.operators.scoring import Centroids
from flowspark.session import bounded, settle

BINS = 64  # ranges of values that cells are counted in


def _param(name: str, doc: str, convert=None) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=convert) if convert else Param(Params._dummy(), name, doc)


class _Columns(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """Column names that every estimator here shares."""

    def _take(self, given: dict) -> None:
        self._set(**{k: v for k, v in given.items() if v is not None})


def medians(rows: DataFrame) -> DataFrame:
    """(y, i, q): the exact median of every position of the vectors (y, x) of a class.

    Cells are counted by class, position and one of BINS equal ranges of values; only those of the ranges that hold the middle
    are shuffled, equal values once.
    """
    cells = rows.select("y", F.posexplode(vector_to_array("x")).alias("i", "value"))
    ends = rows.groupBy("y").agg(vector_to_array(Summarizer.min(F.col("x"))).alias("lows"), vector_to_array(Summarizer.max(F.col("x"))).alias("highs"))
    endless = F.exists(F.concat("lows", "highs"), lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    if ends.where(endless).count() or rows.select(F.exists(vector_to_array("x"), F.isnan).alias("bad")).where("bad").limit(1).count():
        return exact_quantiles(cells, ["y", "i"], "value", [0.5])
    span = rows.join(bounded(ends), "y").select("y", F.posexplode(F.arrays_zip(vector_to_array("x").alias("v"), "lows", "highs")).alias("i", "c"))
    share = F.when(F.col("c.highs") > F.col("c.lows"), (F.col("c.v") / 2 - F.col("c.lows") / 2) / (F.col("c.highs") / 2 - F.col("c.lows") / 2)).otherwise(0.0)
    binned = span.select("y", "i", F.col("c.v").alias("value"), F.least(F.lit(BINS - 1), F.floor(share * BINS)).cast("int").alias("bin"))
    inside = Window.partitionBy("y", "i")
    before = lambda order: inside.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counts = binned.groupBy("y", "i", "bin").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("y", "i", "bin", "n", F.coalesce(F.sum("n").over(before("bin")), F.lit(0)).alias("start"), ((F.sum("n").over(inside) - 1) * 0.5).alias("at"))
    on = (F.ceil("at") >= F.col("start")) & (F.floor("at") < F.col("start") + F.col("n"))
    wanted = bounded(counts.where(on).select("y", "i", "bin", F.min("start").over(inside).alias("start"), "at"))
    near = binned.join(wanted, ["y", "i", "bin"]).groupBy("y", "i", "value").agg(F.count(F.lit(1)).alias("n"), F.first("start").alias("start"), F.first("at").alias("at"))
    near = near.withColumn("start", F.col("start") + F.coalesce(F.sum("n").over(before("value")), F.lit(0)))
    ends = near.where(on).groupBy("y", "i").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.first("at").alias("at"))
    return ends.select("y", "i", (F.col("lo") + (F.col("at") - F.floor("at")) * (F.col("hi") - F.col("lo"))).alias("q"))


class NearestCentroid(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Class means (medians for manhattan), optionally shrunk toward the overall mean; a row belongs to the nearest.

    Labels are numbers. Rows without a label are passed over; a class needs one row.
    """

    metric = _param("metric", "euclidean or manhattan", TypeConverters.toString)
    shrink = _param("shrink", "threshold by which means move to the overall mean; 0 leaves them", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", metric="euclidean", shrink=0.0):
        super().__init__()
        self._setDefault(metric="euclidean", shrink=0.0)
        self._take(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> NearestCentroidModel:
        label, metric, shrink = self.getLabelCol(), self.getOrDefault(self.metric), self.getOrDefault(self.shrink)
        if metric not in ("euclidean", "manhattan"):
            raise ValueError(f"unknown metric {metric!r}")
        rows = dataset.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), F.col(self.getFeaturesCol()).alias("x"))
        stats = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("x")).alias("m"), Summarizer.variance(F.col("x")).alias("v"))
        found = sorted(stats.collect(), key=lambda r: r["y"])
        if not found:
            raise ValueError("no labelled row")
        labels, n = [r["y"] for r in found], np.array([r["n"] for r in found], float)
        centers = np.array([r["m"].toArray() for r in found])
        if metric == "manhattan":
            for r in medians(rows).collect():
                centers[labels.index(r["y"]), r["i"]] = r["q"]
        elif shrink and len(labels) > 1:
            squares = (np.array([r["v"].toArray() for r in found]) * (n - 1)[:, None]).sum(axis=0)
            overall, within = (centers * n[:, None]).sum(axis=0) / n.sum(), np.sqrt(squares / (n.sum() - len(n)))
            unit = np.sqrt(1 / n - 1 / n.sum())[:, None] * (within + np.median(within))[None, :]
            with np.errstate(invalid="ignore", divide="ignore"):
                moved = np.nan_to_num((centers - overall) / unit)
            centers = overall + unit * np.sign(moved) * np.clip(np.abs(moved) - shrink, 0, None)
        model = NearestCentroidModel()
        model._set(metric=metric, labels=labels, centers=centers.tolist())
        return self._copyValues(model)


class NearestCentroidModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Centres by class. They are a few numbers a class, and are stored among the parameters."""

    metric = _param("metric", "euclidean or manhattan", TypeConverters.toString)
    shrink = _param("shrink", "threshold the means were moved by", TypeConverters.toFloat)
    labels = _param("labels", "labels in order", TypeConverters.toListFloat)
    centers = _param("centers", "one centre a label")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        labels = np.array(self.getOrDefault(self.labels))
        model = Centroids(labels.tolist(), np.array(self.getOrDefault(self.centers), float), self.getOrDefault(self.metric))

        @F.pandas_udf("double")
        def nearest(x: pd.Series) -> pd.Series:
            return pd.Series(labels[model.index(np.stack(x.to_numpy()).astype(float))] if len(x) else np.zeros(0))

        return dataset.withColumn(self.getPredictionCol(), nearest(vector_to_array(F.col(self.getFeaturesCol()))))


class Neighbours(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """k nearest training rows vote. Fitting settles the labelled rows; `transform` searches them (see `operators.nearest`)."""

    k = _param("k", "neighbours that vote", TypeConverters.toInt)
    metric = _param("metric", "euclidean, manhattan or minkowski", TypeConverters.toString)
    p = _param("p", "power of the minkowski metric", TypeConverters.toFloat)
    weights = _param("weights", "uniform or distance", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", k=5, metric="euclidean", p=2.0, weights="uniform"):
        super().__init__()
        self._setDefault(k=5, metric="euclidean", p=2.0, weights="uniform")
        self._take(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> NeighboursModel:
        rows = dataset.where(F.col(self.getLabelCol()).isNotNull()).select(
            F.monotonically_increasing_id().alias("id"), vector_to_array(F.col(self.getFeaturesCol())).alias("v"), F.col(self.getLabelCol()).cast("double").alias("y"))
        return self._copyValues(NeighboursModel(settle(rows)))


class NeighboursModel(Model, _Columns, MLReadable, MLWritable):
    """The training rows of `Neighbours`. `transform` runs jobs: it numbers the asked rows, settles them and searches."""

    k, metric, p, weights = Neighbours.k, Neighbours.metric, Neighbours.p, Neighbours.weights

    def __init__(self, rows: DataFrame | None = None):
        super().__init__()
        self._setDefault(k=5, metric="euclidean", p=2.0, weights="uniform")
        self.rows = rows

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = self.getPredictionCol()
        asked = settle(dataset.withColumn("_asked", F.monotonically_increasing_id()))
        queries = asked.select(F.col("_asked").alias("id"), vector_to_array(F.col(self.getFeaturesCol())).alias("v"))
        if self.rows.isEmpty() or queries.isEmpty():
            return asked.drop("_asked").withColumn(out, F.lit(None).cast("double"))
        get = self.getOrDefault
        voted = knn_classify(queries, self.rows, "id", "v", "y", get(self.k), get(self.metric), get(self.p), get(self.weights))
        return asked.drop(out).join(voted.select(F.col("id").alias("_asked"), F.col("prediction").alias(out)), "_asked", "left").drop("_asked")

    def write(self) -> MLWriter:
        return _NeighboursWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _NeighboursReader()


class _NeighboursWriter(MLWriter):
    def __init__(self, model: NeighboursModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.rows.write.parquet(f"{path}/rows")


class _NeighboursReader(MLReader):
    def load(self, path: str) -> NeighboursModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = NeighboursModel(self.sparkSession.read.parquet(f"{path}/rows"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
