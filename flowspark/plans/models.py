"""Classifiers as MLlib pipelines, stacking, and scoring with a stored model."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.operators.metrics import score
from flowspark.operators.sample import stratified_folds
from flowspark.session import parallelism, settle

SEED = 42  # fixed value: seed of every model
LABEL, FEATURES = "y", "features"
ROWS = 50_000  # of a vector table, about: a task goes through them as fast as it starts
SHALLOW = 10  # levels up to which the driver may hold a forest


def vector_table(df: DataFrame, label: str, features: Sequence[str], keys: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Keys, label as double `y`, and one dense vector column, written out once for repeated fits.

    Rows are dealt evenly first: a fit goes through them with as many tasks as there are parts, whatever files they came from.
    """
    typed = df.select(*dict.fromkeys([*keys, *keep]), F.col(label).cast("double").alias(LABEL), *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
    assembled = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(features))], outputCol=FEATURES).transform(typed)
    tasks = max(1, min(2 * parallelism(df.sparkSession), -(-df.count() // ROWS)))
    return settle(assembled.drop(*[f"_x{i}" for i in range(len(features))]).repartition(tasks, *keys))


def _columns(**extra):
    return {"featuresCol": FEATURES, "labelCol": LABEL, **extra}


def forest(trees: int = 100, depth: int = 30, **extra):
    """Random forest: MLlib's up to SHALLOW levels, where its size does not follow the rows; deeper ones are kept as a table."""
    if depth > SHALLOW and not extra:
        from flowspark.plans.deep_forest import DeepForest

        return DeepForest(**_columns(numTrees=trees, maxDepth=depth, seed=SEED))
    return RandomForestClassifier(**_columns(numTrees=trees, maxDepth=depth, seed=SEED, **extra))


def boosted(classes: int = 2, rounds: int = 50, depth: int = 5, **extra):
    """Boosted trees, one against the rest when there are more than two classes."""
    gbt = GBTClassifier(**_columns(maxIter=rounds, maxDepth=depth, seed=SEED, **extra))
    return gbt if classes <= 2 else OneVsRest(classifier=gbt, parallelism=4, **_columns())


def penalty_weight(c: float, rows: int) -> float:
    """The weight MLlib puts on its mean loss for an inverse penalty `c` on a summed loss."""
    return 1.0 / (c * max(1, rows))


def logistic(c: float = 1.0, penalty: str | None = "l2", l1_ratio: float = 0.0, rows: int = 10_000, rounds: int = 100):
    """Multinomial logistic regression; `c` is the inverse penalty for `rows` training rows."""
    mix = {"l1": 1.0, "elasticnet": l1_ratio}.get(penalty, 0.0)
    weight = 0.0 if penalty is None else penalty_weight(c, rows)
    return LogisticRegression(**_columns(family="multinomial", regParam=weight, elasticNetParam=mix, maxIter=rounds))


def linear_svc(c: float = 1.0, classes: int = 2, rows: int = 10_000, rounds: int = 100):
    """Linear support vectors, one against the rest when there are more than two classes."""
    svc = LinearSVC(**_columns(regParam=penalty_weight(c, rows), maxIter=rounds))
    return svc if classes <= 2 else OneVsRest(classifier=svc, parallelism=4, **_columns())


def perceptron(inputs: int, classes: int, hidden: Sequence[int] = (100,), rounds: int = 100):
    """Feed-forward net."""
    return MultilayerPerceptronClassifier(**_columns(layers=[inputs, *hidden, classes], maxIter=rounds, seed=SEED))


def nearest_centroid(metric: str = "euclidean", shrink_threshold: float | None = None):
    """Nearest class centre; medians (manhattan) are not shrunk."""
    from flowspark.plans.estimators import NearestCentroid

    return NearestCentroid(**_columns(metric=metric, shrink=(shrink_threshold or 0.0) if metric != "manhattan" else 0.0))


def neighbours(n_neighbors: int = 5, weights: str = "uniform", metric: str = "euclidean", p: float = 2.0):
    """Vote of the nearest training rows."""
    from flowspark.plans.estimators import Neighbours

    return Neighbours(**_columns(k=n_neighbors, weights=weights, metric=metric, p=float(p)))


def default_models(inputs: int, classes: int, rows: int) -> dict[str, object]:
    """The model line-up that Spark can fit."""
    return {
        "KNN": neighbours(), "Nearest Centroid": nearest_centroid(),
        "Random Forest": forest(), "Gradient Boosting": boosted(classes), "Logistic Regression": logistic(rows=rows),
        "SVM": linear_svc(classes=classes, rows=rows), "MLP (Neural Net)": perceptron(inputs, classes),
    }


def train_and_score(train: DataFrame, test: DataFrame, models: Mapping[str, object],
                    metrics: Sequence[str] = ("weighted", "rates", "agreement")) -> DataFrame:
    """Fit each model on a vector table and score it on another: one metric row per model,
    with the seconds both steps took."""
    rows = []
    for name, estimator in models.items():
        start = time.perf_counter()
        fitted = estimator.fit(train)
        trained = time.perf_counter()
        found = score(fitted.transform(test), LABEL, "prediction", metrics).first().asDict()
        rows.append({"model": name, **found, "train_seconds": trained - start, "test_seconds": time.perf_counter() - trained})
    schema = ", ".join(["model string", *[f"{c} double" for c in rows[0] if c != "model"]])
    return train.sparkSession.createDataFrame([tuple(r.values()) for r in rows], schema)


def pipeline(features: Sequence[str], estimator) -> Pipeline:
    """Raw feature columns to prediction: assemble, scale, classify. Fitting passes over rows that lack a feature."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="skip"),
        StandardScaler(inputCol="_raw", outputCol=FEATURES, withMean=True, withStd=True), estimator])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Every row of a table with its prediction, null where a feature is missing."""
    inputs = model.stages[0].getInputCols()
    present = {c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in inputs}
    own = df.withColumns({f"_own_{c}": F.col(c) for c in inputs} | {"_usable": reduce(and_, present.values())})
    filled = own.withColumns({c: F.when(present[c], F.col(c)).otherwise(0) for c in inputs})
    scored = model.transform(filled).withColumn("prediction", F.when(F.col("_usable"), F.col("prediction")))
    return scored.withColumns({c: F.col(f"_own_{c}") for c in inputs}).drop("_usable", *[f"_own_{c}" for c in inputs])


def score_stored(path: str, df: DataFrame, label: str, metrics: Sequence[str] = ("weighted", "rates")) -> DataFrame:
    """Metrics of a saved pipeline on the rows it can score, and how many it cannot (`unusable`)."""
    predicted = settle(predict(PipelineModel.load(path), df.withColumn(LABEL, F.col(label).cast("double"))).select(LABEL, "prediction"))
    unusable = predicted.where("prediction is null").count()
    return score(predicted.where("prediction is not null"), LABEL, "prediction", metrics).withColumn("unusable", F.lit(unusable).cast("long"))


def stacked(train: DataFrame, test: DataFrame, keys: Sequence[str], bases: Mapping[str, Callable[[], object]], k: int = 3,
            meta: object | None = None) -> DataFrame:
    """Predictions of a model over cross-validated base predictions.

    Each base scores every training row while that row's fold is held out; the meta-model
    learns on those probabilities, and the test side is scored by bases fitted on all rows.
    """
    folded = settle(stratified_folds(train, LABEL, keys, k))
    held, final = folded.select(*keys, LABEL), test.select(*keys, LABEL)
    for name, make in bases.items():
        parts = None
        for f in range(k):
            model = make().fit(folded.filter(F.col("fold") != f))
            part = model.transform(folded.filter(F.col("fold") == f)).select(*keys, vector_to_array("probability").alias(name))
            parts = part if parts is None else parts.unionByName(part)
        held = held.join(parts, list(keys))
        whole = make().fit(folded)
        final = final.join(whole.transform(test).select(*keys, vector_to_array("probability").alias(name)), list(keys))

    def meta_table(d: DataFrame) -> DataFrame:
        width = {n: len(d.select(n).first()[0]) for n in bases}
        cells = [F.get(n, F.lit(i)).alias(f"{n}_{i}") for n in bases for i in range(width[n])]
        flat = d.select(*keys, LABEL, *cells)
        names = [c for c in flat.columns if c not in (*keys, LABEL)]
        return VectorAssembler(inputCols=names, outputCol=FEATURES).transform(flat).select(*keys, LABEL, FEATURES)

    learner = meta or logistic()
    return learner.fit(settle(meta_table(held))).transform(meta_table(final)).select(*keys, LABEL, "prediction")
