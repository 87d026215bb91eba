"""Grid search: the grid, minus what is cached, fitted side by side on folds."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.param import Params
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.operators.grid import best_configuration, parameter_grid, skip_cached
from flowspark.operators.metrics import score
from flowspark.operators.sample import class_aware_sample, stratified_folds
from flowspark.plans.models import LABEL, nearest_centroid, neighbours, vector_table

METRICS = ("weighted", "macro_rates", "agreement")
OWN_MAKERS = {"KNN": neighbours, "Nearest Centroid": nearest_centroid}  # take the parameters of their grids as they are


def grid_search(df: DataFrame, label: str, features: Sequence[str], keys: Sequence[str], grids: Mapping[str, Mapping[str, Sequence]],
                makers: Mapping[str, Callable[..., object]], cache: DataFrame | None = None, folds: int = 10, sample_rows: int | None = None,
                parallel: int = 4) -> DataFrame:
    """One row per parameter set: model, params_json, mean fold metrics, elapsed seconds.

    Sets already in `cache` (model, params_json) are skipped. The fits of one set are
    submitted from a small pool of driver threads; Spark shares the executors among them. Sets that
    make estimators of equal parameters, as where one of them has no say, are fitted once.
    """
    spark = df.sparkSession
    data = class_aware_sample(df, label, keys, sample_rows) if sample_rows else df
    table = vector_table(stratified_folds(data, label, keys, folds), label, features, keys, ["fold"])
    todo = parameter_grid(spark, grids)
    if cache is not None:
        todo = skip_cached(todo, cache, ["model", "params_json"])
    sets = todo.select("model", "params_json").orderBy("model", "params_json").collect()

    def made(row):
        return makers[row["model"]](**json.loads(row["params_json"]))

    def signature(row) -> tuple:
        estimator = made(row)
        if not isinstance(estimator, Params):
            return row["model"], row["params_json"]
        return row["model"], type(estimator).__name__, *sorted((p.name, repr(v)) for p, v in estimator.extractParamMap().items())

    def run(row) -> tuple:
        start = time.time()
        held = None
        for f in range(folds):
            fitted = made(row).fit(table.filter(F.col("fold") != f))
            part = fitted.transform(table.filter(F.col("fold") == f)).select("fold", LABEL, "prediction")
            held = part if held is None else held.unionByName(part)
        per_fold = score(held, LABEL, "prediction", METRICS, ["fold"])
        names = [c for c in per_fold.columns if c != "fold"]
        means = per_fold.agg(*[F.avg(c).alias(c) for c in names]).first().asDict()
        return {k: float(v) if v is not None else None for k, v in means.items()}, time.time() - start

    kinds = {signature(row): row for row in reversed(sets)}
    with ThreadPoolExecutor(parallel) as pool:
        found = dict(zip(kinds, pool.map(run, kinds.values())))
    results = [(row["model"], row["params_json"], *found[signature(row)]) for row in sets]
    names = list(results[0][2]) if results else ["accuracy", "precision", "recall", "f1"]
    rows = [(m, p, *[s[c] for c in names], e) for m, p, s, e in results]
    schema = "model string, params_json string, " + ", ".join(f"{c} double" for c in names) + ", elapsed double"
    return spark.createDataFrame(rows, schema)


def winners(results: DataFrame) -> DataFrame:
    """The best parameter set per model: highest F1, then least time."""
    return best_configuration(results, ["model"], "f1", "elapsed", "params_json")
