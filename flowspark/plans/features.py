"""Feature selection with forests and principal components."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.ml.feature import PCA, VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.operators.clean import scale, scale_stats
from flowspark.operators.metrics import confusion_counts, error_rates, fold_mean, score, weighted_scores
from flowspark.operators.sample import class_counts, fold_count, stratified_folds, stratified_split
from flowspark.operators.select import importance_rank, majority_features
from flowspark.plans import extra_trees
from flowspark.plans.deep_forest import DeepForest, Rounds
from flowspark.plans.models import FEATURES, LABEL, forest, vector_table
from flowspark.session import settle

SCORES = ("accuracy", "precision", "recall", "f1", "fpr", "fnr")  # metric columns of a result row


def _train_and_test(df: DataFrame, label: str, features: Sequence[str], keys: Sequence[str], top: int, test_share: float) -> tuple[DataFrame, DataFrame]:
    if len(features) < top:
        raise ValueError(f"{len(features)} features, {top} asked for")
    if class_counts(df, label).count() < 2:
        raise ValueError("need at least two classes")
    split = settle(stratified_split(df, label, keys, test_share))
    return tuple(split.where(F.col("part") == p).drop("part") for p in ("train", "test"))


def _ranked(df: DataFrame, features: Sequence[str], model: extra_trees.Trees, top: int) -> DataFrame:
    rows = [(f, i, float(v)) for i, (f, v) in enumerate(zip(features, model.importance))]
    return importance_rank(df.sparkSession.createDataFrame(rows, "feature string, position int, importance double"), "importance", "position", top)


def tree_ranking(df: DataFrame, label: str, features: Sequence[str], keys: Sequence[str], top: int = 20, trees: int = 200,
                 depth: int = extra_trees.DEPTH, test_share: float = 0.2) -> DataFrame:
    """The ranking of `tree_importance` without its result row, so without the trees of the folds."""
    train, _ = _train_and_test(df, label, features, keys, top, test_share)
    return _ranked(df, features, extra_trees.grow(train, label, features, trees, depth), top)


def tree_importance(df: DataFrame, label: str, features: Sequence[str], keys: Sequence[str], top: int = 20, trees: int = 200,
                    depth: int = extra_trees.DEPTH, folds: int = 3, test_share: float = 0.2, parallel: int = 4) -> tuple[DataFrame, DataFrame]:
    """Extremely randomized trees on the train side: (importance, rank and selection flag per feature, one result row).

    The result row has the mean metrics `cv_*` of folds of the train side, null when a class is too small for two, and the
    metrics `test_*` of the trees of the whole train side on the test side.
    """
    train, test = _train_and_test(df, label, features, keys, top, test_share)
    k = fold_count(train, label, folds)
    parts = settle(stratified_folds(train, label, keys, k)) if k else train
    sides = [(-1, train, test)] + [(f, parts.where(F.col("fold") != f), parts.where(F.col("fold") == f)) for f in range(k or 0)]
    with ThreadPoolExecutor(parallel) as pool:
        models = list(pool.map(lambda side: extra_trees.grow(side[1], label, features, trees, depth), sides))
    ranked = _ranked(df, features, models[0], top)
    cells = [confusion_counts(extra_trees.predict(held, model).where("prediction is not null"), label, "prediction").withColumn("fold", F.lit(f))
             for (f, _, held), model in zip(sides, models)]
    counts = settle(reduce(DataFrame.unionByName, cells))
    scored = weighted_scores(counts, ["fold"]).join(error_rates(counts, "binary_or_weighted", ["fold"]), "fold")
    mean = lambda c: F.avg(F.when(F.col("fold") >= 0, F.col(c))).alias(f"cv_{c}")
    tested = lambda c: F.max(F.when(F.col("fold") < 0, F.col(c))).alias(f"test_{c}")
    return ranked, scored.agg(*[mean(c) for c in SCORES], *[tested(c) for c in SCORES])


def _fitted_importances(tables: Sequence[DataFrame], left: Sequence[Sequence[int]], make: Callable[[], object], parallel: int) -> list[np.ndarray]:
    def fit(item: tuple) -> np.ndarray:
        table, own = item
        sliced = VectorSlicer(inputCol=FEATURES, outputCol="_s", indices=own).transform(table).drop(FEATURES).withColumnRenamed("_s", FEATURES)
        return np.asarray(make().fit(sliced).featureImportances.toArray())

    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(fit, zip(tables, left)))


def eliminate_all(tables: Sequence[DataFrame], names: Sequence[str], keep: int = 10, step: int = 1,
                  make: Callable[[], object] | None = None, parallel: int = 4) -> list[list[tuple[str, bool, int]]]:
    """Drop the least important features of repeated fits, table by table: (name, kept, ranking), ranking 1 kept.

    Takes settled vector tables, which go through the rounds together. The loop is over features, a few numbers per round and table;
    deep forests find all importances of a round in one job.
    """
    make = make or forest
    left, rounds = [list(range(len(names))) for _ in tables], []
    model = make()
    deep = Rounds(model, tables, parallel) if type(model) is DeepForest and len(names) > keep else None
    try:
        while len(left[0]) > keep:
            found = deep.importances(left) if deep else _fitted_importances(tables, left, make, parallel)
            gone = []
            for own, weights in zip(left, found):
                order = sorted(range(len(own)), key=lambda i: (weights[i], i))
                gone.append([own[i] for i in order[:min(step, len(own) - keep)]])
            rounds.append(gone)
            left = [[i for i in own if i not in out] for own, out in zip(left, gone)]
    finally:
        if deep:
            deep.close()
    results = []
    for k, own in enumerate(left):
        ranking = {i: at + 2 for at, gone in enumerate(reversed(rounds)) for i in gone[k]}
        results.append([(n, i in own, ranking.get(i, 1)) for i, n in enumerate(names)])
    return results


def eliminate(table: DataFrame, names: Sequence[str], keep: int = 10, step: int = 1,
              make: Callable[[], object] | None = None) -> list[tuple[str, bool, int]]:
    """`eliminate_all` of one table."""
    return eliminate_all([table], names, keep, step, make)[0]


def recursive_elimination(df: DataFrame, label: str, features: Sequence[str], keys: Sequence[str], keep: int = 10, step: int = 1,
                          folds: int = 10, make: Callable[[], object] | None = None, parallel: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Elimination per fold: (votes, fold rows, fold metrics).

    Folds go through the rounds together; their last fits run side by side from a pool of driver threads.
    A feature is kept when at least half the folds plus one chose it. Too few rows in a
    class for two folds: one split instead.
    """
    make = make or forest
    spark = df.sparkSession
    k = fold_count(df, label, folds, "rows")
    if k:
        parts = vector_table(stratified_folds(df, label, keys, k), label, features, keys, ["fold"])
        rounds = [(f, parts.filter(F.col("fold") != f), parts.filter(F.col("fold") == f)) for f in range(k)]
    else:
        parts = vector_table(stratified_split(df, None, keys, 0.2), label, features, keys, ["part"])
        rounds = [(0, parts.filter("part = 'train'"), parts.filter("part = 'test'"))]

    ranked = eliminate_all([train for _, train, _ in rounds], features, keep, step, make, parallel)

    def run(item: tuple) -> tuple[list[tuple], DataFrame]:
        (f, train, held), result = item
        slicer = VectorSlicer(inputCol=FEATURES, outputCol="_s", indices=[i for i, r in enumerate(result) if r[1]])
        swap = lambda d: slicer.transform(d).drop(FEATURES).withColumnRenamed("_s", FEATURES)
        scored = make().fit(swap(train)).transform(swap(held))
        return [(f, n, chosen, rank) for n, chosen, rank in result], confusion_counts(scored, LABEL, "prediction").withColumn("fold", F.lit(f))

    with ThreadPoolExecutor(parallel) as pool:
        done = list(pool.map(run, zip(rounds, ranked)))
    rows = spark.createDataFrame([r for part, _ in done for r in part], "fold int, feature string, selected boolean, ranking int")
    cells = settle(reduce(DataFrame.unionByName, [c for _, c in done]))
    metrics = weighted_scores(cells, ["fold"]).join(error_rates(cells, "binary_or_weighted", ["fold"]), "fold")
    return majority_features(rows, "feature", "fold", "selected", "ranking"), rows, metrics


def elimination_result(df: DataFrame, label: str, features: Sequence[str], keys: Sequence[str], keep: int = 10, step: int = 1,
                       folds: int = 10, test_share: float = 0.2, make: Callable[[], object] | None = None, parallel: int = 4) -> DataFrame:
    """One result row: chosen features, how many, mean fold metrics `cv_*` and the metrics `test_*` of a model on them.

    Folds are made on the train side; the chosen features are those that most folds kept.
    """
    make = make or forest
    split = settle(stratified_split(df, label, keys, test_share))
    train = split.where("part = 'train'").drop("part")
    votes, _, metrics = recursive_elimination(train, label, features, keys, keep, step, folds, make, parallel)
    order = {f: i for i, f in enumerate(features)}
    chosen = sorted((r["feature"] for r in votes.where("kept").collect()), key=order.get)  # at most as many as there are columns
    if not chosen:
        raise ValueError("no feature was kept by most folds")
    table = vector_table(split, label, chosen, keys, ["part"])
    scored = make().fit(table.where("part = 'train'")).transform(table.where("part = 'test'"))
    cv = fold_mean(metrics, [], SCORES).select(F.lit(1).alias("_1"), *[F.col(c).alias(f"cv_{c}") for c in SCORES])
    test = score(scored, LABEL, "prediction", ("weighted", "rates")).select(F.lit(1).alias("_1"), *[F.col(c).alias(f"test_{c}") for c in SCORES])
    return cv.join(test, "_1").drop("_1").withColumns({"features": F.array(*[F.lit(f) for f in chosen]), "n_features": F.lit(len(chosen))})


def component_sweep(df: DataFrame, label: str, features: Sequence[str], keys: Sequence[str], sizes: Sequence[int], folds: int = 10,
                    test_share: float = 0.2, make: Callable[[], object] | None = None, parallel: int = 4) -> DataFrame:
    """One row per component count: explained variance, mean fold metrics, test metrics.

    Counts above the number of features are left out. One decomposition at the largest
    count serves all smaller ones, since components come in order. Counts run side by side.
    """
    make = make or forest
    usable = sorted({k for k in sizes if 1 <= k <= len(features)})
    if not usable:
        raise ValueError("no component count fits the features")
    split = stratified_split(df, label, keys, test_share)
    stats = scale_stats(split.filter("part = 'train'"), features)
    scaled = scale(split, stats)
    k = fold_count(scaled.filter("part = 'train'"), label, folds) or 2
    train = stratified_folds(scaled.filter("part = 'train'"), label, keys, k)
    both = train.unionByName(scaled.filter("part = 'test'").withColumn("fold", F.lit(None).cast("int")))
    table = vector_table(both, label, features, keys, ["part", "fold"])
    model = PCA(k=usable[-1], inputCol=FEATURES, outputCol="_pc").fit(table.filter("part = 'train'"))
    projected = model.transform(table).drop(FEATURES)
    variance = np.cumsum(model.explainedVariance.toArray())

    def run(size: int) -> DataFrame:
        sliced = VectorSlicer(inputCol="_pc", outputCol=FEATURES, indices=list(range(size))).transform(projected)
        train_side, test_side = sliced.filter("part = 'train'"), sliced.filter("part = 'test'")
        sides = [(f, train_side.filter(F.col("fold") != f), train_side.filter(F.col("fold") == f)) for f in range(k)] + [(-1, train_side, test_side)]
        cells = [confusion_counts(make().fit(learn).transform(held), LABEL, "prediction").withColumn("fold", F.lit(f)) for f, learn, held in sides]
        return reduce(DataFrame.unionByName, cells).withColumn("n_components", F.lit(size))

    with ThreadPoolExecutor(parallel) as pool:
        cells = settle(reduce(DataFrame.unionByName, pool.map(run, usable)))
    by = ["n_components", "fold"]
    scored = weighted_scores(cells, by).join(error_rates(cells, "binary_or_weighted", by), by)
    cv = fold_mean(scored.where("fold >= 0"), ["n_components"], SCORES)
    test = scored.where("fold = -1")
    explained = df.sparkSession.createDataFrame([(size, float(variance[size - 1])) for size in usable], "n_components int, explained_variance double")
    return (cv.select("n_components", *[F.col(c).alias(f"cv_{c}") for c in SCORES])
            .join(test.select("n_components", *[F.col(c).alias(f"test_{c}") for c in SCORES]), "n_components").join(explained, "n_components"))


def best_components(sweep: DataFrame) -> DataFrame:
    """The row of a component sweep with the highest cross-validated F1, the fewest components among equals."""
    names = [c for c in sweep.columns]
    return sweep.agg(F.max_by(F.struct(*names), F.struct("cv_f1", -F.col("n_components"))).alias("r")).select("r.*")
