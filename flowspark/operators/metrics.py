"""Classification metrics from prediction tables, by way of one small count table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.operators.ordering import running, split_points


def ratio(part: Column, whole: Column) -> Column:
    """Division with zero for an empty denominator."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def confusion_counts(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (true, predicted) pair that occurs: the only pass over the predictions."""
    return (df.groupBy(*by, F.col(y).alias("y"), F.col(yhat).alias("yhat"))
            .agg(F.count(F.lit(1)).alias("n")))


def confusion_matrix(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts over the sorted union of true and predicted labels, zeros included."""
    cells = confusion_counts(df, y, yhat, by)
    both = F.array_sort(F.array_union(F.collect_set("y"), F.collect_set("yhat")))
    grid = (cells.groupBy(*by).agg(both.alias("_labels"))
            .withColumn("y", F.explode("_labels")).withColumn("yhat", F.explode("_labels")).drop("_labels"))
    keys = [*by, "y", "yhat"]
    return grid.join(cells, keys, "left").na.fill({"n": 0})


def class_table(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """TP, FN, FP, TN, support per class from confusion counts.

    Each cell feeds its true class (support, hits) and its predicted class (predictions),
    so no label grid is needed.
    """
    true_side = F.struct(F.col("y").alias("Class"), F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("TP"),
                         F.col("n").alias("Support"), F.lit(0).cast("long").alias("Predicted"))
    pred_side = F.struct(F.col("yhat").alias("Class"), F.lit(0).cast("long").alias("TP"),
                         F.lit(0).cast("long").alias("Support"), F.col("n").alias("Predicted"))
    d = (cells.select(*by, F.explode(F.array(true_side, pred_side)).alias("s")).select(*by, "s.*")
         .groupBy(*by, "Class").agg(*[F.sum(c).alias(c) for c in ("TP", "Support", "Predicted")]))
    total = F.sum("Support").over(Window.partitionBy(*by))
    d = d.withColumn("Total", total)
    return (d.withColumn("FN", F.col("Support") - F.col("TP"))
            .withColumn("FP", F.col("Predicted") - F.col("TP"))
            .withColumn("TN", F.col("Total") - F.col("Support") - F.col("Predicted") + F.col("TP")))


def one_vs_rest(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class: TP, FN, FP, TN, Support, Accuracy, Precision, Recall, F1-Score."""
    d = class_table(cells, by)
    tp, fn, fp, tn = (F.col(c) for c in ("TP", "FN", "FP", "TN"))
    d = (d.withColumn("Accuracy", ratio(tp + tn, F.col("Total")))
         .withColumn("Precision", ratio(tp, tp + fp))
         .withColumn("Recall", ratio(tp, tp + fn))
         .withColumn("F1", ratio(2 * tp, 2 * tp + fp + fn)))
    return d.select(*by, "Class", "TP", "FN", "FP", "TN", "Support", "Accuracy", "Precision", "Recall", "F1")


def _weighted(column: str) -> Column:
    return ratio(F.sum(F.col(column) * F.col("Support")), F.sum("Support"))


def weighted_scores(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; zero on zero division."""
    d = one_vs_rest(cells, by)
    return d.groupBy(*by).agg(
        ratio(F.sum("TP"), F.sum("Support")).alias("accuracy"),
        _weighted("Precision").alias("precision"),
        _weighted("Recall").alias("recall"),
        _weighted("F1").alias("f1"),
    )


def error_rates(cells: DataFrame, policy: str = "binary_or_weighted", by: Sequence[str] = (),
                labels_from: str = "union") -> DataFrame:
    """False positive and false negative rate.

    `binary_or_weighted`: with two labels the greater one is positive, else support-weighted.
    `labels_from='true'` counts labels in the true column only; when two true labels meet a
    matrix that is not 2x2, both rates are the overall share of errors.
    `weighted`: always support-weighted. `macro`: plain mean, with TPR and TNR.
    """
    d = class_table(cells, by)
    tp, fn, fp, tn = (F.col(c) for c in ("TP", "FN", "FP", "TN"))
    d = d.withColumn("fpr_i", ratio(fp, fp + tn)).withColumn("fnr_i", ratio(fn, fn + tp))
    if policy == "macro":
        return d.groupBy(*by).agg(
            F.avg("fpr_i").alias("fpr"), F.avg("fnr_i").alias("fnr"),
            F.avg(ratio(tp, tp + fn)).alias("tpr"), F.avg(ratio(tn, tn + fp)).alias("tnr"))
    sums = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.count_if(F.col("Support") > 0).alias("k_true"),
        F.max_by("fpr_i", "Class").alias("fpr_top"), F.max_by("fnr_i", "Class").alias("fnr_top"),
        _weighted("fpr_i").alias("fpr_w"), _weighted("fnr_i").alias("fnr_w"),
        ratio(F.sum("FN"), F.sum("Support")).alias("wrong"))
    if policy == "weighted":
        return sums.select(*by, F.col("fpr_w").alias("fpr"), F.col("fnr_w").alias("fnr"))
    if policy != "binary_or_weighted":
        raise ValueError(f"unknown policy {policy!r}")
    if labels_from == "true":
        pick = lambda side: (F.when((F.col("k_true") == 2) & (F.col("k") == 2), F.col(f"{side}_top"))
                             .when(F.col("k_true") == 2, F.col("wrong")).otherwise(F.col(f"{side}_w")))
    else:
        pick = lambda side: F.when(F.col("k") == 2, F.col(f"{side}_top")).otherwise(F.col(f"{side}_w"))
    return sums.select(*by, pick("fpr").alias("fpr"), pick("fnr").alias("fnr"))


def agreement(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Multiclass Matthews correlation and Cohen's kappa, zero on zero denominators."""
    d = class_table(cells, by)
    real = lambda c: F.col(c).cast("double")
    sums = d.groupBy(*by).agg(
        F.sum(real("TP")).alias("c"), F.sum(real("Support")).alias("s"),
        F.sum(real("Predicted") * real("Support")).alias("pt"),
        F.sum(real("Predicted") * real("Predicted")).alias("pp"),
        F.sum(real("Support") * real("Support")).alias("tt"))
    c, s, pt, pp, tt = (F.col(x) for x in ("c", "s", "pt", "pp", "tt"))
    mcc = ratio(c * s - pt, F.sqrt(s * s - pp) * F.sqrt(s * s - tt))
    kappa = ratio(c * s - pt, s * s - pt)
    return sums.select(*by, mcc.alias("mcc"), kappa.alias("kappa"))


def roc_auc(df: DataFrame, y: str, scores: Mapping[object, str], by: Sequence[str] = (),
            points: Sequence[float] | None = None) -> DataFrame:
    """One-vs-rest area under the ROC curve per class, with positives as support.

    Equal scores are counted together first, then the negatives below each score are summed
    up in value ranges; ties count half. No class is ranked in one task.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("Class"), (F.col(y) == F.lit(c)).cast("long").alias("pos"), F.col(s).cast("double").alias("score"))
        for c, s in scores.items()])).alias("p")
    long = df.select(*by, pairs).select(*by, "p.*")
    points = split_points(long, "score") if points is None else points
    counted = (long.groupBy(*by, "Class", "score")
               .agg(F.sum("pos").alias("p"), (F.count(F.lit(1)) - F.sum("pos")).alias("q")))
    groups = [*by, "Class"]
    ranked = running(counted, groups, "score", ["q"], inclusive=False, points=points)
    wins = F.sum(F.col("p").cast("double") * (F.col("run_q") + F.col("q") / 2))
    return ranked.groupBy(*groups).agg(
        F.try_divide(wins, F.sum("p").cast("double") * F.sum("q")).alias("auc"), F.sum("p").alias("Support"))


def weighted_auc(per_class: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Support-weighted mean of the per-class areas."""
    return per_class.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("auc") * F.col("Support")), F.sum("Support")).alias("roc_auc"))


Metric = Callable[[DataFrame, Sequence[str]], DataFrame]

METRICS: dict[str, Metric] = {
    "weighted": weighted_scores,
    "rates": lambda cells, by=(): error_rates(cells, "binary_or_weighted", by),
    "weighted_rates": lambda cells, by=(): error_rates(cells, "weighted", by),
    "macro_rates": lambda cells, by=(): error_rates(cells, "macro", by),
    "agreement": agreement,
}


def register_metric(name: str, metric: Metric) -> None:
    """Add a metric: a function of confusion counts and grouping columns, one row per group."""
    METRICS[name] = metric


def score(df: DataFrame, y: str, yhat: str, metrics: Sequence[str] = ("weighted", "rates", "agreement"),
          by: Sequence[str] = ()) -> DataFrame:
    """One row per group with the columns of every named metric, from one pass over the rows.

    Metric columns that share a name take the metric's name as prefix.
    """
    cells = confusion_counts(df, y, yhat, by)
    seen: set[str] = set()
    tables = []
    for name in metrics:
        table = METRICS[name](cells, list(by))
        for c in [c for c in table.columns if c not in by]:
            if c in seen:
                table = table.withColumnRenamed(c, f"{name}_{c}")
            seen.add(c)
        tables.append(table if by else table.withColumn("_one", F.lit(1)))
    keys = list(by) or ["_one"]
    return reduce(lambda a, b: a.join(b, keys), tables).drop("_one")


def fold_mean(folds: DataFrame, by: Sequence[str], metrics: Sequence[str], strict_below: str | None = None) -> DataFrame:
    """Mean of each metric over folds, missing values ignored.

    `strict_below` names a column with the smallest class size: under two, all means are null.
    """
    mean = {m: F.avg(m) for m in metrics}
    if strict_below:
        mean = {m: F.when(F.min(strict_below) >= 2, v) for m, v in mean.items()}
    return folds.groupBy(*by).agg(*[v.alias(m) for m, v in mean.items()])


def fold_spread(folds: DataFrame, by: Sequence[str], metric: str = "f1") -> DataFrame:
    """Mean and population deviation of one metric over folds."""
    return folds.groupBy(*by).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))
