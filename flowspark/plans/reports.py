"""Reports over results of models and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.operators.metrics import confusion_counts, one_vs_rest, weighted_scores


def short_model(column: str) -> Column:
    """A model name up to its first dash, underscores as blanks."""
    return F.trim(F.replace(F.substring_index(column, "-", 1), F.lit("_"), F.lit(" ")))


def leaderboard(results: DataFrame, dataset: str = "dataset", model: str = "model", metric: str = "f1") -> DataFrame:
    """Models by dataset, best first."""
    named = results.withColumn(model, short_model(model))
    return named.orderBy(dataset, F.desc(metric), model)


def evaluation_report(predicted: DataFrame, y: str, yhat: str, by: Sequence[str] = (), average: str = "weighted") -> DataFrame:
    """One row per class and one `Average` row per group.

    `average='weighted'` weighs by support; `last_class` repeats the row of the last class.
    """
    cells = confusion_counts(predicted, y, yhat, by)
    rows = one_vs_rest(cells, by)
    if average == "last_class":
        last = rows.groupBy(*by).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in by]), "Class").alias("r")).select(*by, "r.*")
        return rows.unionByName(last.withColumn("Class", F.lit("Average")))
    scores = weighted_scores(cells, by).withColumnsRenamed(
        {"accuracy": "Accuracy", "precision": "Precision", "recall": "Recall", "f1": "F1"})
    total = cells.groupBy(*by).agg(F.sum("n").alias("Support"))
    if by:
        scores = scores.join(total, list(by))
    else:
        scores = scores.withColumn("_1", F.lit(1)).join(total.withColumn("_1", F.lit(1)), "_1").drop("_1")
    scores = scores.withColumn("Class", F.lit("Average"))
    return rows.withColumn("Class", F.col("Class").cast("string")).unionByName(scores, allowMissingColumns=True)
