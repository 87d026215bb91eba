"""Metrics over prediction tables, and the reports made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.catalog.base import PREDICTIONS, predictions, query
from flowspark.operators import metrics


def class_sql(y: str = "y", yhat: str = "yhat", by: str = "") -> str:
    """SQL text: the one-vs-rest counts per class as CTE `cls`, beside `pred`."""
    lead = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""{PREDICTIONS}, lab AS (SELECT {lead}{y} AS class FROM pred UNION SELECT {lead}{yhat} FROM pred),
  cells AS (SELECT {lead}{y} AS y, {yhat} AS yhat, count(*) AS n FROM pred GROUP BY ALL),
  cls AS (SELECT {lead}class, tp, sup - tp AS fn, prd - tp AS fp, total - sup - prd + tp AS tn, sup, prd, total FROM (
    SELECT {lead}class,
      (SELECT coalesce(sum(n), 0) FROM cells c WHERE c.y = l.class AND c.yhat = l.class{f" AND c.{by} = l.{by}" if by else ""})::BIGINT AS tp,
      (SELECT coalesce(sum(n), 0) FROM cells c WHERE c.y = l.class{f" AND c.{by} = l.{by}" if by else ""})::BIGINT AS sup,
      (SELECT coalesce(sum(n), 0) FROM cells c WHERE c.yhat = l.class{f" AND c.{by} = l.{by}" if by else ""})::BIGINT AS prd,
      (SELECT sum(n) FROM cells c{f" WHERE c.{by} = l.{by}" if by else ""})::BIGINT AS total FROM lab l)),
  per AS (SELECT *, (tp + tn) / total AS acc, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS prec,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rec, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
    CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr_i, CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0 END AS fnr_i FROM cls)"""


WEIGHTED = """round(sum(tp) / sum(sup), 9) AS accuracy, round(sum(prec * sup) / sum(sup), 9) AS precision,
  round(sum(rec * sup) / sum(sup), 9) AS recall, round(sum(f1 * sup) / sum(sup), 9) AS f1"""


def rounded(df, digits=9):
    """Doubles to a fixed number of places, for comparison across engines."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("a8_confusion_matrix", f"""WITH {class_sql()} SELECT a.class AS y, b.class AS yhat, coalesce(n, 0)::BIGINT AS n FROM lab a JOIN lab b ON true
  LEFT JOIN cells c ON c.y = a.class AND c.yhat = b.class""")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(predictions(spark, sf_dir), "y", "yhat")


@query("a9_class_metrics", f"""WITH {class_sql()} SELECT class AS "Class", tp AS "TP", fn AS "FN", fp AS "FP", tn AS "TN", sup AS "Support",
  round(acc, 9) AS "Accuracy", round(prec, 9) AS "Precision", round(rec, 9) AS "Recall", round(f1, 9) AS "F1" FROM per""")
def class_metrics(spark, sf_dir):
    df = predictions(spark, sf_dir)
    return rounded(metrics.one_vs_rest(metrics.confusion_counts(df, "y", "yhat")))


@query("a10_weighted_scores", f"WITH {class_sql(by='fold')} SELECT fold, {WEIGHTED} FROM per GROUP BY fold")
def weighted_scores(spark, sf_dir):
    cells = metrics.confusion_counts(predictions(spark, sf_dir), "y", "yhat", ["fold"])
    return rounded(metrics.weighted_scores(cells, ["fold"]))


RATES = "round(sum(fpr_i * sup) / sum(sup), 9) AS fpr, round(sum(fnr_i * sup) / sum(sup), 9) AS fnr"


@query("a11_rates_binary", f"WITH {class_sql('y2', 'yhat2')} SELECT round(fpr_i, 9) AS fpr, round(fnr_i, 9) AS fnr FROM per WHERE class = 'O'")
def rates_binary(spark, sf_dir):
    return rounded(metrics.error_rates(metrics.confusion_counts(predictions(spark, sf_dir), "y2", "yhat2")))


@query("a11_rates_union", f"WITH {class_sql()} SELECT {RATES} FROM per")
def rates_union(spark, sf_dir):
    return rounded(metrics.error_rates(metrics.confusion_counts(predictions(spark, sf_dir), "y", "yhat")))


@query("a11_rates_true_labels", f"WITH {class_sql('y2', 'yhat')} SELECT round(sum(fn) / sum(sup), 9) AS fpr, round(sum(fn) / sum(sup), 9) AS fnr FROM per")
def rates_true_labels(spark, sf_dir):
    cells = metrics.confusion_counts(predictions(spark, sf_dir), "y2", "yhat")
    return rounded(metrics.error_rates(cells, labels_from="true"))


@query("a11_rates_weighted", f"WITH {class_sql('y2', 'yhat2')} SELECT {RATES} FROM per")
def rates_weighted(spark, sf_dir):
    return rounded(metrics.error_rates(metrics.confusion_counts(predictions(spark, sf_dir), "y2", "yhat2"), "weighted"))


@query("a11_rates_macro", f"""WITH {class_sql()} SELECT round(avg(fpr_i), 9) AS fpr, round(avg(fnr_i), 9) AS fnr, round(avg(rec), 9) AS tpr,
  round(avg(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END), 9) AS tnr FROM per""")
def rates_macro(spark, sf_dir):
    return rounded(metrics.error_rates(metrics.confusion_counts(predictions(spark, sf_dir), "y", "yhat"), "macro"))


AGREEMENT = """round((c * s - pt) / (sqrt(s * s - pp) * sqrt(s * s - tt)), 9) AS mcc, round((c * s - pt) / (s * s - pt), 9) AS kappa FROM (
  SELECT sum(tp)::DOUBLE AS c, sum(sup)::DOUBLE AS s, sum(prd::DOUBLE * sup::DOUBLE) AS pt, sum(prd::DOUBLE * prd::DOUBLE) AS pp,
    sum(sup::DOUBLE * sup::DOUBLE) AS tt FROM cls)"""


@query("a12_agreement", f"WITH {class_sql()} SELECT {AGREEMENT}")
def agreement(spark, sf_dir):
    return rounded(metrics.agreement(metrics.confusion_counts(predictions(spark, sf_dir), "y", "yhat")))


AUC = f"""{PREDICTIONS}, long AS (SELECT 'A' AS class, y = 'A' AS pos, score_a AS score FROM pred UNION ALL
    SELECT 'N', y = 'N', score_n FROM pred UNION ALL SELECT 'R', y = 'R', score_r FROM pred),
  r AS (SELECT class, pos, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2 AS rk FROM long),
  auc AS (SELECT class, (sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) AS auc,
    count(*) FILTER (pos) AS sup FROM r GROUP BY class)"""
SCORES = {"A": "score_a", "N": "score_n", "R": "score_r"}


@query("a13_roc_auc", f'WITH {AUC} SELECT class AS "Class", round(auc, 9) AS auc, sup AS "Support" FROM auc')
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(predictions(spark, sf_dir), "y", SCORES))


@query("a13_weighted_auc", f"WITH {AUC} SELECT round(sum(auc * sup) / sum(sup), 9) AS roc_auc FROM auc")
def weighted_auc(spark, sf_dir):
    return rounded(metrics.weighted_auc(metrics.roc_auc(predictions(spark, sf_dir), "y", SCORES)))


@query("a15_fold_mean", f"""WITH {class_sql(by='fold')}, folds AS (SELECT fold, {WEIGHTED} FROM per GROUP BY fold)
  SELECT round(avg(accuracy), 7) AS accuracy, round(avg(precision), 7) AS precision, round(avg(recall), 7) AS recall, round(avg(f1), 7) AS f1 FROM folds""")
def fold_mean(spark, sf_dir):
    cells = metrics.confusion_counts(predictions(spark, sf_dir), "y", "yhat", ["fold"])
    folds = metrics.weighted_scores(cells, ["fold"])
    return rounded(metrics.fold_mean(folds, [], ["accuracy", "precision", "recall", "f1"]), 7)


@query("u1_metric_registry", f"""WITH {class_sql()}, w AS (SELECT {WEIGHTED} FROM per), r AS (SELECT {RATES} FROM per), a AS (SELECT {AGREEMENT}),
  e AS (SELECT sum(fn)::BIGINT AS errors FROM cls) SELECT * FROM w, r, a, e""")
def metric_registry(spark, sf_dir):
    metrics.register_metric("errors", lambda cells, by=(): cells.groupBy(*by).agg(
        F.sum(F.when(F.col("y") != F.col("yhat"), F.col("n")).otherwise(0)).alias("errors")))
    return rounded(metrics.score(predictions(spark, sf_dir), "y", "yhat", ("weighted", "rates", "agreement", "errors")))
