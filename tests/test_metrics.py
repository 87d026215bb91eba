import itertools
import math
import random

import pytest

from flowspark.operators import metrics
from flowspark.plans import reports


def predictions(spark, pairs):
    return spark.createDataFrame(pairs, "y string, yhat string")


def brute(pairs):
    labels = sorted({a for a, _ in pairs} | {b for _, b in pairs})
    n = len(pairs)
    out = {}
    for c in labels:
        tp = sum(a == b == c for a, b in pairs)
        fn, fp = sum(a == c != b for a, b in pairs), sum(b == c != a for a, b in pairs)
        out[c] = (tp, fn, fp, n - tp - fn - fp)
    return out


CASES = {
    "never predicted": [("a", "b"), ("b", "b"), ("c", "b"), ("c", "c")],
    "predicted, never true": [("a", "x"), ("b", "b"), ("a", "a")],
    "one label": [("a", "a"), ("a", "a")],
    "binary": [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("b", "a")],
}


@pytest.mark.parametrize("case", CASES)
def test_class_table(spark, case):
    pairs = CASES[case]
    cells = metrics.confusion_counts(predictions(spark, pairs), "y", "yhat")
    got = {r["Class"]: (r["TP"], r["FN"], r["FP"], r["TN"]) for r in metrics.one_vs_rest(cells).collect()}
    assert got == brute(pairs)


def test_matrix_is_zero_filled(spark):
    m = metrics.confusion_matrix(predictions(spark, CASES["predicted, never true"]), "y", "yhat")
    cells = {(r["y"], r["yhat"]): r["n"] for r in m.collect()}
    assert len(cells) == 9 and cells["x", "x"] == 0 and cells["a", "x"] == 1


def test_binary_rates(spark):
    cells = metrics.confusion_counts(predictions(spark, CASES["binary"]), "y", "yhat")
    row = metrics.error_rates(cells).first()
    assert math.isclose(row["fpr"], 1 / 2) and math.isclose(row["fnr"], 1 / 3)


def test_true_label_policy_with_wide_matrix(spark):
    cells = metrics.confusion_counts(predictions(spark, CASES["predicted, never true"]), "y", "yhat")
    row = metrics.error_rates(cells, labels_from="true").first()
    assert row["fpr"] == row["fnr"] == pytest.approx(1 / 3)


def test_unknown_policy(spark):
    with pytest.raises(ValueError):
        metrics.error_rates(metrics.confusion_counts(predictions(spark, CASES["binary"]), "y", "yhat"), "other")


def test_single_label_agreement_is_zero(spark):
    row = metrics.agreement(metrics.confusion_counts(predictions(spark, CASES["one label"]), "y", "yhat")).first()
    assert row["mcc"] == 0.0 and row["kappa"] == 0.0


def test_auc_with_ties_equals_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randint(0, 5) / 5) for _ in range(200)]
    df = spark.createDataFrame(rows, "y string, s double")
    got = {r["Class"]: r["auc"] for r in metrics.roc_auc(df, "y", {"a": "s"}).collect()}
    pos, neg = [s for y, s in rows if y == "a"], [s for y, s in rows if y == "b"]
    want = sum((p > q) + (p == q) / 2 for p, q in itertools.product(pos, neg)) / (len(pos) * len(neg))
    assert math.isclose(got["a"], want)


def test_auc_without_negatives_is_null(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.2)], "y string, s double")
    assert metrics.roc_auc(df, "y", {"a": "s"}).first()["auc"] is None


def test_last_class_average(spark):
    rows = reports.evaluation_report(predictions(spark, CASES["binary"]), "y", "yhat", average="last_class").collect()
    last = {r["Class"]: r for r in rows}
    assert last["Average"]["F1"] == last["b"]["F1"]


def test_fold_mean_of_tiny_class(spark):
    folds = spark.createDataFrame([("m", 0.5, 1), ("m", 0.7, 1), ("k", 0.5, 5), ("k", None, 5)], "model string, f1 double, low int")
    got = {r["model"]: r["f1"] for r in metrics.fold_mean(folds, ["model"], ["f1"], "low").collect()}
    assert got == {"m": None, "k": 0.5}


def test_empty_predictions(spark):
    empty = predictions(spark, [("a", "a")]).limit(0)
    assert metrics.one_vs_rest(metrics.confusion_counts(empty, "y", "yhat")).count() == 0


def test_model_names(spark):
    df = spark.createDataFrame([("d", "random_forest-v2", 0.5), ("d", "svm", 0.9)], "dataset string, model string, f1 double")
    assert [r["model"] for r in reports.leaderboard(df).collect()] == ["svm", "random forest"]
