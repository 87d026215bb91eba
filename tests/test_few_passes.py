import datetime

import numpy as np

from flowspark.operators.sample import stratified_folds
from flowspark.plans import search
from flowspark.session import scratch_path
from flowspark.sources import readers, writers


def test_a_sweep_of_few_features_reads_its_rows_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, "ab"[i % 2], *map(float, rng.normal(i % 2, 1, 3))) for i in range(60)]
    df = stratified_folds(spark.createDataFrame(rows, "id long, label string, x double, y double, z double"), "label", ["id"], 3).cache()
    passes, plain = [], search.statistics_fitness

    def counted(*args):
        rate = plain(*args)
        return lambda masks: passes.append(len(masks)) or rate(masks)

    monkeypatch.setattr(search, "statistics_fitness", counted)
    found = lambda: sorted((r[0], r[1], round(r[2], 12), r[3]) for r in search.sweep(df, "fold", "label", ["x", "y", "z"], [4], 2, early_accuracy=0.0, generations=3).collect())
    few = found()
    assert passes == [8]
    monkeypatch.setattr(search, "FEW_SUBSETS", 0)
    assert found() == few and len(passes) > 2


def test_arff_keeps_odd_and_plain_values(spark):
    rows = [("a'b\\n?", 1, 0.5, datetime.datetime(2020, 1, 2, 3, 4, 5)), ("?", None, 1e-9, None), ("line\nend\r", 3, None, None), (None, 4, -2.0, None), ("\\", 5, 1.0, None)]
    df = spark.createDataFrame(rows, "t string, i int, d double, at timestamp")
    path = scratch_path(spark, "arff")
    writers.write_arff(df, path)
    back = sorted(tuple(r) for r in readers.read_arff(spark, path).na.fill("null").collect())
    want = df.select(*[df[c].cast("string") for c in df.columns]).na.fill("null").collect()
    assert back == sorted(tuple(r) for r in want)
