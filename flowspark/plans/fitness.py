"""Fitness of feature subsets by any estimator, and a table that keeps what was scored."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import VectorSlicer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.text import state_id
from flowspark.operators.metrics import confusion_counts, error_rates, weighted_scores
from flowspark.operators.sample import fold_count, stratified_folds, stratified_split
from flowspark.operators.scoring import PENALTY
from flowspark.plans.models import FEATURES, LABEL, forest, vector_table
from flowspark.session import scratch_path

Mask = tuple[int, ...]
HELD_OUT = 0.2  # share of rows that a table too small for folds is checked on
EARLY_FOLDS, EARLY_ACCURACY = 3, 0.75  # fixed values: first folds that may reject a subset, and below what
COUNTS = "mask int, fold int, y double, yhat double, n long"


def fitness_table(df: DataFrame, label: str, features: Sequence[str], keys: Sequence[str], folds: int = 10,
                  test_share: float | None = 0.2, seed: int = 42) -> DataFrame:
    """Vector table of all fits, settled once: `keys`, `y`, `features`, `part` and `fold`.

    With a test share, the test side is set apart before folds are made, and has a null fold. Train rows get stratified
    folds; when the smallest class has fewer rows than two folds need, fold 0 is a held-out fifth and the
    other rows have fold -1, which is never held out.
    """
    split = stratified_split(df, label, keys, test_share, seed) if test_share else df.withColumn("part", F.lit("train"))
    train, test = split.where("part = 'train'"), split.where("part = 'test'")
    k = fold_count(train, label, folds)
    if k:
        folded = stratified_folds(train, label, keys, k, seed)
    else:
        halves = stratified_split(train.drop("part"), None, keys, HELD_OUT, seed)
        folded = halves.withColumn("fold", F.when(F.col("part") == "test", 0).otherwise(-1)).withColumn("part", F.lit("train"))
    both = folded.unionByName(test.withColumn("fold", F.lit(None).cast("int")))
    return vector_table(both, label, features, keys, ["part", "fold"])


def _sliced(table: DataFrame, mask: Mask) -> DataFrame:
    slicer = VectorSlicer(inputCol=FEATURES, outputCol="_s", indices=[i for i, bit in enumerate(mask) if bit])
    return slicer.transform(table).drop(FEATURES).withColumnRenamed("_s", FEATURES)


def estimator_counts(table: DataFrame, masks: Sequence[Mask], make: Callable[[], object] = forest, early_folds: int = EARLY_FOLDS,
                     early_accuracy: float = EARLY_ACCURACY, parallel: int = 4, test: bool = False) -> DataFrame:
    """Confusion counts (mask, fold, y, yhat, n) of a fit per subset and fold; `mask` is the position in `masks`.

    Subsets go side by side from a pool of driver threads, each submitting its folds in order, so that a subset that an early fold
    rejects costs no further fit. A fit reads the settled table; the counts of classes by classes come back, never
    rows. With `test`, one more fit on all train rows is scored on the test side, as fold -2.
    """
    folds = sorted(r["fold"] for r in table.where("part = 'train' and fold >= 0").select("fold").distinct().collect())
    train = table.where("part = 'train'")

    def cells(number: int, fold: int, learn: DataFrame, held: DataFrame) -> list[tuple]:
        scored = make().fit(learn).transform(held)
        return [(number, fold, r["y"], r["yhat"], r["n"]) for r in confusion_counts(scored, LABEL, "prediction").collect()]

    def run(item: tuple[int, Mask]) -> list[tuple]:
        number, mask = item
        rows = _sliced(train, mask)
        out: list[tuple] = []
        for fold in folds:
            own = cells(number, fold, rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold))
            out += own
            if fold < early_folds and sum(n for *_, y, p, n in own if y == p) < early_accuracy * sum(c[4] for c in own):
                return out
        return out + (cells(number, -2, rows, _sliced(table.where("part = 'test'"), mask)) if test else [])

    with ThreadPoolExecutor(parallel) as pool:
        found = [c for part in pool.map(run, [(i, m) for i, m in enumerate(masks) if any(m)]) for c in part]
    return table.sparkSession.createDataFrame(found, COUNTS)


def estimator_scores(table: DataFrame, masks: Sequence[Sequence[int]], make: Callable[[], object] = forest, early_folds: int = EARLY_FOLDS,
                     early_accuracy: float = EARLY_ACCURACY, parallel: int = 4, test: bool = False) -> DataFrame:
    """Fitness per subset: (id, six mean fold metrics, n_features), with `test` also the six metrics of the test side.

    An empty subset, and one that a fold below `early_folds` puts under the accuracy bound, gets the worst scores. Equal
    subsets are fitted once.
    """
    wanted = [tuple(int(bool(b)) for b in m) for m in masks]
    live = [m for m in dict.fromkeys(wanted) if any(m)]
    spark, names = table.sparkSession, list(PENALTY)
    rows = [(i, live.index(m) if any(m) else None, sum(m)) for i, m in enumerate(wanted)]
    ids = spark.createDataFrame(rows, "id int, mask int, n_features int")
    counts = estimator_counts(table, live, make, early_folds, early_accuracy, parallel, test)
    by = ["mask", "fold"]
    folds = weighted_scores(counts, by).join(error_rates(counts, "binary_or_weighted", by), by)
    weak = (F.col("fold") < early_folds) & (F.col("accuracy") < early_accuracy)
    cv = folds.where("fold >= 0").groupBy("mask").agg(F.max(weak).alias("_weak"), *[F.avg(c).alias(c) for c in names])
    worst = lambda c: F.when(F.coalesce("_weak", F.lit(True)), F.lit(PENALTY[c])).otherwise(F.col(c)).alias(c)
    out = ids.join(cv, "mask", "left")
    if not test:
        return out.select("id", *[worst(c) for c in names], "n_features")
    side = folds.where("fold = -2").select("mask", *[F.col(c).alias(f"test_{c}") for c in names])
    tests = [F.coalesce(f"test_{c}", F.lit(PENALTY[c])).alias(f"test_{c}") for c in names]
    return out.join(side, "mask", "left").select("id", *[worst(c) for c in names], *tests, "n_features")


def mask_key(study: str, mask: str = "mask"):
    """The stored key of a subset: hash of the study's name and the bits."""
    return state_id(F.lit(study), F.col(mask))


class FitnessStore:
    """What a study has scored, as an append-only table, and where its search stands, both in one folder.

    Scores are rows (key, mask, metrics, n_features) under `scores`; each call of `add` writes its own files, so
    searches may share a store, and a subset written twice counts once. The state of a search is a row in a
    folder of its own per generation; the newest that was finished is read, so a search that dies while writing goes on from the one
    before.
    """

    def __init__(self, spark: SparkSession, path: str, study: str):
        self.spark, self.path, self.study = spark, path.rstrip("/"), study
        metrics = ", ".join(f"{c} double" for c in PENALTY)
        self.schema = f"mask string, {metrics}, n_features int"

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def _rows(self, masks: Sequence[Mask]) -> DataFrame:
        bits = [("".join(map(str, m)),) for m in masks]
        return self.spark.createDataFrame(bits, "mask string").withColumn("key", mask_key(self.study))

    def known(self, masks: Sequence[Mask]) -> dict[Mask, dict[str, float]]:
        """Scores of those of the given subsets that are stored: a join on the key, so the rest of the table stays where it is."""
        if not masks or not self._exists(f"{self.path}/scores"):
            return {}
        stored = self.spark.read.schema(f"key string, {self.schema}").parquet(f"{self.path}/scores").drop("mask")
        hits = stored.join(F.broadcast(self._rows(masks)), "key").dropDuplicates(["key"]).collect()  # at most as many as were asked for
        return {tuple(map(int, r["mask"])): {c: r[c] for c in (*PENALTY, "n_features")} for r in hits}

    def missing(self, masks: Sequence[Mask]) -> list[Mask]:
        """The given subsets that are not stored, in order."""
        known = self.known(masks)
        return [m for m in dict.fromkeys(masks) if m not in known]

    def add(self, scores: Mapping[Mask, Mapping[str, float]]) -> None:
        """Append scores of subsets."""
        rows = [("".join(map(str, m)), *[float(s[c]) for c in PENALTY], int(s["n_features"])) for m, s in scores.items()]
        if rows:
            table = self.spark.createDataFrame(rows, self.schema).withColumn("key", mask_key(self.study))
            table.select("key", "mask", *PENALTY, "n_features").coalesce(1).write.mode("append").parquet(f"{self.path}/scores")

    def save_state(self, generation: int, state: Mapping) -> None:
        """Keep the state of a search after a generation; writing it again replaces it."""
        row = self.spark.createDataFrame([(generation, json.dumps(state))], "generation int, state string")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/{self.study}/generation={generation}")

    def load_state(self) -> tuple[int, dict] | None:
        """The newest generation whose state was written to its end, or None."""
        base = f"{self.path}/state/{self.study}"
        if not self._exists(base):
            return None
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(base)
        names = [s.getPath().getName() for s in folder.getFileSystem(conf).listStatus(folder)]
        for number in sorted((int(n.split("=")[1]) for n in names if n.startswith("generation=")), reverse=True):
            at = f"{base}/generation={number}"
            if self._exists(f"{at}/_SUCCESS"):
                return number, json.loads(self.spark.read.parquet(at).first()["state"])
        return None


def new_store(spark: SparkSession, study: str) -> FitnessStore:
    """A store in a fresh folder of the shared folder."""
    return FitnessStore(spark, scratch_path(spark, "fitness"), study)
