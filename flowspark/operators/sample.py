"""Folds, splits, quotas and per-class samples, all decided by seeded hash order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.operators.ordering import hash_key, hash_marked, hash_ranked, hash_take
from flowspark.session import bounded


TOP_ROWS = 10_000  # largest sample taken as a top-k


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per class, one small table."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def fold_count(df: DataFrame, label: str, requested: int, rule: str = "class") -> int | None:
    """Folds the data can bear; None when fewer than two.

    `class` is bounded by the smallest class, `rows` by the row count as well.
    """
    row = class_counts(df, label).agg(F.min("n").alias("low"), F.sum("n").alias("all")).first()
    if row["low"] is None:
        return None
    k = min(requested, row["low"]) if rule == "class" else min(requested, row["low"], row["all"])
    return k if k >= 2 else None


def stratified_folds(df: DataFrame, label: str, keys: Sequence[str], k: int = 10, seed: int = 42,
                     out: str = "fold") -> DataFrame:
    """Add a fold number 0..k-1; the folds of every class differ by at most one row."""
    ranked = hash_ranked(df, [label], keys, seed, rank="_rn")
    return ranked.withColumn(out, ((F.col("_rn") - 1) % F.lit(k)).cast("int")).drop("_rn")


def largest_remainder(counts: DataFrame, label: str, budget: int, minimum: int = 0, out: str = "quota") -> DataFrame:
    """Rows to take per class for a budget.

    Every class first gets min(n, minimum). What is left of the budget is shared in
    proportion to the spare rows: floors first, then one more each by largest fraction
    (ties: larger class, then label) where the class still has spare rows. When the minima
    alone exceed the budget they stand. One row per class, so the windows are small.
    """
    everything = Window.partitionBy()
    d = (counts.withColumn("_base", F.least(F.col("n"), F.lit(minimum)))
         .withColumn("_spare", F.col("n") - F.col("_base"))
         .withColumn("_rest", F.greatest(F.lit(budget) - F.sum("_base").over(everything), F.lit(0)))
         .withColumn("_spares", F.sum("_spare").over(everything))
         .withColumn("_share", F.coalesce(F.try_divide(F.col("_rest") * F.col("_spare"), F.col("_spares")), F.lit(0.0)))
         .withColumn("_floor", F.floor("_share").cast("long"))
         .withColumn("_left", F.col("_rest") - F.sum("_floor").over(everything))
         .withColumn("_open", (F.col("_floor") < F.col("_spare")).cast("int")))
    order = Window.orderBy(F.desc("_open"), F.desc(F.col("_share") - F.col("_floor")), F.desc("n"), F.asc(label))
    d = d.withColumn("_turn", F.row_number().over(order))
    extra = F.when((F.col("_open") == 1) & (F.col("_turn") <= F.col("_left")), 1).otherwise(0)
    return d.withColumn(out, F.least(F.col("n"), F.col("_base") + F.col("_floor") + extra).cast("long")).select(label, "n", out)


def synthetic_quota(counts: DataFrame, label: str, amount: float, small_below: int = 100, small_rows: int = 10,
                    out: str = "quota") -> DataFrame:
    """Synthetic rows per class.

    `amount` up to 1 is a share of the table: max(1, floor(n * amount)), 0 for no rows.
    Classes below `small_below` get `small_rows` first if those floors fit the target; the
    rest is shared by max(0, proportional share - floor given), floors first, leftover by
    largest fraction, then label text. Above 1, `amount` is a row count spread evenly.
    """
    everything = Window.partitionBy()
    d = counts.withColumn("_all", F.sum("n").over(everything)).withColumn("_classes", F.count(F.lit(1)).over(everything))
    if amount > 1.0:
        order = Window.orderBy(label)
        each = F.floor(F.lit(int(amount)) / F.col("_classes")).cast("long")
        d = d.withColumn("_turn", F.row_number().over(order)).withColumn("_each", each)
        extra = (F.col("_turn") <= F.lit(int(amount)) - F.col("_each") * F.col("_classes")).cast("long")
        return d.withColumn(out, F.col("_each") + extra).select(label, "n", out)
    target = F.when(F.col("_all") == 0, F.lit(0)).otherwise(
        F.greatest(F.lit(1), F.floor(F.col("_all") * F.lit(float(amount))))).cast("long")
    small = (F.col("n") < small_below).cast("int")
    d = d.withColumn("_target", target).withColumn("_floors", F.sum(small * small_rows).over(everything))
    d = d.withColumn("_given", F.when((F.col("_floors") > 0) & (F.col("_floors") <= F.col("_target")), small * small_rows)
                     .otherwise(0).cast("long"))
    d = d.withColumn("_rest", F.col("_target") - F.sum("_given").over(everything))
    share = F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("_all")), F.lit(0.0)) * F.col("_target")
    d = d.withColumn("_weight", F.greatest(F.lit(0.0), share - F.col("_given")))
    d = d.withColumn("_weight", F.when(F.sum("_weight").over(everything) > 0, F.col("_weight")).otherwise(F.col("n").cast("double")))
    d = d.withColumn("_raw", F.coalesce(F.try_divide(F.col("_weight"), F.sum("_weight").over(everything)) * F.col("_rest"), F.lit(0.0)))
    d = d.withColumn("_floor", F.floor("_raw").cast("long"))
    d = d.withColumn("_left", F.col("_rest") - F.sum("_floor").over(everything))
    order = Window.orderBy(F.desc(F.col("_raw") - F.col("_floor")), F.col(label).cast("string"))
    d = d.withColumn("_turn", F.row_number().over(order))
    extra = (F.col("_turn") <= F.col("_left")).cast("long")
    return d.withColumn(out, F.col("_given") + F.col("_floor") + extra).select(label, "n", out)


def sample_by_quota(df: DataFrame, label: str, keys: Sequence[str], quotas: DataFrame, seed: int = 42,
                    quota: str = "quota") -> DataFrame:
    """Rows of each class up to its quota, without replacement; all rows when it is larger."""
    return hash_take(df, [label], keys, seed, quotas, quota)


def class_aware_sample(df: DataFrame, label: str, keys: Sequence[str], size: int, minimum: int = 50,
                       seed: int = 42) -> DataFrame:
    """A sample of `size` rows that keeps class shares and small classes."""
    quotas = largest_remainder(class_counts(df, label), label, size, minimum)
    return sample_by_quota(df, label, keys, quotas, seed)


def capped_sample(df: DataFrame, keys: Sequence[str], rows: int, seed: int = 42) -> DataFrame:
    """At most `rows` rows in seeded hash order.

    A small sample is a top-k; a large one is cut by hash range, so that it never meets in
    one task.
    """
    if rows <= TOP_ROWS:
        return df.orderBy(hash_key(seed, keys), *keys).limit(rows)
    quota = df.sparkSession.createDataFrame([(rows,)], "quota long")
    return hash_take(df, [], keys, seed, quota)


def stratified_split(df: DataFrame, label: str | None, keys: Sequence[str], test_share: float = 0.2, seed: int = 42,
                     clamp: tuple[float, float] | None = None, out: str = "part") -> DataFrame:
    """Add `part` ('train' or 'test'), class shares kept by largest remainder.

    The test part has ceil(rows * share) rows. `clamp` bounds the share. Without a label,
    or with one class only, the split is plain.
    """
    if clamp:
        test_share = min(max(test_share, clamp[0]), clamp[1])
    d = df if label else df.withColumn("_all", F.lit(0))
    by = label or "_all"
    counts = bounded(class_counts(d, by))
    whole = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    budget = int(-(-whole * test_share // 1))
    marked = hash_marked(d, [by], keys, seed, largest_remainder(counts, by, budget), out="_test")
    return marked.withColumn(out, F.when(F.col("_test"), "test").otherwise("train")).select(*df.columns, out)
