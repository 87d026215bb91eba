"""Fixed-length windows of consecutive rows of one source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.operators.ordering import value_ranked

BLOCK_ROWS = 4096  # rows of a source that one window task handles


def _finish(windows: DataFrame, source: str, rows: Column, label_policy: str) -> DataFrame:
    d = windows.withColumn("_rows", rows)
    d = d.withColumn("label", F.element_at("_rows", -1)["label"])
    d = d.withColumn("mixed", F.size(F.array_distinct(F.transform("_rows", lambda r: r["label"]))) > 1)
    if label_policy == "drop":
        d = d.filter(~F.col("mixed"))
    if label_policy == "reject":
        d = d.withColumn("label", F.when(F.col("mixed"), F.raise_error(F.lit("window with mixed labels"))).otherwise(F.col("label")))
    return d.select(source, "start", F.transform("_rows", lambda r: r["features"]).alias("features"), "label", "mixed")


def row_windows(df: DataFrame, source: str, order: str, ties: Sequence[str], features: Sequence[str], label: str, length: int,
                stride: int = 1, minimum: int | None = None, mixed: str = "keep", points: Sequence[float] | None = None) -> DataFrame:
    """Windows of `length` rows every `stride` rows per source, from its first row on.

    Sources shorter than `minimum` give none, partial windows are dropped, and a window
    takes the label of its last row. `mixed` says what happens to windows with several
    labels: keep, drop or reject. A long source is cut into blocks that overlap by
    length - 1 rows, so no task holds a source whole.
    """
    minimum = checked_shape(length, stride, minimum, mixed)
    row = F.struct(F.array(*[F.col(f).cast("double") for f in features]).alias("features"), F.col(label).alias("label"))
    d = value_ranked(df, [source], order, ties, rank="_rn", size="_all", points=points).filter(F.col("_all") >= minimum)
    return windows_of_positions(d.select(source, (F.col("_rn") - 1).alias("_at"), "_all", row.alias("_row")), source, length, stride, mixed)


def checked_shape(length: int, stride: int, minimum: int | None, mixed: str) -> int:
    """The least rows of a source, once length, stride and policy make sense."""
    minimum = length if minimum is None else minimum
    if length < 2 or stride < 1 or minimum < length:
        raise ValueError("need length >= 2, stride >= 1 and minimum >= length")
    if mixed not in ("keep", "drop", "reject"):
        raise ValueError(f"unknown policy {mixed!r}")
    return minimum


def windows_of_positions(d: DataFrame, source: str, length: int, stride: int, mixed: str) -> DataFrame:
    """Windows of rows that know their place: `_at` from 0 without gaps from the first place given, `_all` rows of the source, `_row`.

    A source may begin at a later place, a multiple of the stride, when its windows before that are made already.
    """
    if stride >= length:
        inside = d.filter((F.col("_at") % stride < length) & (F.floor(F.col("_at") / stride) * stride + length <= F.col("_all")))
        start = (F.floor(F.col("_at") / stride) * stride).cast("long").alias("start")
        grouped = inside.groupBy(source, start).agg(F.array_sort(F.collect_list(F.struct("_at", "_row"))).alias("_list"))
        return _finish(grouped, source, F.transform("_list", lambda r: r["_row"]), mixed)
    block = -(-max(BLOCK_ROWS, length) // stride) * stride
    own = F.floor(F.col("_at") / block)
    copies = F.when((own > 0) & (F.col("_at") % block < length - 1), F.array(own, own - 1)).otherwise(F.array(own))
    spread = d.withColumn("_own", own).withColumn("_block", F.explode(copies))
    ahead = Window.partitionBy(source, "_block").orderBy("_at").rowsBetween(0, length - 1)
    wide = spread.withColumn("_list", F.collect_list("_row").over(ahead))
    starts = wide.filter((F.col("_own") == F.col("_block")) & (F.col("_at") % stride == 0) & (F.col("_at") + length <= F.col("_all")))
    return _finish(starts.withColumn("start", F.col("_at").cast("long")), source, F.col("_list"), mixed)


def window_counts(df: DataFrame, source: str, length: int, stride: int = 1, minimum: int | None = None) -> DataFrame:
    """Rows, skipped sources, rows in skipped sources, and windows to expect: one row."""
    minimum = length if minimum is None else minimum
    sizes = df.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    short = F.col("n") < minimum
    made = F.when(~short, F.floor((F.col("n") - length) / stride) + 1).otherwise(0)
    return sizes.agg(F.sum("n").alias("source_rows"), F.count_if(short).alias("skipped_groups"),
                     F.coalesce(F.sum(F.when(short, F.col("n"))), F.lit(0)).cast("long").alias("discarded_rows"),
                     F.sum(made).cast("long").alias("windows"))
