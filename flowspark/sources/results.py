"""Result tables kept on disk: merge, order, and a swap that readers never see half done."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.operators.ordering import ordered_positions

STAMP_FORMAT = "yyyy-MM-dd_HH_mm_ss"  # fixed value: time stamp in result tables
MISSING_INDEX = 1e9  # fixed value: sort position of a run index that is no number


def aligned(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The configured columns in order; missing ones null."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def replace_rows(existing: DataFrame, new: DataFrame, key: str = "dataset_path") -> DataFrame:
    """Existing rows whose key is not in the batch, then the batch."""
    kept = existing.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def append_rows(existing: DataFrame, new: DataFrame, columns: Sequence[str], stamp: str = "timestamp") -> DataFrame:
    """Both tables on the column list, newest stamp first, unreadable stamps last."""
    both = aligned(existing, columns).unionByName(aligned(new, columns))
    return both.orderBy(F.try_to_timestamp(F.col(stamp), F.lit(STAMP_FORMAT)).desc_nulls_last())


def run_index_order(column: str = "run_index") -> Column:
    """`best` first, then numbers, anything else last."""
    text = F.trim(F.col(column).cast("string"))
    number = F.expr(f"try_cast(trim(cast(`{column}` as string)) AS DOUBLE)")
    return F.when(F.lower(text) == "best", F.lit(-1.0)).otherwise(F.coalesce(number, F.lit(MISSING_INDEX)))


def best_first(df: DataFrame, position: str | None = None) -> DataFrame:
    """Rows by dataset, path and run index, the best run first; with `position`, numbered in that order from 1."""
    order = [F.col("dataset"), F.col("dataset_path"), run_index_order()]
    return ordered_positions(df, order, position) if position else df.orderBy(*order)


def swap_in(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write beside the table and rename, keeping the former state as `.bak` until the next swap."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fresh, former = f"{path}.new", f"{path}.bak"
    df.write.mode("overwrite").parquet(fresh)
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        fs.delete(jvm.org.apache.hadoop.fs.Path(former), True)
        fs.rename(target, jvm.org.apache.hadoop.fs.Path(former))
    fs.rename(jvm.org.apache.hadoop.fs.Path(fresh), target)


def load_results(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, else its `.bak` state, else None."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for candidate in (path, f"{path}.bak"):
        p = jvm.org.apache.hadoop.fs.Path(candidate)
        if p.getFileSystem(conf).exists(p):
            return spark.read.parquet(candidate)
    return None
