"""Categories and labels as numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.session import bounded, settle

MOST_VALUES = 10_000  # most indicator columns that `category_values` makes; `fit_categories` has no limit


def _cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])).alias("e")
    return df.select(cells).select("e.c", "e.v").where("v is not null").distinct()


def category_values(df: DataFrame, columns: Sequence[str], most: int = MOST_VALUES) -> dict[str, list[str]]:
    """Sorted values of text columns on the training side, in one pass.

    Every value becomes a column, so there may be `most` of them; with more, `fit_categories` is the way.
    """
    found = _cells(df, columns).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} values in {', '.join(columns)}: use fit_categories and sparse_one_hot")
    return {c: sorted(r["v"] for r in found if r["c"] == c) for c in columns}


def one_hot(df: DataFrame, values: Mapping[str, Sequence[str]]) -> DataFrame:
    """`column_value` indicator columns; a value unseen in training gives zeros only, as does a column that is not there."""
    out = [F.col(f"`{c}`") for c in df.columns if c not in values]
    for c, seen in values.items():
        hit = lambda v: F.coalesce((F.col(f"`{c}`").cast("string") == v).cast("int"), F.lit(0)) if c in df.columns else F.lit(0)
        out += [hit(v).alias(f"{c}_{v}") for v in seen]
    return df.select(*out)


@dataclass
class Categories:
    """Values of text columns with their numbers, as a table (c, v, index), and how many each column has."""

    table: DataFrame
    sizes: dict[str, int]

    def slots(self) -> DataFrame:
        """(slot, name) of the assembled vector: columns in order, their values in text order."""
        starts, at = {}, 0
        for c, n in self.sizes.items():
            starts[c], at = at, at + n
        first = self.table.sparkSession.createDataFrame(list(starts.items()), "c string, first long")
        return self.table.join(F.broadcast(first), "c").select((F.col("first") + F.col("index")).alias("slot"), F.concat_ws("_", "c", "v").alias("name"))


def fit_categories(df: DataFrame, columns: Sequence[str]) -> Categories:
    """Number the values of text columns from 0 in text order, however many there are.

    The distinct values are sorted over all tasks; a value's number is its place in its range plus the values
    of its column before the range. Only a row per range and column reaches the driver.
    """
    spot = F.monotonically_increasing_id()
    placed = settle(_cells(df, columns).orderBy("c", "v").select("c", "v", F.shiftright(spot, 33).alias("range"), spot.alias("at")))
    spans = placed.groupBy("c", "range").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("c").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = settle(placed.join(F.broadcast(offsets), ["c", "range"]).select("c", "v", (F.col("at") - F.col("low") + F.col("before")).alias("index")))
    sizes = {r["c"]: r["n"] for r in numbered.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    return Categories(numbered, {c: sizes.get(c, 0) for c in columns})


def sparse_one_hot(df: DataFrame, fitted: Categories, out: str = "categories") -> DataFrame:
    """The columns as one sparse 0/1 vector `out`, with a slot per value as in `fitted.slots()`.

    A null, a value unseen in training, and a column that is not there set no slot. Numbers are looked up by join, the vectors
    made by Spark's encoder.
    """
    used = [c for c, n in fitted.sizes.items() if n]
    d = df
    for i, c in enumerate(used):
        if c not in df.columns:
            d = d.withColumn(f"_i{i}", F.lit(float(fitted.sizes[c])))
            continue
        own = bounded(fitted.table.where(F.col("c") == c).select(F.col("v").alias(f"_v{i}"), F.col("index").cast("double").alias(f"_i{i}")))
        joined = d.join(own, F.col(f"`{c}`").cast("string") == F.col(f"_v{i}"), "left").drop(f"_v{i}")
        d = joined.withColumn(f"_i{i}", F.coalesce(f"_i{i}", F.lit(float(fitted.sizes[c]))))
    numbers, vectors = [f"_i{i}" for i in range(len(used))], [f"_o{i}" for i in range(len(used))]
    largest = df.sparkSession.createDataFrame([tuple(float(fitted.sizes[c] - 1) for c in used)], ", ".join(f"{n} double" for n in numbers))
    encoder = OneHotEncoder(inputCols=numbers, outputCols=vectors, handleInvalid="keep", dropLast=True).fit(largest)
    coded = VectorAssembler(inputCols=vectors, outputCol=out).transform(encoder.transform(d))
    return coded.drop(*numbers, *vectors, *[c for c in used if c in df.columns])


def align_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The training columns in order: missing ones 0, extra ones dropped."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(0).alias(c) for c in columns])


def label_index(df: DataFrame, label: str, order: str | None = None) -> DataFrame:
    """(label, index) 0..k-1: by label, or by first appearance along `order`. One row per class."""
    if order is None:
        classes, by = df.select(label).distinct(), F.col(label)
    else:
        classes, by = df.groupBy(label).agg(F.min(order).alias("_at")), F.col("_at")
    ranked = classes.withColumn("index", (F.row_number().over(Window.orderBy(by)) - 1).cast("int"))
    return ranked.filter(F.col(label).isNotNull()).select(label, "index")


def encode_label(df: DataFrame, label: str, index: DataFrame, out: str, unseen: str = "error") -> DataFrame:
    """Add the class index. An unseen label raises when its row is computed, or gives null."""
    d = df.join(bounded(index.withColumnRenamed("index", out)), label, "left")
    if unseen == "error":
        message = F.concat(F.lit("unseen label: "), F.col(label).cast("string"))
        d = d.withColumn(out, F.when(F.col(out).isNull(), F.raise_error(message)).otherwise(F.col(out)))
    return d


def decode_label(df: DataFrame, code: str, index: DataFrame, out: str) -> DataFrame:
    """Add the label a class index stands for."""
    label = [c for c in index.columns if c != "index"][0]
    return df.join(bounded(index.select(F.col("index").alias(code), F.col(label).alias(out))), code, "left")
