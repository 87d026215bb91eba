"""Registration of queries, and the shared inputs they start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that gives the same rows."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem made dirty by rule: nulls, NaN, infinities, out-of-range and constant columns."""
    quantity = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linenumber") != 7, F.col("l_tax")).alias("tax"),
        F.when(quantity == 1, F.lit(float("inf"))).when(quantity == 2, F.lit(float("-inf")))
        .when(quantity == 50, F.lit(float("nan"))).when(quantity == 3, F.lit(1e39)).otherwise(quantity).alias("quantity"),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
        F.lit(1.0).alias("constant"), F.lit("same").alias("constant_text"),
        F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("flag"))


DIRTY = """dirty AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_linenumber <> 7 THEN l_tax END AS tax,
         CASE WHEN l_quantity = 1 THEN 'inf'::DOUBLE WHEN l_quantity = 2 THEN '-inf'::DOUBLE
              WHEN l_quantity = 50 THEN 'nan'::DOUBLE WHEN l_quantity = 3 THEN 1e39 ELSE l_quantity END AS quantity,
         l_extendedprice AS price, l_discount AS discount, 1.0::DOUBLE AS constant, 'same' AS constant_text,
         l_linestatus AS status, l_returnflag AS flag
  FROM lineitem),
marked AS (
  SELECT *, (tax IS NULL OR quantity IS NULL OR isnan(quantity)) AS absent,
         (quantity IS NOT NULL AND isinf(quantity)) AS endless
  FROM dirty)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with a rule-made prediction of the three return flags and of the two line states."""
    quantity = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("y"),
        F.when(quantity < 17, "A").when(quantity < 34, "N").otherwise("R").alias("yhat"),
        F.col("l_linestatus").alias("y2"),
        F.when(F.col("l_discount") < 0.05, "F").otherwise("O").alias("yhat2"),
        F.col("l_extendedprice").alias("score_a"), F.col("l_discount").alias("score_n"),
        (F.col("l_tax") + F.col("l_discount")).alias("score_r"), F.col("l_linenumber").alias("fold"))


PREDICTIONS = """pred AS (
  SELECT l_returnflag AS y, CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS yhat,
         l_linestatus AS y2, CASE WHEN l_discount < 0.05 THEN 'F' ELSE 'O' END AS yhat2,
         l_extendedprice AS score_a, l_discount AS score_n, l_tax + l_discount AS score_r, l_linenumber AS fold
  FROM lineitem)"""
