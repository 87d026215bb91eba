"""Folds, splits, quotas and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.catalog.base import query, table
from flowspark.operators import sample
from flowspark.operators.ordering import numbered_copies

RANKED = "row_number() OVER (PARTITION BY {by} ORDER BY md5('{seed}-' || {key}), {key})"


def quota_sql(counts: str, label: str, budget: str, minimum: int = 0, out: str = "quota") -> str:
    """SQL text of the largest-remainder quota over a table of (label, n)."""
    return f"""(SELECT {label}, n, least(n, base + fl + CASE WHEN is_open = 1 AND turn <= left_over THEN 1 ELSE 0 END)::BIGINT AS {out} FROM (
      SELECT *, row_number() OVER (ORDER BY is_open DESC, share - fl DESC, n DESC, {label}) AS turn FROM (
        SELECT *, rest - sum(fl) OVER () AS left_over, (fl < spare)::INTEGER AS is_open FROM (
          SELECT *, floor(share)::BIGINT AS fl FROM (
            SELECT *, CASE WHEN spares > 0 THEN (rest * spare)::DOUBLE / spares::DOUBLE ELSE 0.0::DOUBLE END AS share FROM (
              SELECT *, greatest({budget} - sum(base) OVER (), 0) AS rest, sum(spare) OVER () AS spares FROM (
                SELECT {label}, n, least(n, {minimum}) AS base, n - least(n, {minimum}) AS spare FROM {counts})))))))"""


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


PRIORITY = "(SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)"


@query("w2_stratified_folds", f"SELECT o_orderkey, o_orderpriority, (({RANKED.format(by='o_orderpriority', seed=42, key='o_orderkey')} - 1) % 10)::INTEGER AS fold FROM orders")
def stratified_folds(spark, sf_dir):
    df = _orders(spark, sf_dir)
    k = sample.fold_count(df, "o_orderpriority", 10, "rows")
    return sample.stratified_folds(df.select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"], k)


@query("w3_stratified_split", f"""WITH q AS {quota_sql(PRIORITY, 'o_orderpriority', '(SELECT ceil(count(*) * 0.2::DOUBLE)::BIGINT FROM orders)')}
  SELECT o_orderkey, o_orderpriority, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS part FROM (
    SELECT *, {RANKED.format(by='o_orderpriority', seed=42, key='o_orderkey')} AS rn FROM orders) JOIN q USING (o_orderpriority)""")
def stratified_split(spark, sf_dir):
    df = _orders(spark, sf_dir).select("o_orderkey", "o_orderpriority")
    return sample.stratified_split(df, "o_orderpriority", ["o_orderkey"], 0.2)


@query("w3_plain_split", """SELECT part, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (
  SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('7-' || o_orderkey), o_orderkey) <= (SELECT ceil(count(*) * 0.5::DOUBLE) FROM orders)
    THEN 'test' ELSE 'train' END AS part FROM orders) GROUP BY 1""")
def plain_split(spark, sf_dir):
    df = sample.stratified_split(_orders(spark, sf_dir).select("o_orderkey"), None, ["o_orderkey"], 0.9, 7, clamp=(0.05, 0.5))
    return df.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("w3_split_without_key", f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_returnflag) - 1 AS copy FROM lineitem),
  q AS {quota_sql("(SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)", 'l_returnflag', '(SELECT ceil(count(*) * 0.25::DOUBLE)::BIGINT FROM lineitem)')}
  SELECT l_returnflag, part, count(*) AS n, sum(l_orderkey)::BIGINT AS orders, sum(l_linenumber * (copy + 1))::BIGINT AS lines FROM (
    SELECT t.*, CASE WHEN row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('42-' || l_orderkey || '-' || l_linenumber || '-' || l_returnflag || '-' || copy)) <= quota
      THEN 'test' ELSE 'train' END AS part FROM t JOIN q USING (l_returnflag)) GROUP BY 1, 2""")
def split_without_key(spark, sf_dir):
    rows = numbered_copies(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))
    parts = sample.stratified_split(rows, "l_returnflag", rows.columns, 0.25)
    return parts.groupBy("l_returnflag", "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("orders"), F.sum(F.col("l_linenumber") * (F.col("copy") + 1)).alias("lines"))


SOURCE = "(SELECT source, count(*) AS n FROM documents GROUP BY 1)"


@query("w5_largest_remainder", f"SELECT * FROM {quota_sql(SOURCE, 'source', '(SELECT count(*) // 3 FROM documents)', 50)}")
def largest_remainder(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    return sample.largest_remainder(sample.class_counts(df, "source"), "source", df.count() // 3, 50)


SYNTHETIC = """(WITH c AS (SELECT *, sum(n) OVER () AS total FROM {counts}),
  t AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE greatest(1, floor(total * {amount}::DOUBLE)) END::BIGINT AS target, CASE WHEN n < {small} THEN {floor} ELSE 0 END AS small_floor FROM c),
  g AS (SELECT *, CASE WHEN sum(small_floor) OVER () BETWEEN 1 AND target THEN small_floor ELSE 0 END AS given FROM t),
  w AS (SELECT *, target - sum(given) OVER () AS rest, greatest(0.0::DOUBLE, n::DOUBLE / total::DOUBLE * target - given) AS weight FROM g),
  w2 AS (SELECT * EXCLUDE (weight), CASE WHEN sum(weight) OVER () > 0 THEN weight ELSE n::DOUBLE END AS weight FROM w),
  r AS (SELECT *, weight / sum(weight) OVER () * rest AS raw FROM w2),
  f AS (SELECT *, floor(raw)::BIGINT AS fl FROM r),
  o AS (SELECT *, rest - sum(fl) OVER () AS left_over, row_number() OVER (ORDER BY raw - fl DESC, {label}::VARCHAR) AS turn FROM f)
  SELECT {label}, n, (given + fl + CASE WHEN turn <= left_over THEN 1 ELSE 0 END)::BIGINT AS quota FROM o)"""


@query("w6_synthetic_quota", f"SELECT * FROM {SYNTHETIC.format(counts=SOURCE, label='source', amount=0.37, small=150, floor=10)}")
def synthetic_quota(spark, sf_dir):
    counts = sample.class_counts(table(spark, sf_dir, "documents"), "source")
    return sample.synthetic_quota(counts, "source", 0.37, 150, 10)


@query("w6_absolute_quota", """SELECT source, n, (1003 // k + CASE WHEN turn <= 1003 % k THEN 1 ELSE 0 END)::BIGINT AS quota FROM (
  SELECT source, count(*) AS n, count(*) OVER () AS k, row_number() OVER (ORDER BY source) AS turn FROM documents GROUP BY source)""")
def absolute_quota(spark, sf_dir):
    return sample.synthetic_quota(sample.class_counts(table(spark, sf_dir, "documents"), "source"), "source", 1003)


@query("w7_class_aware_sample", f"""WITH q AS {quota_sql(PRIORITY, 'o_orderpriority', '(SELECT count(*) // 4 FROM orders)', 50)}
  SELECT o_orderkey, o_orderpriority FROM (SELECT *, {RANKED.format(by='o_orderpriority', seed=42, key='o_orderkey')} AS rn FROM orders)
  JOIN q USING (o_orderpriority) WHERE rn <= quota""")
def class_aware_sample(spark, sf_dir):
    df = _orders(spark, sf_dir).select("o_orderkey", "o_orderpriority")
    return sample.class_aware_sample(df, "o_orderpriority", ["o_orderkey"], df.count() // 4, 50)


@query("o5_capped_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42-' || o_orderkey), o_orderkey LIMIT 1000")
def capped_sample(spark, sf_dir):
    return sample.capped_sample(_orders(spark, sf_dir).select("o_orderkey", "o_totalprice"), ["o_orderkey"], 1000)
