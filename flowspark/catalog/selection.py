"""Rankings, run histories, Pareto fronts and row windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.catalog.base import query, table
from flowspark.catalog.evaluation import rounded
from flowspark.operators import select, windows


def _history(spark, sf_dir):
    """events as run histories: a user's events in id order, the value as score."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("gen"), F.col("value").alias("f1"))


HISTORY = "h AS (SELECT user_id AS run, event_id AS gen, value AS f1 FROM events)"


@query("w1_row_windows", """WITH r AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n,
    last_value(event_type) OVER f AS label, list(event_type) OVER f AS labels, sum(value) OVER f AS total, first_value(value) OVER f AS head,
    last_value(value) OVER f AS tail FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id),
    f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
  SELECT user_id, pos AS start, label, len(list_distinct(labels)) > 1 AS mixed, round(total, 6) AS total, head, tail FROM r
  WHERE n >= 10 AND pos % 2 = 0 AND pos + 8 <= n""")
def row_windows(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type")
    w = windows.row_windows(df, "user_id", "ts", ["event_id"], ["value"], "event_type", length=8, stride=2, minimum=10)
    values = F.transform("features", lambda f: f[0])
    return w.select("user_id", "start", "label", "mixed", F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
                    F.element_at(values, 1).alias("head"), F.element_at(values, -1).alias("tail"))


@query("w1_disjoint_windows", """WITH r AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n,
    last_value(event_type) OVER f AS label, list(event_type) OVER f AS labels FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id),
    f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING))
  SELECT user_id, pos AS start, label FROM r WHERE pos % 3 = 0 AND pos + 2 <= n AND len(list_distinct(labels)) = 1""")
def disjoint_windows(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type")
    w = windows.row_windows(df, "user_id", "ts", ["event_id"], ["value"], "event_type", length=2, stride=3, mixed="drop")
    return w.select("user_id", "start", "label")


@query("w1_window_counts", """SELECT sum(n)::BIGINT AS source_rows, count(*) FILTER (n < 60) AS skipped_groups, coalesce(sum(n) FILTER (n < 60), 0)::BIGINT AS discarded_rows,
  coalesce(sum((n - 8) // 2 + 1) FILTER (n >= 60), 0)::BIGINT AS windows FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)""")
def window_counts(spark, sf_dir):
    return windows.window_counts(table(spark, sf_dir, "events"), "user_id", 8, 2, 60)


SCORES = "(SELECT p_name AS feature, max(p_retailprice) AS importance, min(p_partkey) AS position FROM part GROUP BY 1)"


@query("w4_importance_rank", f"""SELECT *, rank <= 20 AS selected FROM (SELECT *, row_number() OVER (ORDER BY importance DESC, position)::INTEGER AS rank FROM {SCORES})""")
def importance_rank(spark, sf_dir):
    scores = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("feature")).agg(
        F.max("p_retailprice").alias("importance"), F.min("p_partkey").alias("position"))
    return select.importance_rank(scores, "importance", "position", 20)


@query("a16_majority_features", """WITH f AS (SELECT l_suppkey AS feature, l_linenumber AS fold, avg(l_quantity) > 25.5 AS sel, min(l_quantity) AS rnk FROM lineitem GROUP BY 1, 2)
  SELECT feature, sum(sel::INTEGER)::BIGINT AS votes, avg(rnk) AS mean_rank, sum(sel::INTEGER) >= (SELECT count(DISTINCT fold) // 2 + 1 FROM f) AS kept FROM f GROUP BY 1""")
def majority_features(spark, sf_dir):
    folds = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("feature"), F.col("l_linenumber").alias("fold")).agg(
        (F.avg("l_quantity") > 25.5).alias("sel"), F.min("l_quantity").alias("rnk"))
    return select.majority_features(folds, "feature", "fold", "sel", "rnk")


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("features"))


NAMES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "never chosen"]
USAGE = """(SELECT f.feature, count(r.o_custkey) AS n FROM (SELECT DISTINCT o_orderpriority AS feature FROM orders UNION ALL SELECT 'never chosen') f
  LEFT JOIN (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) r ON r.o_orderpriority = f.feature GROUP BY 1)"""


@query("a17_feature_usage", f"SELECT * FROM {USAGE}")
def feature_usage(spark, sf_dir):
    return select.feature_usage(_runs(spark, sf_dir), "features", NAMES)


@query("o4_top_features", f"SELECT * FROM {USAGE} ORDER BY n DESC, feature LIMIT 3")
def top_features(spark, sf_dir):
    return select.top_features(select.feature_usage(_runs(spark, sf_dir), "features", NAMES), 3)


@query("a18_sweep_summary", """WITH r AS (SELECT l_linenumber AS size, l_suppkey AS run, max(l_extendedprice) OVER (PARTITION BY l_linenumber, l_suppkey) / 1000 AS f1,
    'd' || round(l_discount * 100)::INTEGER AS feature FROM lineitem),
  s AS (SELECT size, count(*) AS runs, avg(f1) AS mean_f1 FROM (SELECT DISTINCT size, run, f1 FROM r) GROUP BY 1),
  k AS (SELECT size, feature, count(DISTINCT run) AS k FROM r GROUP BY 1, 2),
  c AS (SELECT size, string_agg(feature, ', ' ORDER BY feature) AS common_features FROM k JOIN s USING (size) WHERE k = runs GROUP BY 1)
  SELECT size, runs, round(mean_f1, 6) AS mean_f1, coalesce(common_features, '') AS common_features, mean_f1 = (SELECT max(mean_f1) FROM s) AS best FROM s LEFT JOIN c USING (size)""")
def sweep_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("size"), F.col("l_suppkey").alias("run"), "l_extendedprice",
        F.concat(F.lit("d"), F.round(F.col("l_discount") * 100).cast("int").cast("string")).alias("feature"))
    f1 = li.groupBy("size", "run").agg((F.max("l_extendedprice") / 1000).alias("f1"))
    runs = li.select("size", "run", "feature").distinct().join(f1, ["size", "run"])
    return rounded(select.sweep_summary(runs, "size", "run", "f1", "feature"), 6)


CONVERGED = f"""{HISTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY gen) AS pos, max(f1) OVER (PARTITION BY run) AS best, count(*) OVER (PARTITION BY run) AS n FROM h),
  conv AS (SELECT run, coalesce(min(pos) FILTER (best > 0 AND f1 >= 0.95::DOUBLE * best), max(n))::BIGINT AS convergence_generation FROM r GROUP BY 1)"""


@query("w8_convergence_generation", f"WITH {CONVERGED} SELECT * FROM conv")
def convergence_generation(spark, sf_dir):
    return select.convergence_generation(_history(spark, sf_dir), "run", "gen", "f1")


@query("a18_run_summary", f"""WITH {CONVERGED} SELECT run, max_by(f1, gen) AS final_f1, round(avg(f1), 9) AS mean_f1, count(*) AS generations,
  any_value(convergence_generation) AS convergence_generation FROM h JOIN conv USING (run) GROUP BY run""")
def run_summary(spark, sf_dir):
    return rounded(select.run_summary(_history(spark, sf_dir), "run", "gen", "f1"))


@query("w9_improvement_streak", f"""WITH {HISTORY}, a AS (SELECT *, row_number() OVER w AS pos, max(f1) OVER (PARTITION BY run ORDER BY gen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
    FROM h WINDOW w AS (PARTITION BY run ORDER BY gen)),
  b AS (SELECT *, max(CASE WHEN prev IS NULL OR f1 > prev THEN pos END) OVER (PARTITION BY run ORDER BY gen) AS rise FROM a)
  SELECT run, gen, f1, pos - rise AS streak, pos - rise >= 10 AS stop FROM b""")
def improvement_streak(spark, sf_dir):
    return select.improvement_streak(_history(spark, sf_dir), "run", "gen", "f1", 10)


@query("j5_pareto_front", """SELECT l_extendedprice, l_quantity, l_orderkey FROM (SELECT *, max(l_extendedprice) OVER (PARTITION BY l_quantity) AS best,
    max(l_extendedprice) OVER (ORDER BY l_quantity RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cheaper FROM lineitem)
  WHERE l_extendedprice = best AND (cheaper IS NULL OR best > cheaper)""")
def pareto_front(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity", "l_orderkey")
    return select.pareto_front(points, "l_extendedprice", "l_quantity")


@query("j5_pareto_by_group", """SELECT p_brand, p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand
  AND b.p_retailprice >= a.p_retailprice AND b.p_size <= a.p_size AND (b.p_retailprice > a.p_retailprice OR b.p_size < a.p_size))""")
def pareto_by_group(spark, sf_dir):
    points = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size")
    return select.pareto_front(points, "p_retailprice", "p_size", ["p_brand"]).select("p_brand", "p_partkey")


@query("w10_hypervolume_reference", """SELECT p_brand, round(max_by(p_retailprice / 2000 * (100 - p_size), (p_retailprice, -p_size)), 6) AS hypervolume FROM part GROUP BY 1""")
def hypervolume_reference(spark, sf_dir):
    points = table(spark, sf_dir, "part").select("p_brand", "p_size", (F.col("p_retailprice") / 2000).alias("f1"))
    return rounded(select.hypervolume(points, "f1", "p_size", ["p_brand"]), 6)


@query("w10_hypervolume_staircase", """WITH p AS (SELECT p_brand, p_size, p_retailprice / 2000 AS f1 FROM part),
  d AS (SELECT p_brand, f1, min(p_size) OVER (PARTITION BY p_brand ORDER BY f1 DESC) AS n, coalesce(lag(f1) OVER (PARTITION BY p_brand ORDER BY f1), 0) AS prev FROM p)
  SELECT p_brand, round(sum((f1 - prev) * (100 - n)), 6) AS hypervolume FROM d GROUP BY 1""")
def hypervolume_staircase(spark, sf_dir):
    points = table(spark, sf_dir, "part").select("p_brand", "p_size", (F.col("p_retailprice") / 2000).alias("f1"))
    return rounded(select.hypervolume(points, "f1", "p_size", ["p_brand"], "staircase"), 6)


@query("a19_class_feature_stats", """SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_samp(l_quantity), 6) AS l_quantity_std,
  round(avg(l_tax), 6) AS l_tax_mean, round(stddev_samp(l_tax), 6) AS l_tax_std FROM lineitem GROUP BY 1""")
def class_feature_stats(spark, sf_dir):
    return rounded(select.class_feature_stats(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity", "l_tax"]), 6)


@query("a19_class_feature_quartiles", """SELECT l_returnflag, feature, share::DOUBLE AS share, round(CASE share WHEN 0.25 THEN a WHEN 0.5 THEN b ELSE c END, 6) AS q FROM (
  SELECT l_returnflag, feature, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c FROM (
    SELECT l_returnflag, 'l_quantity' AS feature, l_quantity AS v FROM lineitem UNION ALL SELECT l_returnflag, 'l_extendedprice', l_extendedprice FROM lineitem) GROUP BY 1, 2),
  (VALUES (0.25), (0.5), (0.75)) AS s(share)""")
def class_feature_quartiles(spark, sf_dir):
    return rounded(select.class_feature_quartiles(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"]), 6)


@query("a20_population_diversity", """WITH m AS (SELECT o_custkey, list_transform(range(8), lambda i: (o_custkey // pow(2, i)::BIGINT) % 2) AS mask, row_number() OVER () AS id FROM orders),
  g AS (SELECT count(*) AS n FROM m), b AS (SELECT unnest(range(8)) AS i, unnest(mask) AS bit FROM m),
  o AS (SELECT i, sum(bit) AS ones FROM b GROUP BY 1)
  SELECT round((SELECT sum(ones * (n - ones)) FROM o, g)::DOUBLE / (SELECT n * (n - 1) / 2 FROM g), 9) AS diversity""")
def population_diversity(spark, sf_dir):
    bits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.pmod(F.floor(F.col("o_custkey") / F.pow(F.lit(2), i)), F.lit(2)).cast("byte"))
    return rounded(select.population_diversity(table(spark, sf_dir, "orders").select(bits.alias("mask")), "mask"))
