"""Grids, plans, cached work, rules and result reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.catalog.base import predictions, query, table
from flowspark.catalog.evaluation import class_sql, rounded
from flowspark.operators import compare, grid, rules
from flowspark.plans import reports
from flowspark.sources import results


@query("j1_selection_gain", """WITH b AS (SELECT o_custkey AS model, o_orderpriority AS dataset, max(o_totalprice) AS f1 FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
  s AS (SELECT o_custkey AS model, o_orderpriority AS dataset, o_totalprice AS selected, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS rn
    FROM orders WHERE o_orderstatus <> 'F')
  SELECT model, dataset, f1 AS baseline, selected, round((selected - f1) / f1 * 100, 6) AS improvement FROM b JOIN s USING (model, dataset) WHERE rn = 1""")
def selection_gain(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("model"), F.col("o_orderpriority").alias("dataset"),
                                                    F.col("o_totalprice").alias("f1"), "o_orderkey", "o_orderstatus")
    base = orders.filter("o_orderstatus = 'F'").groupBy("model", "dataset").agg(F.max("f1").alias("f1"))
    out = compare.selection_gain(base, orders.filter("o_orderstatus <> 'F'"), first_by="o_orderkey")
    return out.withColumn("improvement", F.round("improvement", 6))


CACHE = """grid AS (SELECT DISTINCT l_suppkey AS dataset, CASE WHEN l_linenumber < 7 THEN l_linenumber END AS variant, l_returnflag AS model FROM lineitem),
  cache AS (SELECT DISTINCT l_suppkey AS dataset, CASE WHEN l_linenumber < 7 THEN l_linenumber END AS variant, l_returnflag AS model FROM lineitem WHERE l_quantity > 40 AND l_discount > 0.05)"""


def _grid_and_cache(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = lambda d: d.select(F.col("l_suppkey").alias("dataset"), F.when(F.col("l_linenumber") < 7, F.col("l_linenumber")).alias("variant"),
                              F.col("l_returnflag").alias("model")).distinct()
    return rows(li), rows(li.filter("l_quantity > 40 AND l_discount > 0.05D"))


@query("j2_skip_cached", f"""WITH {CACHE} SELECT * FROM grid g WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.dataset = g.dataset
  AND c.variant IS NOT DISTINCT FROM g.variant AND c.model = g.model)""")
def skip_cached(spark, sf_dir):
    todo, cache = _grid_and_cache(spark, sf_dir)
    return grid.skip_cached(todo, cache, ["dataset", "variant", "model"])


@query("j2_cache_report", f"""WITH {CACHE}, m AS (SELECT g.*, EXISTS (SELECT 1 FROM cache c WHERE c.dataset = g.dataset AND c.variant IS NOT DISTINCT FROM g.variant
  AND c.model = g.model) AS done FROM grid g) SELECT model, count(*) FILTER (done) AS skipped, count(*) FILTER (NOT done) AS remaining FROM m GROUP BY 1""")
def cache_report(spark, sf_dir):
    todo, cache = _grid_and_cache(spark, sf_dir)
    return grid.cache_report(todo, cache, ["dataset", "variant", "model"], ["model"])


@query("j3_pending_files", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
  GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 3)""")
def pending_files(spark, sf_dir):
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    files = table(spark, sf_dir, "customer").select("c_custkey")
    return grid.pending_files(files, done, "c_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("j7_scaffold", """WITH f AS (SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
  SELECT a.o_custkey, b.o_orderstatus, c.o_orderpriority, n FROM (SELECT DISTINCT o_custkey FROM f) a CROSS JOIN (SELECT DISTINCT o_orderstatus FROM f) b
  CROSS JOIN (SELECT DISTINCT o_orderpriority FROM f) c LEFT JOIN f USING (o_custkey, o_orderstatus, o_orderpriority)""")
def scaffold(spark, sf_dir):
    dims = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    facts = table(spark, sf_dir, "orders").groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))
    return grid.scaffold(facts, dims)


@query("j7_plan_results", """WITH clf AS (SELECT DISTINCT o_orderpriority AS c FROM orders), st AS (SELECT DISTINCT o_orderstatus AS f FROM orders),
  r AS (SELECT o_orderpriority AS c, o_orderstatus AS f, count(*) AS n FROM orders GROUP BY 1, 2),
  p AS (SELECT f, h, a, c, k.i AS ai FROM st CROSS JOIN (VALUES (false), (true)) h(h) CROSS JOIN (VALUES (0, NULL), (1, 0.25::DOUBLE), (2, 1.0::DOUBLE)) k(i, a) CROSS JOIN clf)
  SELECT row_number() OVER (ORDER BY ai, f, h, c)::INTEGER AS id, f AS feature_set, h AS optimized, a AS augmentation_ratio, c AS classifier, n AS results
  FROM p LEFT JOIN r USING (f, c)""")
def plan_results(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    names = lambda c: sorted(r[0] for r in orders.select(c).distinct().collect())
    plan = grid.evaluation_plan(spark, names("o_orderstatus"), [False, True], [None, 0.25, 1.0], names("o_orderpriority"))
    done = orders.groupBy(F.col("o_orderstatus").alias("feature_set"), F.col("o_orderpriority").alias("classifier")).agg(F.count(F.lit(1)).alias("results"))
    return plan.join(done, ["feature_set", "classifier"], "left")


@query("j7_valid_parameters", """WITH v AS (SELECT l_suppkey, CASE l_linenumber % 3 WHEN 0 THEN 'l1' WHEN 1 THEN 'l2' ELSE 'elasticnet' END AS penalty,
    CASE WHEN l_returnflag = 'A' THEN 'lbfgs' ELSE 'saga' END AS solver, CASE WHEN l_quantity > 25 THEN 0.5 ELSE 0.0 END AS l1_ratio FROM lineitem)
  SELECT penalty, solver, l1_ratio::DOUBLE AS l1_ratio, count(*) AS n FROM v WHERE NOT (solver = 'lbfgs' AND penalty IN ('l1', 'elasticnet'))
    AND NOT (l1_ratio <> 0 AND penalty <> 'elasticnet') GROUP BY ALL""")
def valid_parameters(spark, sf_dir):
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    kind = F.col("l_linenumber") % 3
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit("Logistic Regression").alias("model"), F.when(kind == 0, "l1").when(kind == 1, "l2").otherwise("elasticnet").alias("penalty"),
        F.when(F.col("l_returnflag") == "A", "lbfgs").otherwise("saga").alias("solver"), F.when(F.col("l_quantity") > 25, 0.5).otherwise(0.0).alias("l1_ratio"))
    rows = rows.withColumn("params", F.create_map(F.lit("penalty"), text(F.col("penalty")), F.lit("solver"), text(F.col("solver")),
                                                  F.lit("l1_ratio"), F.col("l1_ratio").cast("string")))
    return rows.filter(grid.valid_combination()).groupBy("penalty", "solver", "l1_ratio").agg(F.count(F.lit(1)).alias("n"))


@query("o1_leaderboard", """SELECT o_orderpriority AS dataset, 'LOW ' || o_orderstatus AS model, max(o_totalprice) AS f1 FROM orders GROUP BY 1, 2""")
def leaderboard(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("dataset"), "o_orderstatus").agg(F.max("o_totalprice").alias("f1"))
    named = rows.select("dataset", F.concat(F.lit("LOW_"), "o_orderstatus", F.lit(" - x"), "dataset").alias("model"), "f1")
    return reports.leaderboard(named)


@query("o2_best_configuration", """SELECT o_custkey, o_orderpriority, f1, elapsed, o_orderkey FROM (SELECT o_custkey, o_orderpriority, floor(o_totalprice / 10000)::BIGINT AS f1,
    o_orderkey % 7 AS elapsed, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY floor(o_totalprice / 10000) DESC, o_orderkey % 7, o_orderkey) AS rn
    FROM orders) WHERE rn = 1""")
def best_configuration(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.floor(F.col("o_totalprice") / 10000).alias("f1"),
                                                  (F.col("o_orderkey") % 7).alias("elapsed"), "o_orderkey")
    return grid.best_configuration(rows, ["o_custkey", "o_orderpriority"], "f1", "elapsed", "o_orderkey")


@query("o3_best_first", """SELECT dataset, dataset_path, run_index, row_number() OVER (ORDER BY dataset, dataset_path, place)::INTEGER AS position FROM (
  SELECT o_orderpriority AS dataset, o_custkey AS dataset_path, CASE WHEN k = 0 THEN 'best' WHEN k = 6 THEN 'x' ELSE (k * 2)::VARCHAR END AS run_index,
    CASE WHEN k = 0 THEN -1 WHEN k = 6 THEN 1e9 ELSE k * 2 END AS place FROM (SELECT DISTINCT o_orderpriority, o_custkey, o_orderkey % 7 AS k FROM orders))""")
def best_first(spark, sf_dir):
    k = F.col("o_orderkey") % 7
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("dataset"), F.col("o_custkey").alias("dataset_path"),
        F.when(k == 0, "best").when(k == 6, "x").otherwise((k * 2).cast("string")).alias("run_index")).distinct()
    return results.best_first(rows, "position").withColumn("position", F.col("position").cast("int"))


def _vocabulary():
    return rules.Vocabulary({
        "l_returnflag": {"A": ["accepted"], "N": ["none"], "R": ["returned"]},
        "l_linestatus": {"F": ["finished"], "O": ["open"]},
    }, {"flag": "l_returnflag", "state": "l_linestatus"}, ["l_linenumber"])


RULE_TEXTS = ["accepted & open || flag=returned & 3", "none & l_linenumber=2 || finished & 5", "returned"]
RULE_SQL = ["(l_returnflag = 'A' AND l_linestatus = 'O') OR (l_returnflag = 'R' AND l_linenumber = 3)",
            "(l_returnflag = 'N' AND l_linenumber = 2) OR (l_linestatus = 'F' AND l_linenumber = 5)", "l_returnflag = 'R'"]


@query("x4_rule_filter", f"""SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem
  WHERE (({RULE_SQL[0]}) OR ({RULE_SQL[1]})) AND NOT ({RULE_SQL[2]} AND l_linestatus = 'F') GROUP BY ALL""")
def rule_filter(spark, sf_dir):
    v = _vocabulary()
    kept = rules.apply_rules(table(spark, sf_dir, "lineitem"), [v.rule(t) for t in RULE_TEXTS[:2]], [v.rule("returned & finished")])
    return kept.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("x4_rule_matches", " UNION ALL ".join(
    f"SELECT {i + 1}::INTEGER AS rule, '{t}' AS text, count(*) FILTER ({s}) AS matches FROM lineitem"
    for i, (t, s) in enumerate(zip(["A&O||R&3", "N&2||F&5", "R"], RULE_SQL))))
def rule_matches(spark, sf_dir):
    v = _vocabulary()
    return rules.rule_matches(table(spark, sf_dir, "lineitem"), [v.rule(t) for t in RULE_TEXTS])


@query("x4_rule_table", """SELECT rule, count(*) AS n FROM (
  SELECT 1 AS rule FROM orders WHERE (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') OR o_orderpriority = '5-LOW'
  UNION ALL SELECT 2 FROM orders WHERE o_orderstatus = 'P') GROUP BY 1""")
def rule_table(spark, sf_dir):
    v = rules.Vocabulary({"o_orderstatus": {s: [] for s in "FOP"}, "o_orderpriority": {"1-URGENT": ["urgent"], "5-LOW": ["low"]}})
    orders = table(spark, sf_dir, "orders")
    listed = rules.rule_table([v.rule("F & urgent || low"), v.rule("P")], orders)
    hits = rules.match_rule_table(orders, "o_orderkey", ["o_orderstatus", "o_orderpriority"], listed)
    return hits.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("e1_evaluation_report", f"""WITH {class_sql(by='fold')} SELECT fold, class AS "Class", tp AS "TP", fn AS "FN", fp AS "FP", tn AS "TN", sup AS "Support", round(acc, 9) AS "Accuracy",
    round(prec, 9) AS "Precision", round(rec, 9) AS "Recall", round(f1, 9) AS "F1" FROM per
  UNION ALL SELECT fold, 'Average', NULL, NULL, NULL, NULL, sum(sup)::BIGINT, round(sum(tp) / sum(sup), 9), round(sum(prec * sup) / sum(sup), 9),
    round(sum(rec * sup) / sum(sup), 9), round(sum(f1 * sup) / sum(sup), 9) FROM per GROUP BY fold""")
def evaluation_report(spark, sf_dir):
    return rounded(reports.evaluation_report(predictions(spark, sf_dir), "y", "yhat", ["fold"]))
