"""Streams over landed files, run until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.catalog.base import query, table
from flowspark.catalog.evaluation import rounded
from flowspark.catalog.learning import ORDER_FEATURES, lineitem_features
from flowspark.operators.metrics import score
from flowspark.plans import models
from flowspark.session import scratch_path
from flowspark.streaming import jobs, windows


FILES = 4  # files of a micro-batch


def _landed(spark, *parts):
    """Tables that land one after the other, each as several files that make one micro-batch, read back as a stream."""
    folder = scratch_path(spark, "landing")
    for df in parts:
        df.repartition(FILES).write.mode("append").parquet(folder)
    return jobs.landing(spark, folder, spark.read.parquet(folder).schema, files=FILES)


def _dirty_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", "user_id", "event_type", F.when(F.col("value") >= 1, F.col("value")).alias("low"),
                         F.when(F.col("value") > 90, F.lit(float("inf"))).when(F.col("value") < 2, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))


DIRTY_EVENTS = """d AS (SELECT event_id, user_id, event_type, CASE WHEN value >= 1 THEN value END AS low, value > 90 AS endless, value < 2 AS absent, value AS raw FROM events)"""


@query("t1_incremental_profile", f"""WITH {DIRTY_EVENTS}, c AS (SELECT event_type, count(*) AS k FROM d WHERE NOT absent AND NOT endless GROUP BY 1)
  SELECT (SELECT sum(k) FROM c)::BIGINT AS samples, 5::BIGINT AS features, count(*) AS original_num_rows, count(*) FILTER (absent) AS removed_rows_nan,
    count(*) FILTER (endless AND NOT absent) AS removed_rows_inf, (SELECT string_agg(event_type || ': ' || k || ' (' || printf('%.2f', k / (SELECT sum(k) FROM c) * 100) || '%)', ', '
      ORDER BY k DESC, event_type) FROM c) AS classes,
    CASE WHEN count(*) FILTER (low IS NULL) > 0 THEN 'low (' || count(*) FILTER (low IS NULL) || '), ' ELSE '' END || 'value (' || count(*) FILTER (absent) || ')' AS missing_values
  FROM d""")
def incremental_profile(spark, sf_dir):
    df = _dirty_events(spark, sf_dir)
    state = scratch_path(spark, "state")
    jobs.keep_profile(_landed(spark, *[df.where(F.col("event_id") % 3 == i) for i in range(3)]), "event_type", state)
    return jobs.current_profile(spark, state, df, "event_type").select(
        "samples", "features", "original_num_rows", "removed_rows_nan", "removed_rows_inf", "classes", "missing_values")


@query("t1_approximate_profile", """SELECT true AS distinct_close, true AS median_close, c AS "column" FROM (VALUES ('event_id'), ('user_id'), ('value')) t(c)""")
def approximate_profile(spark, sf_dir):
    """Sketches of a stream against exact figures of the table: distinct counts within 3 %, medians within 2 % of rank."""
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type")
    state = scratch_path(spark, "state")
    jobs.keep_profile(_landed(spark, *[df.where(F.col("event_id") % 3 == i) for i in range(3)]), "event_type", state, sketches=True)
    names = ["event_id", "user_id", "value"]
    found = {r["column"]: r for r in jobs.current_approximations(spark, state, df).where(F.col("column").isin(names)).collect()}  # a row per column
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in names], *[F.avg((F.col(c) <= found[c]["quantiles"][1]).cast("int")).alias(f"rank_{c}") for c in names])
    rows = [exact.select(F.lit(c).alias("column"), (F.abs(F.col(c) / found[c]["distinct"] - 1) < 0.03).alias("distinct_close"),
                         (F.abs(F.col(f"rank_{c}") - 0.5) < 0.02).alias("median_close")) for c in names]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("t2_clean_stream", f"WITH {DIRTY_EVENTS} SELECT event_id, event_type, raw AS value FROM d WHERE NOT absent AND NOT endless")
def clean_stream(spark, sf_dir):
    cleaned = jobs.clean_stream(_landed(spark, _dirty_events(spark, sf_dir)), ["event_id", "event_type", "value"], in_range=True)
    return jobs.run_to_files(cleaned, scratch_path(spark, "clean"))


def _timed(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id")


def _in_order(spark, df, by):
    """The table in three parts, by ranges of a column."""
    low, high = df.approxQuantile(by, [0.33, 0.66], 0.01)
    return [df.filter(F.col(by) <= low), df.filter((F.col(by) > low) & (F.col(by) <= high)), df.filter(F.col(by) > high)]


def _days(spark, sf_dir):
    """events in three parts by time, the last of them still within its windows."""
    timed = _timed(spark, sf_dir).withColumn("_s", F.unix_timestamp("ts"))
    return [d.drop("_s") for d in _in_order(spark, timed, "_s")]


def _named(out):
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start", "end")})


@query("t3_tumbling_counts", """SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(s + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS end, event_type, n
  FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS s, event_type, count(*) AS n FROM events GROUP BY 1, 2)""")
def tumbling_counts(spark, sf_dir):
    return _named(jobs.keep_class_counts(_landed(spark, *_days(spark, sf_dir)), scratch_path(spark, "windows"), "ts", "event_type", "6 hours"))


@query("t3_sliding_counts", """SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(s + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS end, event_type, n
  FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS s, event_type, count(*) AS n FROM events, range(2) r(k) GROUP BY 1, 2)""")
def sliding_counts(spark, sf_dir):
    return _named(jobs.keep_class_counts(_landed(spark, *_days(spark, sf_dir)), scratch_path(spark, "windows"), "ts", "event_type", "12 hours", "6 hours"))


@query("t3_late_rows", """WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS passed FROM events WHERE event_id % 50 > 1)
  SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(s + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS end, event_type, count(*) AS n
  FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS s, event_type, event_id FROM events), m WHERE event_id % 50 <> 0 OR s + INTERVAL 6 HOUR > passed GROUP BY ALL""")
def late_rows(spark, sf_dir):
    """Every fiftieth event lands two batches behind the others; those of windows that are over are dropped."""
    timed = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id")
    stream = _landed(spark, *[timed.where(f"event_id % 50 {part}") for part in ("> 1", "= 1", "= 0")])
    return _named(jobs.keep_class_counts(stream, scratch_path(spark, "windows"), "ts", "event_type", "6 hours"))


@query("t3_session_counts", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
  a AS (SELECT user_id, sid, min(ts) AS s, max(ts) + INTERVAL 8 HOUR AS e, count(*) AS n FROM s GROUP BY 1, 2)
  SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(e, '%Y-%m-%d %H:%M:%S') AS end, user_id, n FROM a""")
def session_counts(spark, sf_dir):
    return _named(jobs.keep_sessions(_landed(spark, *_days(spark, sf_dir)), scratch_path(spark, "sessions"), "ts", ["user_id"], "8 hours"))


@query("t4_stream_row_windows", """WITH r AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n,
    last_value(event_type) OVER f AS label, list(event_type) OVER f AS labels, sum(value) OVER f AS total
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id), f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
  SELECT user_id, pos AS start, label, len(list_distinct(labels)) > 1 AS mixed, round(total, 6) AS total FROM r WHERE n >= 10 AND pos % 3 = 0 AND pos + 8 <= n""")
def stream_row_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")
    stream = _landed(spark, *_in_order(spark, events, "event_id"))
    out = windows.keep_row_windows(stream, scratch_path(spark, "rowwindows"), "user_id", "event_id", [], ["value"], "event_type", 8, 3, 10)
    total = F.aggregate("features", F.lit(0.0), lambda a, r: a + r[0])
    return out.select("user_id", "start", "label", "mixed", F.round(total, 6).alias("total"))


@query("t5_score_stream")
def score_stream(spark, sf_dir):
    df = lineitem_features(spark, sf_dir).withColumn("y", F.col("label").cast("double"))
    path = scratch_path(spark, "model")
    models.pipeline(ORDER_FEATURES, models.logistic(rounds=20)).fit(df).write().overwrite().save(path)
    scored = jobs.run_to_files(jobs.score_stream(_landed(spark, df), path, ["l_orderkey", "y"]), scratch_path(spark, "scored"))
    return rounded(score(scored, "y", "prediction"))


