"""Exact ranks and running totals inside groups, without one task per group.

A window partitioned by a label puts a whole class in one task. Here every group is cut
into ordered buckets, the buckets are counted first (a small aggregate), and each bucket
is ranked alone and shifted by the count of the buckets before it. The result equals the
plain window; the largest task holds one bucket of a group, not the group.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.session import bounded, parallelism, settle

def hash_key(seed: int, keys: Sequence[str]) -> Column:
    """Seeded order of rows: md5 of the seed and the key columns as text."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *parts))


def hash_digits(df: DataFrame) -> int:
    """Hex digits of the hash that name a bucket: some sixteen buckets per shuffle partition."""
    return max(2, math.ceil(math.log(16 * parallelism(df.sparkSession), 16)))


def group_key(groups: Sequence[str]) -> Column:
    """One join key for the grouping columns; a struct compares nulls as equal."""
    return F.struct(*[F.col(g) for g in groups]) if groups else F.struct(F.lit(0).alias("all"))


def _bucket_offsets(d: DataFrame) -> DataFrame:
    counts = d.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def hash_ranked(df: DataFrame, groups: Sequence[str], keys: Sequence[str], seed: int,
                rank: str = "rn") -> DataFrame:
    """Add the 1-based position of each row in its group, in seeded hash order of `keys`.

    The keys tell rows apart; see `numbered_copies` for a table without such columns.
    """
    d = df.withColumn("_g", group_key(groups)).withColumn("_h", hash_key(seed, keys))
    d = d.withColumn("_b", F.substring("_h", 1, hash_digits(df)))
    inside = Window.partitionBy("_g", "_b").orderBy("_h", *keys)
    return (d.join(_bucket_offsets(d).drop("_n"), ["_g", "_b"])
            .withColumn(rank, F.row_number().over(inside) + F.col("_before"))
            .drop("_g", "_b", "_h", "_before"))


def hash_marked(df: DataFrame, groups: Sequence[str], keys: Sequence[str], seed: int,
                quotas: DataFrame, quota: str = "quota", out: str = "taken") -> DataFrame:
    """Add whether a row is among the first `quota` rows of its group in seeded hash order.

    One row per group names the bucket that holds the cut: a bucket before it is taken whole, one after it
    not at all, and those rows are not moved. Only the buckets that hold a cut are sorted. Groups without a
    quota are not taken. The table of cuts is as small as the set of groups.
    """
    d = df.withColumn("_g", group_key(groups)).withColumn("_h", hash_key(seed, keys))
    d = d.withColumn("_b", F.substring("_h", 1, hash_digits(df)))
    wanted = quotas.select(group_key(groups).alias("_g"), F.col(quota).cast("long").alias("_q")).filter("_q > 0")
    reached = _bucket_offsets(d.select("_g", "_b")).join(bounded(wanted), "_g")
    here = F.when(F.col("_before") + F.col("_n") >= F.col("_q"),
                  F.struct(F.col("_b").alias("b"), (F.col("_q") - F.col("_before")).alias("take"), F.col("_n").alias("n")))
    cuts = reached.groupBy("_g").agg(F.min(here).alias("_cut"))  # no bucket: the quota is never reached
    looked = d.join(bounded(cuts.withColumn("_some", F.lit(True))), "_g", "left")
    edge = F.coalesce((F.col("_b") == F.col("_cut.b")) & (F.col("_cut.take") < F.col("_cut.n")), F.lit(False))
    inside = Window.partitionBy("_g", "_b").orderBy("_h", *keys)
    sorted_rows = looked.filter(edge).withColumn(out, F.row_number().over(inside) <= F.col("_cut.take"))
    whole = F.col("_some").isNotNull() & (F.col("_cut").isNull() | (F.col("_b") <= F.col("_cut.b")))
    clear = looked.filter(~edge).withColumn(out, whole)
    return clear.select(*df.columns, out).unionByName(sorted_rows.select(*df.columns, out))


def hash_take(df: DataFrame, groups: Sequence[str], keys: Sequence[str], seed: int,
              quotas: DataFrame, quota: str = "quota") -> DataFrame:
    """Keep the first `quota` rows of each group in seeded hash order."""
    return hash_marked(df, groups, keys, seed, quotas, quota, "_taken").filter("_taken").drop("_taken")


def numbered_copies(df: DataFrame, out: str = "copy", step: int = 10_000) -> DataFrame:
    """The same rows, with equal rows numbered from 0, so that all columns tell rows apart.

    Equal rows are counted before the shuffle and written out again in steps, so a row with
    very many copies takes part in many tasks.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    steps = counted.withColumn("_s", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / step))))
    many = steps.filter(F.col("_n") > step).repartition("_s", *df.columns)
    spread = steps.filter(F.col("_n") <= step).unionByName(many)
    last = F.least(F.col("_n") - 1, (F.col("_s") + 1) * step - 1)
    return spread.select(*df.columns, F.explode(F.sequence(F.col("_s") * step, last)).alias(out))


def ordered_positions(df: DataFrame, order: Sequence[Column], out: str = "position") -> DataFrame:
    """Number all rows from 1 in an order, without a task that holds them all.

    The rows are sorted over all tasks and settled; a row's number is its place in its range plus the
    rows of the ranges before. Rows equal in the order get numbers that another run may give otherwise.
    """
    spot = F.monotonically_increasing_id()
    placed = settle(df.orderBy(*order).select("*", F.shiftright(spot, 33).alias("_range"), spot.bitwiseAND((1 << 33) - 1).alias("_place")))
    spans = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row per range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return placed.join(F.broadcast(offsets), "_range").withColumn(out, F.col("_place") + F.col("_before") + 1).drop("_range", "_place", "_before")


def _as_number(df: DataFrame, order: str) -> Column:
    """The ordering column as a double; it only names the value range, ties are settled inside."""
    kind = df.schema[order].dataType
    value = F.col(order).cast("timestamp") if isinstance(kind, (T.TimestampNTZType, T.DateType)) else F.col(order)
    return value.cast("double")


def _quantiles(df: DataFrame, order: str, buckets: int | None = None) -> list[float]:
    """Finite quantiles of a column, repeated where one value spans several."""
    n = buckets or max(4, 2 * parallelism(df.sparkSession))
    shares = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(_as_number(df, order), shares, max(10000, 20 * n)).alias("p")).first()
    return [float(p) for p in (row["p"] or []) if math.isfinite(p)]


def split_points(df: DataFrame, order: str, buckets: int | None = None) -> list[float]:
    """Quantiles of a column as fixed numbers, so that every later pass cuts alike.

    Take them from the raw rows: a sketch needs no shuffle, and a range with few rows has
    few distinct values too.
    """
    return sorted(set(_quantiles(df, order, buckets)))


def with_bucket(df: DataFrame, order: str, points: Sequence[float], out: str = "_b") -> DataFrame:
    """Number of the value range a row falls in, from 0; missing values go last."""
    if not points:
        return df.withColumn(out, F.lit(0))
    splits = [-float("inf"), *points, float("inf")]
    d = df.withColumn("_v", F.coalesce(_as_number(df, order), F.lit(float("nan"))))
    cut = Bucketizer(splits=splits, inputCol="_v", outputCol=out, handleInvalid="keep")
    return cut.transform(d).drop("_v").withColumn(out, F.col(out).cast("int"))


def _with_tie_buckets(d: DataFrame, order: str, tie: str, hot: Sequence[float]) -> DataFrame:
    """Cut the rows of values that fill whole ranges again, by the column that settles ties.

    Rows of the same range with a greater value come after all of them.
    """
    value = F.coalesce(_as_number(d, order), F.lit(float("nan")))
    at_hot = value.isin(*hot)
    cuts = split_points(d.filter(at_hot), tie)
    last = len(cuts) + 1
    d = with_bucket(d, tie, cuts, "_t")
    return d.withColumn("_b", F.col("_b") * (last + 1) + F.when(at_hot, F.least("_t", F.lit(last - 1))).otherwise(last)).drop("_t")


def value_ranked(df: DataFrame, groups: Sequence[str], order: str, ties: Sequence[str],
                 rank: str = "rn", size: str | None = None,
                 points: Sequence[float] | None = None) -> DataFrame:
    """Add the 1-based position of each row in its group, ordered by a number or time column.

    `ties` settles equal values; a value that fills whole ranges is cut by the first of
    them, when that is a number. `size` names an optional column for the rows of the group.
    """
    spread = _quantiles(df, order) if points is None else list(points)
    d = with_bucket(df.withColumn("_g", group_key(groups)), order, sorted(set(spread)))
    hot = sorted(v for v, times in Counter(spread).items() if times > 1)
    if hot and ties and isinstance(df.schema[ties[0]].dataType, (T.NumericType, T.TimestampType, T.TimestampNTZType)):
        d = _with_tie_buckets(d, order, ties[0], hot)
    offsets = _bucket_offsets(d)
    if size:
        offsets = offsets.withColumn(size, F.sum("_n").over(Window.partitionBy("_g")))
    inside = Window.partitionBy("_g", "_b").orderBy(*[F.col(c).asc_nulls_last() for c in (order, *ties)])
    return (d.join(offsets.drop("_n"), ["_g", "_b"])
            .withColumn(rank, F.row_number().over(inside) + F.col("_before"))
            .drop("_g", "_b", "_before"))


def running(df: DataFrame, groups: Sequence[str], order: str, columns: Sequence[str],
            how: str = "sum", inclusive: bool = True,
            points: Sequence[float] | None = None) -> DataFrame:
    """Replace `columns` by `run_<column>`: their sum or max over the rows up to this one.

    Expects one row per (groups, order) value, so a value that fills a third of the table
    is one row by then. `inclusive=False` leaves the row itself out.
    """
    points = split_points(df, order) if points is None else points
    agg = {"sum": F.sum, "max": F.max}[how]
    d = with_bucket(df.withColumn("_g", group_key(groups)), order, points)
    totals = d.groupBy("_g", "_b").agg(*[agg(c).alias(f"_t_{c}") for c in columns])
    earlier = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    for c in columns:
        totals = totals.withColumn(f"_t_{c}", agg(f"_t_{c}").over(earlier))
    inside = (Window.partitionBy("_g", "_b").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    out = d.join(totals, ["_g", "_b"])
    for c in columns:
        near, far = agg(c).over(inside), F.col(f"_t_{c}")
        if how == "sum":
            total = F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0))
        else:
            total = F.greatest(near, far)
        out = out.withColumn(f"run_{c}", total)
    return out.drop("_g", "_b", *[f"_t_{c}" for c in columns])


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, shares: Sequence[float], out: str = "q") -> DataFrame:
    """Exact, linearly interpolated quantiles per group: columns `share` and `out`.

    Equal values are counted together, the counts are summed up in value ranges, and only
    the rows next to a wanted position remain.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    whole = counted.groupBy(*groups).agg(F.sum("n").alias("_all")).withColumn("_k", group_key(groups)).select("_k", "_all")
    places = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), ((F.col("_all") - 1) * F.lit(float(s))).alias("at"))
                                 for s in shares])).alias("_p")
    points = split_points(df, value)
    ranked = running(counted, groups, value, ["n"], points=points).withColumn("_k", group_key(groups)).join(bounded(whole), "_k")
    first = F.col("run_n") - F.col("n")
    d = ranked.select(*groups, value, F.col("run_n").alias("_end"), first.alias("_start"), places)
    low, high = F.floor("_p.at"), F.ceil("_p.at")
    on = lambda place: (place >= F.col("_start")) & (place < F.col("_end"))
    near = d.filter(on(low) | on(high)).withColumn("share", F.col("_p.share"))
    ends = near.groupBy(*groups, "share").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.first("_p.at").alias("_at"))
    return ends.select(*groups, "share", (F.col("_lo") + (F.col("_at") - F.floor("_at")) * (F.col("_hi") - F.col("_lo"))).alias(out))
