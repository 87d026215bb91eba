"""Feature rankings, run histories and Pareto fronts as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.operators.ordering import exact_quantiles, ordered_positions, running, split_points, value_ranked
from flowspark.session import bounded

# The corner the hypervolume is measured from.
REFERENCE_F1, REFERENCE_FEATURES = 0.0, 100.0
CONVERGED_SHARE = 0.95  # fixed value: share of the best F1 that counts as converged


def importance_rank(scores: DataFrame, importance: str, position: str, top: int) -> DataFrame:
    """Rank by importance, ties by column position; `selected` marks the first `top`.

    The rows are sorted over all tasks, so features may be many.
    """
    ranked = ordered_positions(scores, [F.desc(importance), F.asc(position)], "rank")
    return ranked.withColumn("rank", F.col("rank").cast("int")).withColumn("selected", F.col("rank") <= top)


def majority_features(folds: DataFrame, feature: str, fold: str, selected: str, rank: str) -> DataFrame:
    """Features chosen in at least half the folds plus one, with their mean rank."""
    needed = folds.agg(F.count_distinct(fold)).first()[0] // 2 + 1
    votes = folds.groupBy(feature).agg(F.sum(F.col(selected).cast("long")).alias("votes"), F.avg(rank).alias("mean_rank"))
    return votes.withColumn("kept", F.col("votes") >= needed)


def feature_usage(runs: DataFrame, features: str, names: Sequence[str]) -> DataFrame:
    """Runs in which each feature was chosen; zero for the ones never chosen."""
    spark = runs.sparkSession
    every = spark.createDataFrame([(n,) for n in names], "feature string")
    used = runs.select(F.explode(F.array_distinct(features)).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return every.join(used, "feature", "left").na.fill({"n": 0})


def top_features(usage: DataFrame, top: int = 10) -> DataFrame:
    """The most used features, names settle ties."""
    return usage.orderBy(F.desc("n"), "feature").limit(top)


def sweep_summary(runs: DataFrame, size: str, run: str, metric: str, feature: str) -> DataFrame:
    """Per population size: runs, mean metric, features common to its runs, and the best size.

    Expects (size, run, metric, feature) rows. The smallest size wins a tie.
    """
    scores = runs.select(size, run, metric).distinct().groupBy(size).agg(
        F.count(F.lit(1)).alias("runs"), F.avg(metric).alias("mean_f1"))
    spread = runs.select(size, run, feature).distinct().groupBy(size, feature).agg(F.count(F.lit(1)).alias("k"))
    common = spread.join(scores, size).filter("k = runs").groupBy(size).agg(
        F.array_join(F.array_sort(F.collect_list(feature)), ", ").alias("common_features"))
    best = scores.agg(F.min_by(size, F.struct(-F.col("mean_f1"), F.col(size)))).first()[0]
    return scores.join(common, size, "left").na.fill({"common_features": ""}).withColumn("best", F.col(size) == F.lit(best))


def run_summary(history: DataFrame, run: str, generation: str, metric: str) -> DataFrame:
    """Per run: final metric, its mean over generations, generations executed, convergence generation."""
    d = history.groupBy(run).agg(F.max_by(metric, generation).alias("final_f1"), F.avg(metric).alias("mean_f1"),
                                 F.count(F.lit(1)).alias("generations"))
    return d.join(convergence_generation(history, run, generation, metric), run)


def convergence_generation(history: DataFrame, run: str, generation: str, metric: str) -> DataFrame:
    """First generation (1-based) at 95 % of the run's best; the run's length when the best is not positive."""
    best = history.groupBy(run).agg(F.max(metric).alias("_best"), F.count(F.lit(1)).alias("_len"))
    ranked = value_ranked(history, [run], generation, [metric], rank="_at")
    reached = F.when((F.col("_best") > 0) & (F.col(metric) >= CONVERGED_SHARE * F.col("_best")), F.col("_at"))
    return ranked.join(bounded(best), run).groupBy(run).agg(
        F.coalesce(F.min(reached), F.first("_len")).cast("long").alias("convergence_generation"))


def improvement_streak(history: DataFrame, run: str, generation: str, metric: str, patience: int = 10) -> DataFrame:
    """Generations since the best last rose, per row, and whether the patience is used up."""
    points = split_points(history, generation)
    ranked = value_ranked(history, [run], generation, [], rank="at", points=points)
    seen = running(ranked, [run], generation, [metric], "max", inclusive=False, points=points)
    better = F.col(f"run_{metric}").isNull() | (F.col(metric) > F.col(f"run_{metric}"))
    marked = seen.withColumn("rise", F.when(better, F.col("at")))
    last = running(marked, [run], generation, ["rise"], "max", points=points)
    return (last.withColumn("streak", (F.col("at") - F.col("run_rise")).cast("long"))
            .withColumn("stop", F.col("streak") >= patience).select(*history.columns, "streak", "stop"))


def pareto_front(points: DataFrame, gain: str, cost: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows no other row beats on both a higher gain and a lower cost; equal rows all stay.

    Only the best gain per cost can be on the front, so one small row per cost remains
    before anything is ordered.
    """
    best = points.groupBy(*by, cost).agg(F.max(gain).alias("_best"))
    cheaper = running(best, by, cost, ["_best"], "max", inclusive=False, points=split_points(points, cost))
    edge = cheaper.filter(F.col("run__best").isNull() | (F.col("_best") > F.col("run__best"))).select(*by, cost, "_best")
    keys = [*by, cost]
    return points.join(bounded(edge), keys).filter(F.col(gain) == F.col("_best")).select(*points.columns)


def hypervolume(points: DataFrame, gain: str, cost: str, by: Sequence[str] = (), mode: str = "reference") -> DataFrame:
    """Area under a front from the corner (0, 100 features).

    `reference` counts the rectangle of the highest gain only; `staircase` the true area.
    """
    room = F.lit(REFERENCE_FEATURES) - F.col(cost)
    if mode == "reference":
        top = points.groupBy(*by).agg(F.max_by(F.struct(F.col(gain).alias("g"), room.alias("r")),
                                               F.struct(F.col(gain), -F.col(cost))).alias("t"))
        g, r = F.col("t.g") - REFERENCE_F1, F.col("t.r")
        return top.select(*by, F.when((g > 0) & (r > 0), g * r).otherwise(0.0).alias("hypervolume"))
    if mode != "staircase":
        raise ValueError(f"unknown mode {mode!r}")
    front = pareto_front(points, gain, cost, by).select(*by, gain, cost).distinct()
    # One row per cost value at most is on a front, so this window is short.
    before = F.lag(gain, 1, REFERENCE_F1).over(Window.partitionBy(*by).orderBy(gain))
    step = (F.col(gain) - F.greatest(before, F.lit(REFERENCE_F1))) * room
    d = front.withColumn("_step", F.when((F.col(gain) > REFERENCE_F1) & (room > 0), step).otherwise(0.0))
    return d.groupBy(*by).agg(F.sum("_step").alias("hypervolume"))


def class_feature_stats(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of each feature's present values per class, as `f_mean` and `f_std`."""
    stats = []
    for f in features:
        present = F.when(~F.isnan(F.col(f).cast("double")), F.col(f))
        stats += [F.avg(present).alias(f"{f}_mean"), F.stddev_samp(present).alias(f"{f}_std")]
    return df.groupBy(label).agg(*stats)


def class_feature_quartiles(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Quartiles of each feature's present values per class, exact."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("e")
    long = df.select(label, cells).select(label, "e.feature", "e.value").where("not isnan(value)")
    return exact_quantiles(long, [label, "feature"], "value", [0.25, 0.5, 0.75])


def population_diversity(masks: DataFrame, mask: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean number of differing positions over all pairs of equal-length masks.

    Ones times zeros per position counts the differing pairs, so no pair is formed.
    """
    genes = masks.select(*by, F.size(mask).alias("_len"), F.posexplode_outer(mask).alias("_pos", "_bit"))
    ones = genes.groupBy(*by, "_len", "_pos").agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(F.col("_bit").cast("long")), F.lit(0)).alias("_ones"))
    sizes = ones.groupBy(*by, "_len").agg(F.max("_n").alias("_n"), F.sum(F.col("_ones") * (F.col("_n") - F.col("_ones"))).alias("_apart"))
    d = sizes.withColumn("_pairs", F.col("_n") * (F.col("_n") - 1) / 2)
    total = F.coalesce(F.try_divide(F.sum("_apart").cast("double"), F.sum("_pairs")), F.lit(0.0))
    return d.groupBy(*by).agg(total.alias("diversity"))
