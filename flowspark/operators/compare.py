"""Feature sets against each other, result rows against each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.operators.ordering import ordered_positions
from flowspark.session import bounded


def feature_coverage(names: DataFrame, file: str, feature: str) -> DataFrame:
    """Per file: the features all files share, its own extras, and whether all headers match.

    Names are trimmed and lowered. The counts per feature are small (one row per name).
    """
    d = names.select(F.col(file).alias("file"), F.lower(F.trim(feature)).alias("feature")).distinct()
    files = d.agg(F.count_distinct("file")).first()[0]
    spread = d.groupBy("feature").agg(F.count(F.lit(1)).alias("n_files")).withColumn("common", F.col("n_files") == files)
    alike = spread.where("not common").isEmpty()
    marked = d.join(spread.select("feature", "common"), "feature")
    listed = lambda flag: F.array_join(F.array_sort(F.collect_list(F.when(flag, F.col("feature")))), ", ")
    out = marked.groupBy("file").agg(listed(F.col("common")).alias("common"), listed(~F.col("common")).alias("extra"))
    return out.withColumn("headers_match_all", F.lit(alike))


def feature_spread(names: DataFrame, file: str, feature: str) -> DataFrame:
    """How many files hold each feature."""
    return (names.select(F.col(file).alias("file"), F.lower(F.trim(feature)).alias("feature")).distinct()
            .groupBy("feature").agg(F.count(F.lit(1)).alias("n_files")))


def group_pairs(names: DataFrame, group: str, feature: str, file: str | None = None) -> DataFrame:
    """For each unordered pair of groups: shared features and the extras of either side.

    Only numbers of groups travel with a pair, and how many features it shares is counted over the index from feature to
    groups; a group's feature list, an array as small as a schema, is looked up when the texts are made.
    """
    d = names.select(F.col(group).alias("g"), F.col(feature).alias("f"), (F.col(file) if file else F.col(group)).alias("src"))
    sets = d.groupBy("g").agg(F.array_sort(F.collect_set("f")).alias("fs"), F.count_distinct("src").alias("files"))
    numbered = ordered_positions(sets.where("g is not null"), [F.asc("g")], "i")
    index = d.where("f is not null").select("g", "f").distinct().join(numbered.select("g", "i"), "g").select("f", "i")
    shared = (index.join(index.select("f", F.col("i").alias("j")), "f").where("j > i")
              .groupBy("i", "j").agg(F.count(F.lit(1)).alias("n_common")))
    every = numbered.select(F.explode(F.sequence(F.lit(1), F.col("i"))).alias("i"), F.col("i").alias("j")).where("i < j")  # a row per pair is the report
    pairs = every.join(shared, ["i", "j"], "left").na.fill({"n_common": 0})
    side = lambda at, end: bounded(numbered.select(F.col("i").alias(at), *[F.col(c).alias(f"{c}_{end}") for c in ("g", "fs", "files")]))
    full = pairs.join(side("i", "a"), "i").join(side("j", "b"), "j")
    text = lambda a: F.coalesce(F.nullif(F.array_join(F.array_sort(a), ", "), F.lit("")), F.lit("None"))
    extra = lambda end: (F.size(f"fs_{end}") - F.col("n_common")).cast("long").alias(f"n_extra_{end}")
    return full.select(
        F.col("g_a").alias("dataset_a"), F.col("g_b").alias("dataset_b"),
        F.col("files_a").alias("files_in_a"), F.col("files_b").alias("files_in_b"),
        "n_common", text(F.array_intersect("fs_a", "fs_b")).alias("common_features"),
        extra("a"), text(F.array_except("fs_a", "fs_b")).alias("extra_features_a"),
        extra("b"), text(F.array_except("fs_b", "fs_a")).alias("extra_features_b"))


def pairs_seen_from(pairs: DataFrame, group: object) -> DataFrame:
    """The pair report with `group` always on side A; other rows unchanged."""
    turn = F.col("dataset_b") == F.lit(group)
    swap = {"dataset_a": "dataset_b", "files_in_a": "files_in_b", "n_extra_a": "n_extra_b", "extra_features_a": "extra_features_b"}
    back = {v: k for k, v in swap.items()}
    other = {**swap, **back}
    return pairs.select(*[F.when(turn, F.col(other[c])).otherwise(F.col(c)).alias(c) if c in other else F.col(c)
                          for c in pairs.columns])


def run_feature_sets(runs: DataFrame, run: str, feature: str) -> DataFrame:
    """Per run: features shared by all runs, features of this run alone, and the union."""
    d = runs.select(F.col(run).alias("run"), F.col(feature).alias("feature")).distinct()
    total = d.agg(F.count_distinct("run")).first()[0]
    spread = d.groupBy("feature").agg(F.count(F.lit(1)).alias("k"))
    kinds = spread.withColumn("all", F.col("k") == total)
    out = d.join(kinds, "feature").groupBy("run").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("all"), F.col("feature")))), ", ").alias("common_features"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") == 1, F.col("feature")))), ", ").alias("unique_features"))
    union = spread.agg(F.array_join(F.array_sort(F.collect_list("feature")), ", ")).first()[0]  # as short as a schema
    return out.withColumn("union_features", F.lit(union))


def selection_gain(baseline: DataFrame, selected: DataFrame, keys: Sequence[str] = ("model", "dataset"), metric: str = "f1",
                   first_by: str = "position") -> DataFrame:
    """Baseline joined to the first selected row of its keys, with the gain in percent.

    The gain is 0 where the baseline is 0. `first_by` orders the selected rows.
    """
    first = selected.groupBy(*keys).agg(F.min_by(metric, first_by).alias("selected"))
    base = F.col("baseline")
    gain = F.when(base == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("selected") - base, base) * 100)
    return (baseline.select(*keys, F.col(metric).alias("baseline")).join(first, list(keys), "inner")
            .withColumn("improvement", gain))
