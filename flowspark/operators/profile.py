"""Dataset profiles: one pass makes a small mergeable state, everything else reads the state."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.names import numeric_columns, text_columns
from flowspark.operators.clean import any_infinite, any_missing, missing

# Columns of the preprocessing summary, in report order.
SUMMARY_COLUMNS = (
    "filename", "original_num_rows", "rows_after_nan_inf_removal", "removed_rows_nan_inf",
    "removed_rows_nan_inf_proportion", "rows_after_preprocessing", "removed_rows", "removed_rows_proportion",
    "original_num_features", "features_after_zero_variance_removal", "removed_zero_variance_features",
    "removed_zero_variance_features_proportion", "features_after_preprocessing", "removed_features",
    "removed_features_proportion", "dropped_non_informative_features", "dropped_non_informative_features_proportion",
    "features_transformed_for_experiment", "features_transformed_for_experiment_proportion",
    "features_cast_to_float64_int64", "features_encoded_categorical",
)


HLL_BITS = 14  # of the register index of a count of distinct values: some 0.8 % error
KLL_SIZE = 800  # items a quantile sketch keeps per level: some 0.5 % of rank


def profile_aggregates(df: DataFrame, sketches: bool = False) -> list[Column]:
    """The aggregates of a profile state: sums, minima and maxima, and sketches if wanted, so they merge.

    They read the row flags `_present` and `_clean`.
    """
    aggregates = [F.count(F.lit(1)).alias("rows"), F.count_if("_present").alias("rows_present"),
                  F.count_if("_clean").alias("rows_clean")]
    for i, c in enumerate(df.columns):
        aggregates.append(F.count_if(missing(df, c)).alias(f"miss_{i}"))
        if c in numeric_columns(df):
            value = F.when(F.col("_clean"), F.col(f"`{c}`"))
            aggregates += [F.min(value).alias(f"low_{i}"), F.max(value).alias(f"high_{i}")]
        if sketches:
            text = F.when(F.col("_clean"), F.col(f"`{c}`").cast("string"))
            aggregates.append(F.hll_sketch_agg(text, HLL_BITS).alias(f"hll_{i}"))
            if c in numeric_columns(df):
                number = F.when(F.col("_clean"), F.col(f"`{c}`").cast("double"))
                aggregates.append(F.kll_sketch_agg_double(number, KLL_SIZE).alias(f"kll_{i}"))
    return aggregates


def profile_state(df: DataFrame, label: str, by: Sequence[str] = (), sketches: bool = False) -> DataFrame:
    """One row per (by, class) with all a profile needs. The grouping columns are not features.

    With `sketches` the state also holds, for clean rows, a sketch of distinct values per column and one of quantiles per
    number column, each of a size that does not follow the rows.
    """
    features = df.drop(*by)
    present = ~any_missing(features)
    return (df.withColumns({"_class": F.col(f"`{label}`").cast("string"), "_present": present, "_clean": present & ~any_infinite(features)})
            .groupBy(*by, "_class").agg(*profile_aggregates(features, sketches)))


def merge_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add up states of chunks, files or days; equal to the state of the whole."""
    keys = [*by, "_class"]
    merged = []
    for c in states.columns:
        if c in keys or c not in states.columns:
            continue
        if c.startswith("low_"):
            merged.append(F.min(c).alias(c))
        elif c.startswith("high_"):
            merged.append(F.max(c).alias(c))
        elif c.startswith(("rows", "miss_")):
            merged.append(F.sum(c).alias(c))
        elif c.startswith("hll_"):
            merged.append(F.hll_union_agg(c).alias(c))
        elif c.startswith("kll_"):
            merged.append(F.kll_merge_agg_double(c).alias(c))
    return states.groupBy(*keys).agg(*merged)


def approximate_table(state: DataFrame, df: DataFrame, by: Sequence[str] = (), shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(by, column, distinct, quantiles) of a state with sketches, merged over classes, chunks, files or micro-batches.

    `distinct` estimates the different values of the clean rows, `quantiles` their values at `shares`; null for a column that is
    no number.
    """
    features = df.drop(*by)
    names, numeric = features.columns, numeric_columns(features)
    merged = state.groupBy(*by).agg(*[F.hll_union_agg(f"hll_{i}").alias(f"hll_{i}") for i in range(len(names))],
                                    *[F.kll_merge_agg_double(f"kll_{i}").alias(f"kll_{i}") for i, c in enumerate(names) if c in numeric])
    at = F.array(*[F.lit(float(s)) for s in shares])

    def quantiles(i: int, c: str) -> Column:
        if c not in numeric:
            return F.lit(None).cast("array<double>")
        return F.when(F.kll_sketch_get_n_double(f"kll_{i}") > 0, F.kll_sketch_get_quantile_double(f"kll_{i}", at))

    cells = [F.struct(F.lit(c).alias("column"), F.hll_sketch_estimate(f"hll_{i}").alias("distinct"), quantiles(i, c).alias("quantiles")) for i, c in enumerate(names)]
    return merged.select(*by, F.explode(F.array(*cells)).alias("e")).select(*by, "e.*")


def percent_text(share: Column) -> Column:
    """A percentage with up to four decimals, trailing zeros cut."""
    return F.regexp_replace(F.format_string("%.4f", share), r"\.?0+$", "")


def proportion(part: Column, whole: Column) -> Column:
    """part / whole to six places, 0 for an empty whole."""
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole.cast("double")), 6), F.lit(0.0))


def _type_counts(schema: T.StructType, names: Sequence[str]) -> dict[str, Column]:
    """Per type family, how many of the columns that survive the constant test belong to it."""
    families = {"float64": [], "int64": [], "categorical": [], "other": []}
    for f in schema.fields:
        if f.name not in names:
            continue
        if isinstance(f.dataType, T.DoubleType):
            families["float64"].append(f.name)
        elif isinstance(f.dataType, T.LongType):
            families["int64"].append(f.name)
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            families["categorical"].append(f.name)
        else:
            families["other"].append(f.name)
    kept = lambda c: F.when(F.array_contains("constant_list", c), 0).otherwise(1)
    return {k: reduce(add, [kept(c) for c in v], F.lit(0)).cast("long") for k, v in families.items()}


def profile_from_state(state: DataFrame, df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """One profile row per group, from its merged state and the schema of `df`.

    Class counts, features and types describe the cleaned table; missing counts the raw one.
    Ties between classes are settled by label text.
    """
    features = df.drop(*by)
    names, numeric = features.columns, numeric_columns(features)
    entry = F.struct((-F.col("rows_clean")).alias("neg"), F.coalesce("_class", F.lit("nan")).alias("class"))
    sums = ["rows", "rows_present", "rows_clean", *[f"miss_{i}" for i in range(len(names))]]
    d = state.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.min(f"low_{i}").alias(f"low_{i}") for i, c in enumerate(names) if c in numeric],
        *[F.max(f"high_{i}").alias(f"high_{i}") for i, c in enumerate(names) if c in numeric],
        F.array_sort(F.collect_list(F.when(F.col("rows_clean") > 0, entry))).alias("_classes"))
    constant = F.array_compact(F.array(*[F.when(F.col(f"low_{i}") == F.col(f"high_{i}"), F.lit(c))
                                         for i, c in enumerate(names) if c in numeric]).cast("array<string>"))
    d = d.withColumn("constant_list", constant)
    missing_parts = F.array_compact(F.array(*[
        F.when(F.col(f"miss_{i}") > 0, F.concat(F.lit(f"{c} ("), F.col(f"miss_{i}").cast("string"), F.lit(")")))
        for i, c in enumerate(names)]).cast("array<string>"))
    or_none = lambda text: F.coalesce(F.nullif(text, F.lit("")), F.lit("None"))
    total = F.col("rows_clean")
    short = F.transform("_classes", lambda e: F.concat(
        e["class"], F.lit(": "), (-e["neg"]).cast("string"), F.lit(" ("),
        F.format_string("%.2f", -e["neg"] / total * 100), F.lit("%)")))
    exact = F.transform("_classes", lambda e: F.concat(
        e["class"], F.lit(": "), (-e["neg"]).cast("string"), F.lit(" ("), percent_text(-e["neg"] / total * 100), F.lit("%)")))
    labels = F.array_sort(F.transform("_classes", lambda e: e["class"]))
    types = _type_counts(features.schema, names)
    texts = text_columns(features)
    cast = [c for c in numeric if c != label and not isinstance(features.schema[c].dataType, (T.DoubleType, T.LongType))]
    encoded = [c for c in names if c not in numeric and c != label]
    kept = lambda cs: reduce(add, [F.when(F.array_contains("constant_list", c), 0).otherwise(1) for c in cs], F.lit(0)).cast("long")
    n = len(names)
    dropped = F.size("constant_list").cast("long")
    after = F.lit(n) - dropped
    changed = kept(cast) + F.lit(len(encoded))
    return d.select(
        *by,
        total.alias("samples"), after.alias("features"),
        *[v.alias(k) for k, v in types.items()],
        F.lit(", ".join(texts) or "None").alias("categorical_features"),
        or_none(F.array_join(missing_parts, ", ")).alias("missing_values"),
        F.size(labels).cast("long").alias("number_of_labels"), F.array_join(labels, ", ").alias("labels_list"),
        or_none(F.array_join(short, ", ")).alias("classes"),
        F.concat(F.lit("{"), F.array_join(exact, ", "), F.lit("}")).alias("class_distribution"),
        F.col("rows").alias("original_num_rows"),
        F.col("rows_present").alias("rows_after_nan_removal"),
        (F.col("rows") - F.col("rows_present")).alias("removed_rows_nan"),
        proportion(F.col("rows") - F.col("rows_present"), F.col("rows")).alias("removed_rows_nan_proportion"),
        total.alias("rows_after_inf_removal"),
        (F.col("rows_present") - total).alias("removed_rows_inf"),
        total.alias("rows_after_nan_inf_removal"),
        (F.col("rows") - total).alias("removed_rows_nan_inf"),
        proportion(F.col("rows") - total, F.col("rows")).alias("removed_rows_nan_inf_proportion"),
        total.alias("rows_after_preprocessing"),
        F.lit(n).cast("long").alias("original_num_features"),
        after.alias("features_after_zero_variance_removal"),
        dropped.alias("removed_zero_variance_features"),
        proportion(dropped, F.lit(n)).alias("removed_zero_variance_features_proportion"),
        after.alias("features_after_preprocessing"),
        F.lit(0).cast("long").alias("dropped_non_informative_features"),
        F.lit(0.0).alias("dropped_non_informative_features_proportion"),
        changed.alias("features_transformed_for_experiment"),
        proportion(changed, after).alias("features_transformed_for_experiment_proportion"),
        kept(cast).alias("features_cast_to_float64_int64"),
        F.lit(len(encoded)).cast("long").alias("features_encoded_categorical"),
    )


def profile(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Profile per group (a file, a day, the whole table): a single pass over the rows."""
    return profile_from_state(profile_state(df, label, by), df, label, by)


def chunk_bounds(size: int, rows: int, threshold: int) -> tuple[int, int]:
    """Chunks for a file above a size threshold, and rows per chunk."""
    chunks = max(1, -(-size // threshold))
    return chunks, -(-rows // chunks)


def missing_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """`col (n), ...` over the columns with missing values, `None` when there are none."""
    names = [c for c in df.columns if c not in by]
    d = df.groupBy(*by).agg(*[F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(names)])
    parts = F.array_compact(F.array(*[
        F.when(F.col(f"m{i}") > 0, F.concat(F.lit(f"{c} ("), F.col(f"m{i}").cast("string"), F.lit(")")))
        for i, c in enumerate(names)]).cast("array<string>"))
    text = F.coalesce(F.nullif(F.array_join(parts, ", "), F.lit("")), F.lit("None"))
    return d.select(*by, text.alias("missing_values"))


def class_distribution(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Count and percentage per class, with both text renderings; null is a class of its own."""
    counts = df.groupBy(*by, F.coalesce(F.col(label).cast("string"), F.lit("nan")).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by)) * 100
    head = F.concat(F.col("class"), F.lit(": "), F.col("n").cast("string"), F.lit(" ("))
    return (counts.withColumn("pct", share)
            .withColumn("short_text", F.concat(head, F.format_string("%.2f", "pct"), F.lit("%)")))
            .withColumn("exact_text", F.concat(head, percent_text(F.col("pct")), F.lit("%)"))))


def distinct_labels(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Number and sorted text of the labels that occur."""
    names = df.filter(F.col(label).isNotNull()).select(*by, F.col(label).cast("string").alias("_l")).distinct()
    listed = F.array_sort(F.collect_list("_l"))
    return names.groupBy(*by).agg(F.count(F.lit(1)).alias("number_of_labels"), F.array_join(listed, ", ").alias("labels_list"))


def preprocessing_summary(profiles: DataFrame, filename: str) -> DataFrame:
    """The 21 report columns per file, plus an `AVERAGE` row of means to six places."""
    d = (profiles.withColumnRenamed(filename, "filename") if filename != "filename" else profiles)
    d = (d.withColumn("removed_rows", F.col("original_num_rows") - F.col("rows_after_preprocessing"))
         .withColumn("removed_rows_proportion", proportion(F.col("removed_rows"), F.col("original_num_rows")))
         .withColumn("removed_features", F.col("original_num_features") - F.col("features_after_preprocessing"))
         .withColumn("removed_features_proportion", proportion(F.col("removed_features"), F.col("original_num_features"))))
    numbers = [c for c in SUMMARY_COLUMNS if c != "filename"]
    rows = d.select(F.col("filename").cast("string").alias("filename"), *[F.col(c).cast("double").alias(c) for c in numbers])
    average = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.round(F.avg(c), 6).alias(c) for c in numbers]).filter("_n > 0")
    return rows.unionByName(average.select(F.lit("AVERAGE").alias("filename"), *numbers))
