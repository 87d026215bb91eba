"""Synthetic rows for rare classes, their union with the originals, and checks on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.operators.ordering import hash_ranked, running, split_points, with_bucket
from flowspark.operators.sample import class_aware_sample, class_counts, synthetic_quota
from flowspark.session import bounded, settle

TARGET = "attack_type"  # fixed value: label column of an augmented table
RATIOS = (0.25, 0.5, 0.75, 1.0)  # fixed values: augmented-to-original row ratios


def _draw(seed: int, purpose: str, number: Column) -> Column:
    """A 60-bit number drawn from the seed, the purpose and the row number."""
    text = F.md5(F.concat_ws("-", F.lit(str(seed)), F.lit(purpose), number.cast("string")))
    return F.conv(F.substring(text, 1, 15), 16, 10).cast("long")


def synthetic_rows(df: DataFrame, label: str, features: Sequence[str], keys: Sequence[str], amount: float, seed: int = 42,
                   small_below: int = 100, small_rows: int = 10) -> DataFrame:
    """New rows per class by the synthetic quota, each between two rows of its class.

    Row numbers come from a range, so a large class is made in many tasks. Both parents
    and the place between them are drawn from the number; parents are found by rank.
    """
    spark = df.sparkSession
    quotas = synthetic_quota(class_counts(df, label), label, amount, small_below, small_rows).orderBy(label).collect()
    quotas = [r for r in quotas if r["quota"] > 0 and r["n"] > 0]
    ends, total = [], 0
    for r in quotas:
        total += r["quota"]
        ends.append(total)
    if not total:
        return df.select(label, *features).limit(0)
    numbered = with_bucket(spark.range(total), "id", [float(e) for e in ends[:-1]], "_c")
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("_c"))
    size = pick([r["n"] for r in quotas])
    plan = numbered.select(
        "id", pick([r[label] for r in quotas]).alias(label), (_draw(seed, "a", F.col("id")) % size + 1).alias("_ra"),
        (_draw(seed, "b", F.col("id")) % size + 1).alias("_rb"), (_draw(seed, "u", F.col("id")) / F.lit(2.0 ** 60)).alias("_u"))
    ranked = hash_ranked(df.select(*dict.fromkeys([*keys, label, *features])), [label], keys, seed, rank="_r")
    side = lambda s: ranked.select(label, F.col("_r").alias(f"_r{s}"), *[F.col(f).cast("double").alias(f"_{s}_{i}") for i, f in enumerate(features)])
    made = plan.join(side("a"), [label, "_ra"]).join(side("b"), [label, "_rb"])
    between = lambda i: F.col(f"_a_{i}") + F.col("_u") * (F.col(f"_b_{i}") - F.col(f"_a_{i}"))
    return made.select("id", *[between(i).alias(f) for i, f in enumerate(features)], label)


def union_aligned(original: DataFrame, generated: DataFrame) -> DataFrame:
    """Originals on the generated columns, then the generated rows; missing values null."""
    names = {c: t for c, t in generated.dtypes}
    aligned = original.select(*[F.col(f"`{c}`") if c in original.columns else F.lit(None).cast(t).alias(c) for c, t in names.items()])
    return aligned.unionByName(generated)


def uniform_quotas(sizes: Mapping[str, int], budget: int) -> dict[str, int]:
    """A row budget shared evenly over sources, none above its size, earlier sources first."""
    each, extra = divmod(budget, max(1, len(sizes)))
    return {name: min(size, each + (1 if i < extra else 0)) for i, (name, size) in enumerate(sizes.items())}


def augmented_union(sources: Mapping[str, DataFrame], original_rows: int, label: str, keys: Sequence[str], ratio: float, seed: int = 42) -> DataFrame:
    """Rows of augmented sources up to a ratio of the original row count, evenly over sources.

    Feature names sorted, the label last under one name. Classes keep their share, and every
    class keeps a row where the quota allows.
    """
    sizes = {name: df.count() for name, df in sources.items()}
    quotas = uniform_quotas(sizes, int(original_rows * ratio))
    out = None
    for name, df in sources.items():
        features = sorted(c for c in df.columns if c != label and c != TARGET)
        part = class_aware_sample(df, label, keys, quotas[name], 1, seed).select(*features, F.col(label).alias(TARGET))
        out = part if out is None else out.unionByName(part)
    return out


def validate_totals(original: DataFrame, combined: DataFrame, generated: int) -> None:
    """Raise when a combined table does not hold original plus generated rows."""
    found, expected = combined.count(), original.count() + generated
    if found != expected:
        raise ValueError(f"expected {expected} rows, found {found}")


def ks_distance(original: DataFrame, generated: DataFrame, features: Sequence[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per feature."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("e")
    long = lambda d, side: d.select(cells).select("e.*", F.lit(side).alias("side"))
    both = long(original, 0).unionByName(long(generated, 1)).filter("value is not null and not isnan(value)")
    counted = both.groupBy("feature", "value").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    ranked = running(counted, ["feature"], "value", ["a", "b"], points=split_points(both, "value"))
    totals = counted.groupBy("feature").agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))
    gap = F.abs(F.try_divide(F.col("run_a").cast("double"), F.col("_a")) - F.try_divide(F.col("run_b").cast("double"), F.col("_b")))
    return ranked.join(bounded(totals), "feature").groupBy("feature").agg(F.max(gap).alias("ks"))


def class_coverage(original: DataFrame, generated: DataFrame, label: str) -> DataFrame:
    """Rows per class on either side, and whether the generated side has the class."""
    a = class_counts(original, label).withColumnRenamed("n", "original")
    b = class_counts(generated, label).withColumnRenamed("n", "generated")
    return a.join(b, label, "full").na.fill({"original": 0, "generated": 0}).withColumn("covered", F.col("generated") > 0)


def mode_coverage(original: DataFrame, generated: DataFrame, label: str, features: Sequence[str], modes: int = 5, share: float = 0.95,
                  seed: int = 42, parallel: int = 4) -> DataFrame:
    """(class, mode, original, generated, reached): clusters of the original rows of each class, and the generated rows that lie in them.

    Columns are scaled by the original rows; rows that lack a feature are left out. Each class is clustered alone by k-means, the classes
    side by side. A generated row lies in the nearest mode of its class if it is no farther from the centre than `share` of the
    mode's original rows; a mode is reached if one does. Coverage is the share of modes reached.
    """
    names = list(features)
    cells = [F.col(f"`{f}`").cast("double").alias(f"_x{i}") for i, f in enumerate(names)]
    assembler = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(names))], outputCol="_raw")
    ready = lambda d: assembler.transform(d.select(F.col(label).alias("class"), *cells).dropna()).select("class", "_raw")
    scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True).fit(ready(original))
    left, right = (settle(scaler.transform(ready(d)).drop("_raw")) for d in (original, generated))

    def one(value) -> DataFrame:
        rows = left.where(F.col("class") == F.lit(value))
        model = KMeans(k=modes, seed=seed).fit(rows)
        centers = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
        gap = F.zip_with(vector_to_array("features"), F.get(centers, F.col("prediction")), lambda x, c: (x - c) * (x - c))
        placed = lambda d: model.transform(d).select("prediction", F.aggregate(gap, F.lit(0.0), lambda s, x: s + x).alias("far"))
        own = placed(rows).groupBy("prediction").agg(F.count(F.lit(1)).alias("original"), F.percentile_approx("far", share, 10_000).alias("_reach"))
        near = placed(right.where(F.col("class") == F.lit(value))).join(F.broadcast(own), "prediction").where("far <= _reach")
        hits = near.groupBy("prediction").agg(F.count(F.lit(1)).alias("generated"))
        return own.join(hits, "prediction", "left").select(F.lit(value).alias("class"), F.col("prediction").alias("mode"), "original",
                                                           F.coalesce("generated", F.lit(0)).alias("generated"), F.col("generated").isNotNull().alias("reached"))

    values = sorted(r["class"] for r in left.select("class").distinct().collect())
    if not values:
        kind = original.schema[label].dataType.simpleString()
        return original.sparkSession.createDataFrame([], f"class {kind}, mode int, original long, generated long, reached boolean")
    with ThreadPoolExecutor(parallel) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, values))


def correlation_gap(original: DataFrame, generated: DataFrame, features: Sequence[str]) -> DataFrame:
    """Difference of the two correlation matrices, one row per pair of features."""
    names = list(features)
    assembler = VectorAssembler(inputCols=names, outputCol="_v", handleInvalid="skip")

    def matrix(d: DataFrame):
        return Correlation.corr(assembler.transform(d.select(*[F.col(f).cast("double").alias(f) for f in names])), "_v").first()[0].toArray()

    a, b = matrix(original), matrix(generated)
    rows = [(names[i], names[j], float(a[i, j]), float(b[i, j]), float(abs(a[i, j] - b[i, j]))) for i in range(len(names)) for j in range(i)]
    return original.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, original double, generated double, gap double")
