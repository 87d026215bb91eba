"""Row and column cleaning as predicates and one-pass statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.names import fractional_columns, numeric_columns, text_columns
from flowspark.operators.ordering import running, split_points
from flowspark.session import settle

FLOAT32_MAX = 3.4028234663852886e38  # fixed value: largest finite 32-bit float
INFINITY = float("inf")
WIDE = 24  # columns above which a row is tested as an array
SKETCH_ROWS = 200_000  # rows that bracket a median


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def missing(df: DataFrame, column: str) -> Column:
    """True where a value is null or NaN."""
    empty = F.col(f"`{column}`").isNull()
    return empty | F.isnan(f"`{column}`") if column in fractional_columns(df) else empty


def is_infinite(column: str) -> Column:
    """True where a value is plus or minus infinity; false when it is null."""
    return F.coalesce(F.abs(F.col(f"`{column}`")) == F.lit(INFINITY), F.lit(False))


def any_missing(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Some column of the row is null or NaN.

    A long chain of tests makes a method too big for the JIT compiler, so wide rows are
    tested as an array.
    """
    names = list(columns or df.columns)
    if len(names) <= WIDE:
        return _any([missing(df, c) for c in names])
    numbers = [F.col(f"`{c}`").cast("double") for c in names if c in fractional_columns(df)]
    others = [F.col(f"`{c}`").isNull() for c in names if c not in fractional_columns(df)]
    tests = [F.exists(F.array(*numbers), lambda x: x.isNull() | F.isnan(x))] if numbers else []
    return _any([*tests, *([F.array_contains(F.array(*others), True)] if others else [])])


def any_infinite(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Some numeric column of the row is infinite."""
    wanted = [c for c in fractional_columns(df) if columns is None or c in columns]
    if len(wanted) <= WIDE:
        return _any([is_infinite(c) for c in wanted])
    values = F.array(*[F.coalesce(F.abs(F.col(f"`{c}`").cast("double")), F.lit(0.0)) for c in wanted])
    return F.array_contains(values, F.lit(INFINITY))


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with every value present."""
    return df.filter(~any_missing(df, columns))


def drop_infinite(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with every numeric value finite."""
    return df.filter(~any_infinite(df, columns))


def drop_unusable(df: DataFrame, policy: str = "all", label: str | None = None) -> DataFrame:
    """Missing and infinite rows out in one filter.

    `all` looks at every column; `features` looks at numeric columns except the label.
    """
    if policy == "all":
        return df.filter(~(any_missing(df) | any_infinite(df)))
    if policy == "features":
        columns = [c for c in numeric_columns(df) if c != label]
        return df.filter(~(any_missing(df, columns) | any_infinite(df, columns)))
    raise ValueError(f"unknown policy {policy!r}")


def drop_out_of_range(df: DataFrame, limit: float = FLOAT32_MAX, check: bool = False) -> DataFrame:
    """Rows whose numeric values are present and within 32-bit float range.

    Infinity counts as missing. `check` raises when nothing is left.
    """
    columns = numeric_columns(df)
    fits = [F.coalesce(F.abs(F.col(f"`{c}`")) <= F.lit(limit), F.lit(False)) for c in columns]
    kept = df.filter(reduce(and_, fits, F.lit(True)) & ~any_missing(df))
    if check and kept.isEmpty():
        raise ValueError("no row is left after range cleaning")
    return kept


def constant_columns(df: DataFrame, where: Column | None = None) -> list[str]:
    """Numeric columns that hold one value over the rows that pass `where`.

    Zero population variance means equal extremes, without rounding noise.
    """
    columns = numeric_columns(df)
    if not columns:
        return []
    extremes = []
    for i, c in enumerate(columns):
        value = F.col(f"`{c}`") if where is None else F.when(where, F.col(f"`{c}`"))
        extremes.append((F.min(value) == F.max(value)).alias(f"c{i}"))
    row = df.agg(*extremes).first()
    return [c for i, c in enumerate(columns) if row[f"c{i}"]]


def drop_constant(df: DataFrame) -> DataFrame:
    """The table without constant numeric columns; text columns stay."""
    return df.drop(*constant_columns(df))


def clean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing rows, infinite rows and constant columns out, in that order.

    The two row rules become one pushed-down filter and the constant test one aggregate.
    """
    d = df.select(*[f"`{c}`" for c in columns]) if columns else df
    return drop_constant(d.filter(~(any_missing(d) | any_infinite(d))))


def coerce_numeric(df: DataFrame) -> DataFrame:
    """Numeric columns only; when there are none, the text columns that hold some number."""
    numeric = numeric_columns(df)
    if numeric:
        return df.select(*[f"`{c}`" for c in numeric])
    names = text_columns(df)
    casts = {c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in names}
    counts = df.agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(casts.values())]).first()
    kept = [c for i, c in enumerate(names) if counts[f"n{i}"]]
    return df.select(*[casts[c].alias(c) for c in kept])


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact median of each column over its present, finite values.

    A sketch (of a sample, when the table is large) brackets every median, a second pass
    counts what lies below and inside the bracket, and only the values inside are counted
    and ranked, in value ranges. A bracket that misses is opened fully. No task sees a
    column whole.
    """
    rows = df.count()
    slack = 0.002 if rows <= SKETCH_ROWS else min(0.4, 5 * (0.25 / SKETCH_ROWS) ** 0.5)
    number = lambda c: F.col(f"`{c}`").cast("double")
    d = df.select(*[F.when(F.abs(number(c)) < INFINITY, number(c)).alias(f"x{i}") for i, c in enumerate(columns)])
    finite = {c: F.col(f"x{i}") for i, c in enumerate(columns)}
    looked = d if rows <= SKETCH_ROWS else d.sample(SKETCH_ROWS / rows, seed=42)
    sketch = looked.agg(*[F.percentile_approx(v, [0.5 - slack, 0.5 + slack], 10000).alias(f"p{i}")
                          for i, v in enumerate(finite.values())]).first()
    bracket = {i: sketch[f"p{i}"] or (-INFINITY, INFINITY) for i in range(len(finite))}
    seen = d.agg(*[x for i, v in enumerate(finite.values()) for x in (
        F.count(v).alias(f"n{i}"), F.count_if(v < bracket[i][0]).alias(f"b{i}"), F.count_if(v.between(*bracket[i])).alias(f"k{i}"))]).first()
    result: dict[str, float | None] = dict.fromkeys(columns)
    wanted, inside = [], []
    for i, (c, v) in enumerate(finite.items()):
        n, below = seen[f"n{i}"], seen[f"b{i}"]
        if not n:
            continue
        low, high = (n + 1) // 2, n // 2 + 1
        if not below < low <= high <= below + seen[f"k{i}"]:
            bracket[i], below = (-INFINITY, INFINITY), 0
        wanted += [F.lit(i), F.struct(F.lit(low - below).alias("lo"), F.lit(high - below).alias("hi"))]
        inside.append(F.when(v.between(*bracket[i]), F.struct(F.lit(i).alias("i"), v.alias("v"))))
    if not inside:
        return result
    pairs = d.select(F.explode(F.array_compact(F.array(*inside))).alias("e")).select("e.i", "e.v")
    counted = settle(pairs.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")))
    ranked = running(counted, ["i"], "v", ["n"], points=split_points(counted, "v")).withColumn("w", F.create_map(*wanted)[F.col("i")])
    hit = lambda side: (F.col(f"w.{side}") > F.col("run_n") - F.col("n")) & (F.col(f"w.{side}") <= F.col("run_n"))
    middle = (ranked.filter(hit("lo") | hit("hi")).groupBy("i")
              .agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
    for row in middle:
        result[columns[row["i"]]] = row["lo"] if row["lo"] == row["hi"] else (row["lo"] + row["hi"]) / 2
    return result


def median_impute(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Infinity to null, all-null columns out, nulls to the column median.

    `exact=False` takes the approximate median in one pass for very wide tables.
    """
    columns = list(columns or numeric_columns(df))
    if exact:
        medians = exact_medians(df, columns)
    else:
        d = df.agg(*[F.percentile_approx(F.when(~is_infinite(c) & ~missing(df, c), F.col(f"`{c}`").cast("double")),
                                         0.5).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        medians = {c: d[f"m{i}"] for i, c in enumerate(columns)}
    gone = [c for c in columns if medians[c] is None]
    out = []
    for c in df.columns:
        if c in gone:
            continue
        value = F.col(f"`{c}`")
        if c in columns:
            bad = missing(df, c) | is_infinite(c)
            value = F.when(bad, F.lit(medians[c])).otherwise(value.cast("double")).alias(c)
        out.append(value)
    return df.select(*out)


def normalize_types(df: DataFrame) -> DataFrame:
    """Give each text or binary column the narrowest type all its present values share.

    Binary becomes text; then number if every value is one, boolean if every value is one,
    text otherwise. One aggregate decides for all columns.
    """
    as_text = [F.make_valid_utf8(F.col(f"`{f.name}`").cast("string")) if isinstance(f.dataType, T.BinaryType) else F.col(f"`{f.name}`")
               for f in df.schema.fields]
    d = df.select(*[c.cast("string").alias(f.name) if isinstance(f.dataType, (T.BinaryType, T.StringType))
                    else c for c, f in zip(as_text, df.schema.fields)])
    names = [f.name for f in d.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return d
    checks = []
    for i, c in enumerate(names):
        checks += [F.count(f"`{c}`").alias(f"n{i}"),
                   F.count(F.expr(f"try_cast(`{c}` AS DOUBLE)")).alias(f"d{i}"),
                   F.count_if(F.lower(F.trim(f"`{c}`")).isin("true", "false")).alias(f"b{i}")]
    row = d.agg(*checks).first()
    kinds = {}
    for i, c in enumerate(names):
        if row[f"n{i}"] and row[f"d{i}"] == row[f"n{i}"]:
            kinds[c] = "double"
        elif row[f"n{i}"] and row[f"b{i}"] == row[f"n{i}"]:
            kinds[c] = "boolean"
    return d.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`")
                      for c in d.columns])


def scale_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column's present values; a zero deviation counts as one."""
    present = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`"))
    row = df.agg(*[F.avg(present(c)).alias(f"m{i}") for i, c in enumerate(columns)],
                 *[F.stddev_pop(present(c)).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / deviation with the statistics of the training side."""
    return df.select(*[((F.col(f"`{c}`") - stats[c][0]) / stats[c][1]).alias(c) if c in stats
                       else F.col(f"`{c}`") for c in df.columns])


def unscale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """The inverse of `scale`."""
    return df.select(*[(F.col(f"`{c}`") * stats[c][1] + stats[c][0]).alias(c) if c in stats
                       else F.col(f"`{c}`") for c in df.columns])
