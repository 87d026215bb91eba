"""Numbers as text, keys, and the parsing of stored rankings and feature lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def truncated(column: str | Column) -> Column:
    """Four decimals cut toward zero, as text; null for what is no number."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    value = text.try_cast("double")
    units = F.abs(value) * 10000  # cut in double precision: a long would clip large values
    cut = F.signum(value) * (units - units % 1) / 10000
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.format_string("%.4f", F.when(cut == 0, F.lit(0.0)).otherwise(cut)))


def state_id(*parts: Column) -> Column:
    """sha256 of the `|`-joined parts."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256)


def trial_id(*parts: Column) -> Column:
    """First 16 hex digits of the state id."""
    return F.substring(state_id(*parts), 1, 16)


RANK_LINE = r"^\s*(\d+)\.?\s+(.+)$"  # fixed value: a ranked line
FEATURE_LINE = r"^\s*(\d+)\.\s+(.*?)(?:\s+\(RFE [Rr]anking\s+(\d+)\))?\s*$"  # fixed value: a numbered feature line


def ranks_from_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """(feature, rank) from lines such as `3. name`."""
    hit = F.rlike(F.col(column), F.lit(RANK_LINE))
    return lines.filter(hit).select(F.trim(F.regexp_extract(column, RANK_LINE, 2)).alias("feature"),
                                    F.regexp_extract(column, RANK_LINE, 1).cast("int").alias("rank"))


def features_from_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """(position, feature, ranking) from lines such as `1. name (RFE ranking 1)`."""
    return feature_rows(lines.select(column), column)


def feature_rows(df: DataFrame, column: str) -> DataFrame:
    """A numbered feature text per row, as one row per feature; the other columns are repeated."""
    others = [c for c in df.columns if c != column]
    lines = df.select(*others, F.explode(F.split(column, "\n")).alias("_line"))
    part = lambda i: F.regexp_extract("_line", FEATURE_LINE, i)
    return lines.filter(F.rlike("_line", F.lit(FEATURE_LINE))).select(
        *others, part(1).cast("int").alias("position"), F.trim(part(2)).alias("feature"), F.nullif(part(3), F.lit("")).cast("int").alias("ranking"))


def ranks_from_json(df: DataFrame, column: str) -> DataFrame:
    """(feature, rank) from a JSON cell: `rfe_ranking`, else the first run's `ranking`, else the object itself."""
    cell = F.col(column)
    body = F.coalesce(F.get_json_object(cell, "$.rfe_ranking"), F.get_json_object(cell, "$.per_run[0].ranking"), cell)
    ranks = F.from_json(body, T.MapType(T.StringType(), T.IntegerType()))
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode(ranks).alias("feature", "rank")).filter("rank is not null")


def feature_list(column: str) -> Column:
    """A stored JSON list of names, first occurrences kept."""
    return F.array_distinct(F.from_json(column, T.ArrayType(T.StringType())))


def merged_list(df: DataFrame, column: str, order: str) -> list[str]:
    """Names of several stored lists in order, each once. A list is as long as a schema."""
    rows = df.orderBy(order).select(feature_list(column).alias("f")).collect()
    return list(dict.fromkeys(name for r in rows for name in (r["f"] or [])))


def select_features(df: DataFrame, names: list[str], rule: str = "strict") -> DataFrame:
    """Project to stored names. `strict` raises on unknown names; `known` drops them and,
    when none is left, keeps all columns."""
    unknown = [n for n in names if n not in df.columns]
    if rule == "strict" and unknown:
        raise ValueError(f"unknown features: {unknown}")
    kept = [n for n in names if n in df.columns]
    return df.select(*[f"`{n}`" for n in kept]) if kept else df
