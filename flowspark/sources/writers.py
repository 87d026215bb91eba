"""Sinks: CSV, tab-separated, Parquet, ARFF, and conversion of whole folders."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.sources.readers import ARFF_ESCAPES, read_arff, read_flows, read_parquet, read_tabbed

ARFF_RELATION = "converted_data"  # fixed value: relation name written

# File extension per format.
EXTENSIONS = {"csv": ".csv", "txt": ".txt", "parquet": ".parquet", "arff": ".arff"}


PLAIN = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)  # types whose text holds nothing to escape


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "ignore") -> None:
    """Header row, no index; an existing target is left alone. Quotes are doubled, blanks stay."""
    (df.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_tabbed(df: DataFrame, path: str, mode: str = "ignore") -> None:
    """The same with tabs."""
    write_csv(df, path, "\t", mode)


def write_parquet(df: DataFrame, path: str, mode: str = "ignore") -> None:
    """Columnar output."""
    df.write.mode(mode).parquet(path)


def write_arff(df: DataFrame, path: str) -> None:
    """Every attribute as STRING, values as text; the header is the first part of the folder. An existing target is left alone."""
    head = [f"@RELATION {ARFF_RELATION}", "", *[f"@ATTRIBUTE '{c}' STRING" for c in df.columns], "", "@DATA"]
    header = df.sparkSession.createDataFrame([(line,) for line in head], "value string").coalesce(1)

    def quoted(name: str) -> Column:
        text = F.col(f"`{name}`").cast("string")
        for plain, escaped in ARFF_ESCAPES if not isinstance(df.schema[name].dataType, PLAIN) else ():
            text = F.replace(text, F.lit(plain), F.lit(escaped))
        return F.concat(F.lit("'"), text, F.lit("'"))

    row = F.concat_ws(",", *[F.coalesce(quoted(c), F.lit("?")) for c in df.columns])
    header.unionAll(df.select(row.alias("value"))).write.mode("ignore").text(path)


def trim_fields(df: DataFrame) -> DataFrame:
    """Blanks round every text field removed."""
    return df.select(*[F.trim(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


READERS = {"csv": read_flows, "txt": read_tabbed, "parquet": read_parquet, "arff": read_arff}
WRITERS = {"csv": write_csv, "txt": write_tabbed, "parquet": write_parquet, "arff": write_arff}


def inputs(spark: SparkSession, root: str, ignore: Sequence[str] = ()) -> list[tuple[str, str]]:
    """(path below `root`, format) of every file, or folder of parts, that a known extension ends."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    for name in ignore:
        files = files.filter(~F.array_contains(F.split("path", "/"), name))
    below = F.element_at(F.split("path", re.escape(re.sub(r"^[a-z]+:/+", "/", root) + "/"), 2), -1)
    named = files.select(F.regexp_extract(below, rf"^(.*?\.({'|'.join(EXTENSIONS)}))(?:/|$)", 1).alias("relative")).where("relative <> ''").distinct()
    return [(r["relative"], r["relative"].rsplit(".", 1)[-1]) for r in named.orderBy(F.lower("relative")).collect()]


def convert(spark: SparkSession, source: str, target: str, formats: Sequence[str] = ("csv", "txt", "parquet", "arff"),
            ignore: Sequence[str] = ()) -> list[str]:
    """Write every input below `source` in every other format, under the same relative path.

    Text fields are trimmed. `target=source` converts in place. Returns the paths written.
    """
    base = source.rstrip("/")
    written = []
    for relative, kind in inputs(spark, base, ignore):  # listed once: what is written below is no input
        table = READERS[kind](spark, f"{base}/{relative}")
        if table is None:
            continue
        table = trim_fields(table)
        for other in formats:
            if other != kind:
                out = f"{target.rstrip('/')}/{relative.removesuffix(EXTENSIONS[kind])}{EXTENSIONS[other]}"
                WRITERS[other](table, out)
                written.append(out)
    return written
