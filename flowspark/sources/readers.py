"""Scans: CSV, tab-separated, Parquet, ARFF, key:value text, and many files at once."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Order in which text encodings are tried.
ENCODINGS = ("UTF-8", "ISO-8859-1")

# Characters of a quoted ARFF text and how they are written.
ARFF_ESCAPES = (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"))


QUOTED = "\x01?"  # stands for a quoted question mark while a row is parsed


def trimmed(df: DataFrame) -> DataFrame:
    """The table with blanks round its column names removed."""
    return df.toDF(*[c.strip() for c in df.columns])


def detect_encoding(spark: SparkSession, paths: str | Sequence[str]) -> str:
    """UTF-8 when every line of every file is valid UTF-8, else Latin-1."""
    return ENCODINGS[0] if all(encoding == ENCODINGS[0] for _, encoding, _ in file_groups(spark, paths)) else ENCODINGS[1]


def file_groups(spark: SparkSession, paths: str | Sequence[str]) -> list[tuple[list[str], str, bool]]:
    """(files, encoding, multi-line) for files of one header, one encoding and one way to read line ends.

    One pass over all files. A file is UTF-8 when every line is valid UTF-8, else Latin-1. A
    line with an odd number of quotes opens a quoted line end: only such files give up being
    split. The driver gets the names of the files, no text. Headers are told apart by 128 bits of hashes:
    an aggregate that keeps text would sort all lines of a task.
    """
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("path"),
        F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("at"))  # the header is in a file's first block
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    header = [F.min_by(F.xxhash64(F.lit(i), "value"), "at").alias(f"header_{i}") for i in range(2)]
    files = lines.groupBy("path").agg(*header, F.bool_and(F.is_valid_utf8("value")).alias("valid"), F.bool_or(quotes % 2 == 1).alias("open"))
    groups = files.groupBy("header_0", "header_1", "valid", "open").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    # names come as addresses; as paths to read they may hold no pattern
    plain = [([re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(p)) for p in g["paths"]], ENCODINGS[0 if g["valid"] else 1], g["open"])
             for g in groups.select("paths", "valid", "open").collect()]
    return sorted(plain)


def stacked(tables: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """Rows of all tables on the columns by name: null where a table lacks one, text where the types do not mix."""
    types: dict[str, set[str]] = {c: {t.schema[c].dataType.simpleString() for t in tables if c in t.columns} for c in columns}
    numbers = {"int", "bigint", "double"}

    def column(t: DataFrame, c: str) -> Column:
        kind = next(iter(types[c])) if len(types[c]) == 1 else "double" if types[c] <= numbers else "string"
        return (F.col(f"`{c}`") if c in t.columns else F.lit(None)).cast(kind).alias(c)

    return reduce(DataFrame.unionByName, [t.select(*[column(t, c) for c in columns]) for t in tables])


def common_types(schemas: Sequence[T.StructType]) -> T.StructType:
    """All columns by name, each with the type of its files: double where whole and broken numbers meet, text where others do."""
    found: dict[str, set[str]] = {}
    for schema in schemas:
        for f in schema.fields:
            found.setdefault(f.name, set()).add(f.dataType.simpleString())
    whole, numbers = {"int", "bigint"}, {"int", "bigint", "double"}
    kind = lambda s: next(iter(s)) if len(s) == 1 else "bigint" if s <= whole else "double" if s <= numbers else "string"
    return T.StructType([T.StructField(c, T._parse_datatype_string(kind(s))) for c, s in found.items()])


def _group_table(spark: SparkSession, paths: list[str], sep: str, schema: T.StructType | None, encoding: str, multi_line: bool) -> DataFrame:
    # a doubled quote stands for a quote, as other programs write it
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("escape", '"').option("multiLine", multi_line)
    if not schema:
        return trimmed(reader.option("inferSchema", True).csv(paths))
    types = {f.name: f.dataType for f in schema.fields}
    found = [c.strip() for c in reader.csv(paths).columns]
    return reader.schema(T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in found])).csv(paths)


def _delimited(spark: SparkSession, paths, sep: str, schema: T.StructType | None, encoding: str | None) -> DataFrame | None:
    try:
        groups = file_groups(spark, paths)
        tables = [_group_table(spark, files, sep, schema, encoding or found, multi_line) for files, found, multi_line in groups]
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise
    if not tables:
        return None
    if len(tables) == 1 and not schema:
        return tables[0]
    if not schema:  # one type per column, decided over all files, before any value is parsed
        schema = common_types([t.schema for t in tables])
        tables = [_group_table(spark, files, sep, schema, encoding or found, multi_line) for files, found, multi_line in groups]
    if schema:
        lacking = [t.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in t.columns]) for t in tables]
        return stacked(lacking, schema.names)
    return stacked(tables, list(dict.fromkeys(c for t in tables for c in t.columns)))


def read_flows(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = None,
               encoding: str | None = None) -> DataFrame | None:
    """Comma-separated files with a header. None when nothing can be read.

    Columns are matched by name, each file is read in its own encoding, and quoted text may hold
    quotes, separators and line ends. A column that a file lacks is null there. One pass finds
    headers and encodings; give `schema` for large inputs, which saves the pass for types.
    Empty text is null, quoted or not.
    """
    return _delimited(spark, paths, ",", schema, encoding)


def read_tabbed(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = None,
                encoding: str | None = None) -> DataFrame | None:
    """Tab-separated files with a header."""
    return _delimited(spark, paths, "\t", schema, encoding)


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files with trimmed column names; pruning and pushdown are the scan's own."""
    return trimmed(spark.read.parquet(*paths))


def _arff_type(text: str) -> T.DataType:
    kind = text.strip().upper()
    if kind in ("NUMERIC", "REAL"):
        return T.DoubleType()
    return T.LongType() if kind == "INTEGER" else T.StringType()


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """Attribute-relation files: `@attribute` lines name and type the columns.

    Only the header lines reach the driver (one per column); rows are parsed on executors.
    `?` is null, quoted it is text. Nominal values are text, blanks round them removed.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    attribute = r"^@(?i:attribute)\s+('(?:[^'\\]|\\.)*'|\"[^\"]*\"|[^\s{]+)\s*(.*)$"
    header = (lines.filter(F.lower(F.substring("line", 1, 10)) == "@attribute").orderBy("at")
              .select(F.regexp_extract("line", attribute, 1).alias("name"), F.regexp_extract("line", attribute, 2).alias("kind"))
              .collect())
    fields = [T.StructField(h["name"].strip("'\"").replace("\\'", "'").strip(), _arff_type(h["kind"])) for h in header]
    schema = T.StructType(fields)
    raw = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(fields))])
    line = F.col("line")
    for end in "\n\r":  # line ends come back before the other escapes, which an even number of backslashes tells apart
        line = F.regexp_replace(line, rf"(?<!\\)((?:\\\\)*)\\{'n' if end == chr(10) else 'r'}", "$1" + end)
    line = F.when(F.contains("line", F.lit("\\")), line).otherwise(F.col("line"))  # a plain search spares most lines the patterns
    marked = F.regexp_replace(line, r"(^|,)(\s*)'\?'(?=\s*(,|$))", f"$1$2'{QUOTED}'")  # a quoted question mark is a text
    line = F.when(F.contains("line", F.lit("'?'")), marked).otherwise(line)
    parsed = F.from_csv(line, raw.simpleString()[7:-1].replace(":", " "), {
        "quote": "'", "escape": "\\", "nullValue": "?", "multiLine": "true",
        "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    # A data row may begin with @ too; only the three markers are header lines.
    marker = F.startswith("line", F.lit("@")) & F.rlike("line", F.lit(r"^@(?i:relation|attribute|data)\b"))
    data = lines.filter((F.col("line") != "") & ~F.startswith("line", F.lit("%")) & ~marker)
    rows = data.select(parsed.alias("r"))
    cell = lambda i: F.when(F.col(f"r.c{i}") == QUOTED, "?").otherwise(F.col(f"r.c{i}"))
    return rows.select(*[cell(i).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])


def parse_key_values(lines: DataFrame, column: str = "value") -> DataFrame:
    """`key: value` rows from text lines; blank and `#` lines dropped.

    Split at the first colon; a line without one gives (line, null).
    """
    text = F.trim(column)
    parts = F.split(text, ":", 2)
    return (lines.filter((text != "") & ~F.startswith(text, F.lit("#")))
            .select(F.trim(parts[0]).alias("key"), F.trim(F.try_element_at(parts, F.lit(2))).alias("value")))


# Delimiters tried on a stats file.
STATS_DELIMITERS = (",", "\t", ";", "|")


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """A statistics file: delimited when its first line holds a delimiter, else key:value.

    With no usable line, the remaining text comes back as one `line` column.
    """
    first = spark.read.text(path).filter(F.trim("value") != "").head()
    head = first["value"] if first else ""
    for sep in STATS_DELIMITERS:
        if sep in head and not head.lstrip().startswith("#"):
            table = trimmed(spark.read.option("header", True).option("inferSchema", True).option("sep", sep).csv(path))
            if len(table.columns) > 1 and not table.isEmpty():
                return table
    lines = spark.read.text(path)
    table = parse_key_values(lines)
    if table.isEmpty():
        return lines.filter(F.trim("value") != "").select(F.col("value").alias("line"))
    return table


def discover(spark: SparkSession, root: str, extension: str, ignore: Sequence[str] = (), order: str = "size_desc") -> list[str]:
    """Paths below `root` with an extension, ignored names and folders left out.

    Orders: `size_desc` (then path), `size_asc`, `path` (lower-cased). Listing reads no content.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", f"*{extension}").load(root).select("path", "length"))
    for name in ignore:
        files = files.filter(~F.array_contains(F.split("path", "/"), name))
    orders = {"size_desc": [F.desc("length"), F.asc("path")], "size_asc": [F.asc("length"), F.asc("path")],
              "path": [F.lower("path")]}
    return [r["path"] for r in files.orderBy(*orders[order]).collect()]


def read_common(spark: SparkSession, paths: Sequence[str], encoding: str | None = None, source: str | None = None) -> DataFrame:
    """Rows of many CSV files on the columns every file has, in first-file order.

    Headers alone decide the columns. Files with one header form one scan, so the union has
    as many branches as there are distinct headers, not files; files without a line are passed
    over. `source` adds the file path.
    """
    tables = [_group_table(spark, files, ",", None, encoding or found, multi_line) for files, found, multi_line in file_groups(spark, paths)]
    headers = (spark.read.option("header", True).option("escape", '"').csv(p).columns for p in paths)
    order = [c.strip() for c in next((h for h in headers if h), [])]
    common = [c for c in order if tables and all(c in t.columns for t in tables)]
    if not common:
        raise ValueError("the files share no column")
    if source:
        tables = [t.withColumn(source, F.col("_metadata.file_path")) for t in tables]
    return stacked(tables, [*common, source] if source else common)
