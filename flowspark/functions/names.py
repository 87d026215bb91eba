"""Feature names and label columns: work on schemas, not on rows."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that become an underscore in a feature name.
UNSAFE_CHARACTERS = '{}[]:,"\\'

# Code points dropped before names are compared.
BLANK_CODE_POINTS = "\u200b\u200c\u200d\ufeff\u00a0\u2060\u2028\u2029"

# Identifier columns that are never features.
METADATA_COLUMNS = ("Unnamed: 0", "Flow ID", "Source IP", "Destination IP", "Timestamp")

# Label names, by priority, for the `main` rule.
LABEL_PRIORITY = ("class", "label", "target", "outcome", "result", "attack_detected")

# Label names for the `descriptor` rule.
DESCRIPTOR_LABELS = ("label", "class", "target", "y", "category")

# Label names for the `alias` rule, by priority, as written.
LABEL_ALIASES = ("Label", "label", "attack_type", "Attack Type", "Class", "class", "Target", "target")


def sanitize_names(names: Iterable[str]) -> list[str]:
    """Replace unsafe characters by `_`, collapse runs, strip the ends; clashes are an error."""
    unsafe = "[" + re.escape(UNSAFE_CHARACTERS) + "]"
    cleaned = [re.sub("_+", "_", re.sub(unsafe, "_", n)).strip("_") for n in names]
    clashes = sorted(n for n, times in Counter(cleaned).items() if times > 1)
    if clashes:
        raise ValueError(f"names clash once cleaned: {clashes}")
    return cleaned


def sanitize(df: DataFrame) -> DataFrame:
    """The table under sanitized names, as one projection."""
    return df.toDF(*sanitize_names(df.columns))


def normalized(name: Column, rule: str = "trees") -> Column:
    """A feature name folded for comparison, as a column.

    `trees` drops widthless code points, collapses blanks, trims and lowers;
    `search` trims, turns double blanks into one and lowers.
    """
    if rule == "trees":
        bare = F.regexp_replace(name, f"[{BLANK_CODE_POINTS}]", "")
        return F.lower(F.regexp_replace(F.trim(bare), " +", " "))
    if rule == "search":
        return F.lower(F.replace(F.trim(name), F.lit("  "), F.lit(" ")))
    raise ValueError(f"unknown rule {rule!r}")


def normalized_text(name: str) -> str:
    """The `trees` rule for one schema name."""
    kept = re.compile(f"[{BLANK_CODE_POINTS}]").sub("", name).strip()
    return " ".join(filter(None, kept.split(" "))).lower()


def drop_metadata(df: DataFrame, names: Sequence[str] = METADATA_COLUMNS, rule: str = "exact") -> DataFrame:
    """Drop identifier columns, by exact name or by normalized name."""
    if rule == "exact":
        return df.drop(*[c for c in df.columns if c in names])
    folded = {normalized_text(n) for n in names}
    return df.drop(*[c for c in df.columns if normalized_text(c) in folded])


def _label_rank(rule: str, field: T.StructField, last: bool) -> int | None:
    """How strongly a rule prefers a column as label, 0 most; None when it does not take it."""
    name = field.name.strip().lower()
    if rule == "main":
        wanted = dict(zip(LABEL_PRIORITY, range(len(LABEL_PRIORITY))))
        return wanted.get(name)
    if rule == "descriptor":
        tests = (name in DESCRIPTOR_LABELS, "target" in name or "label" in name, last and isinstance(field.dataType, (T.StringType, T.BooleanType)))
        return tests.index(True) if any(tests) else None
    if rule == "alias":
        wanted = dict(zip(LABEL_ALIASES, range(len(LABEL_ALIASES))))
        return wanted.get(field.name, len(wanted) if last else None)
    if rule == "last":
        return 0 if last else None
    raise ValueError(f"unknown rule {rule!r}")


def resolve_label(df: DataFrame, rule: str = "main") -> str | None:
    """Name of the label column under one of four rules: the best-ranked one, the earliest of equals; None without one."""
    if rule not in ("main", "descriptor", "alias", "last"):
        raise ValueError(f"unknown rule {rule!r}")
    fields = df.schema.fields
    ranked = [(rank, at) for at, field in enumerate(fields) if (rank := _label_rank(rule, field, at == len(fields) - 1)) is not None]
    return fields[min(ranked)[1]].name if ranked else None


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of a numeric type, in order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    """Columns of a text or boolean type, in order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def fractional_columns(df: DataFrame) -> list[str]:
    """Columns that can hold NaN or infinity."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
