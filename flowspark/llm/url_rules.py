"""URL filters: sort-merge range join of addresses with nested host and path rules (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICES = 64  # parts into which the addresses of one host suffix are dealt


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty without `://` or for null."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _reversed_labels(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow",
               slices: int = SLICES) -> DataFrame:
    """(key, host, path, rule, verdict) for every row of `pages`.

    `rules`: host, path, verdict. A rule covers its host and all subdomains where the address's
    path starts with the rule's; the longest host + path wins (of equal ones the first verdict by
    text). Without a rule: null and `default`.

    A reversed host turns "host and below" into a prefix, and a prefix into an interval of keys:
    an address has one key per suffix of its host (suffix reversed, then path), a rule opens an
    interval at its own key. Rules and addresses of a suffix are merged in one sort; a running
    `last` carries the rule opened last with its stack of enclosing rules, and the innermost
    whose interval is still open at the address is taken. Intervals are nested or apart, so the
    stack of the rule opened last holds every open rule. Rules that enclose a rule come from an
    equality join on the prefixes of its path.

    Only suffixes with rules take part, found by a semi-join. A suffix that holds most addresses
    is dealt into `slices` parts by a hash of the key, its rules being repeated in each, so no
    window holds a hot host. Null and malformed addresses have empty parts and fit no rule;
    repeated rows are judged alike; empty tables give what remains; other columns are ignored.
    """
    rules = (rules.select(F.translate(F.col("host"), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
             .where("host <> ''").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
             .select(_reversed_labels(F.col("host")).alias("suffix"), "path",
                     F.struct(F.length(F.concat("host", "path")).alias("size"), "path", F.concat("host", "path").alias("rule"), "verdict").alias("own")))
    prefixes = rules.select("suffix", F.col("path").alias("inner"), F.explode(F.expr("transform(sequence(0, length(path)), n -> substring(path, 1, n))")).alias("path"))
    stacks = (prefixes.join(rules, ["suffix", "path"]).groupBy("suffix", F.col("inner").alias("path"))
              .agg(F.sort_array(F.collect_list("own"), asc=False).alias("stack")))  # at most one rule per prefix of a path

    host, path = url_parts(F.col(url))
    parts = pages.select(F.col(key).alias(key), host.alias("host"), path.alias("path")).withColumn("_row", F.struct(F.col(key), "host", "path"))
    labels = F.split(_reversed_labels(F.col("host")), r"\.")
    suffixes = parts.select("_row", "path", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, F.lit(1), n), "."))).alias("suffix"))
    known = suffixes.join(stacks.select("suffix").distinct(), "suffix", "left_semi")
    part = F.pmod(F.hash("_row"), F.lit(slices))
    events = known.select("suffix", part.alias("slice"), "path", F.lit(1).alias("kind"), "_row", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack")).unionByName(
        stacks.select("suffix", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "path", F.lit(0).alias("kind"),
                      F.lit(None).cast(parts.schema["_row"].dataType).alias("_row"), "stack"))
    sweep = Window.partitionBy("suffix", "slice").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_rules = F.filter(F.last("stack", ignorenulls=True).over(sweep), lambda r: F.startswith(F.col("path"), r["path"]))
    best = (events.withColumn("best", F.get(open_rules, F.lit(0))).where("kind = 1 and best is not null")
            .groupBy("_row").agg(F.max("best").alias("best")))
    return parts.join(best, "_row", "left").select(
        key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
