"""Personal data by candidate gradient boosting: generators, boosted trees on format and context, calibrated threshold.

DataFrame functions and MLlib only.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.session import settle

KINDS = ("email", "ip", "card", "phone")
# Fixed formats of the base spans, leftmost and without overlap per kind. Possessive quantifiers
# and the looks behind change no match; they keep long runs linear and off the stack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What the generators propose beyond: disguised signs, other separators, numbers without a plus.
WIDE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?: ?[.,] ?[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}+(?:[ .-]?+[0-9]{2,6}+){2,4}+(?![0-9])",
    "phone": r"(?<![0-9+])(?:00|\(|[0-9])[0-9]{1,4}+[) .-]{1,3}+[0-9]{2,4}+(?:[ .-][0-9]{2,5}+){1,4}+(?![0-9])",
}
TRIGGERS = {"email": "contains(t, '@') or contains(t, 'at') and contains(t, 'dot')", "ip": "t rlike '[0-9] ?[.,] ?[0-9]'", "card": "t rlike '[0-9][0-9 -]'", "phone": "t rlike '[0-9][0-9().+ -]'"}
CONTEXT = 24  # characters before a span that features see
CUES = r"(?i)(mail|contact|kontakt|correo|courriel|call|phone|tel|fon|mobil|fax|card|visa|carte|karte|tarjeta|host|server|addr|login|from)"
PRECISION = 0.95  # of weak labels among the candidates accepted on the calibration half
FEATURES = ("length", "digits", "groups", "longest", "variety", "plus", "paren", "blank", "hyphen", "dot", "comma", "at", "disguise",
            "cue", "glued_before", "glued_after", "is_email", "is_ip", "is_card", "is_phone")
SPAN = "array<struct<start:int,end:int,text:string,before:string,after:string>>"


def spans_of(text: Column, pattern: str) -> Column:
    """Matches of a pattern with positions in code points: the pieces between matches give the offsets."""
    found, rest = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def add(state: Column, i: Column) -> Column:
        match = F.get(found, i)
        start = state["at"] + F.length(F.get(rest, i))
        end = start + F.length(match)
        lead = F.greatest(start - CONTEXT, F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), match.alias("text"),
                        F.substring(text, lead + 1, start - lead).alias("before"), F.substring(text, end + 1, F.lit(1)).alias("after"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), none, add)["out"]).otherwise(F.array().cast(SPAN))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, doubled).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: Column, text: Column) -> Column:
    """The fixed conditions on a base match."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    n = F.length(digits)
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (F.when(kind == "ip", text.rlike(rf"^{part}(?:\.{part}){{3}}$"))
            .when(kind == "card", F.when(n.between(14, 19), _luhn(digits)).otherwise(F.lit(False)))
            .when(kind == "phone", n.between(10, 15)).otherwise(F.lit(True)))


def _exploded(docs: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, kind, start, end, text, before, after) of all matches."""
    base = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def of_kind(kind: str, pattern: str) -> Column:
        found = F.when(F.expr(TRIGGERS[kind]), spans_of(F.col("t"), pattern)).otherwise(F.array().cast(SPAN))
        return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), *[s[c].alias(c) for c in ("start", "end", "text", "before", "after")]))

    per_kind = [of_kind(k, p) for k, p in patterns.items()]
    return base.select("key", F.explode(F.concat(*per_kind)).alias("s")).select("key", "s.*")


def features(spans: DataFrame) -> DataFrame:
    """Format and context of candidates. The base conditions themselves are no features, so near misses can score high."""
    text, count = F.col("text"), lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("double")
    flag = lambda c: c.cast("double")
    runs = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))
    values = {
        "length": F.length(text).cast("double"), "digits": count("[0-9]"), "groups": F.size(runs).cast("double"),
        "longest": F.array_max(F.transform(runs, F.length)).cast("double"), "variety": F.size(F.array_distinct(F.split(text, ""))).cast("double"),
        "plus": flag(text.startswith("+")), "paren": count(r"[()]"), "blank": count(" "), "hyphen": count("-"), "dot": count(r"\."), "comma": count(","),
        "at": count("@"), "disguise": count(r"(?i)[(\[](?:at|dot)[)\]]"), "cue": flag(F.col("before").rlike(CUES)),
        "glued_before": flag(F.col("before").rlike(r"[\p{L}0-9]$")), "glued_after": flag(F.col("after").rlike(r"[\p{L}0-9]"))}
    values |= {f"is_{k}": flag(F.col("kind") == k) for k in KINDS}
    named = spans.withColumns({n: F.coalesce(c, F.lit(0.0)) for n, c in values.items()})
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(named).drop(*FEATURES)


def accepted(candidates: DataFrame) -> DataFrame:
    """Candidates with `weak` labels (1: a base span) that the calibrated trees accept, with `p`.

    The candidates of half the documents, by hash, train the trees; those of the other half set the
    threshold: the lowest score, in steps of a twentieth from a half, from which PRECISION of
    the candidates are base spans. Without both labels or such a threshold nothing is added.
    """
    spans = settle(candidates)
    half = F.pmod(F.xxhash64("key", F.lit("half")), F.lit(2))
    train = settle(features(spans.where(half == 0)).select("features", F.col("weak").cast("double").alias("label")))
    labels = train.agg(F.countDistinct("label")).first()[0]
    none = spans.where("false").withColumn("p", F.lit(0.0))
    if labels < 2:
        return none
    model = GBTClassifier(maxIter=10, maxDepth=3, seed=1, stepSize=0.3).fit(train)
    def scored(df: DataFrame) -> DataFrame:
        return model.transform(features(df)).withColumn("p", F.get(vector_to_array("probability"), F.lit(1)))
    bins = {r["b"]: (r["n"], r["good"]) for r in scored(spans.where(half == 1)).groupBy(F.floor(F.col("p") * 20).cast("int").alias("b"))
            .agg(F.count("*").alias("n"), F.sum("weak").alias("good")).collect()}
    threshold, n, good = None, 0, 0
    for b in range(20, 9, -1):
        n, good = n + bins.get(b, (0, 0))[0], good + bins.get(b, (0, 0))[1]
        if n and good >= PRECISION * n:
            threshold = b / 20
    return none if threshold is None else scored(spans).where((F.col("p") >= threshold) & (F.col("weak") == 0)).select(*spans.columns, "p")


def _chosen(found: Column, taken: Column) -> Column:
    """Candidates in order of preference that overlap neither base spans nor one chosen before."""
    def keep(state: Column, s: Column) -> Column:
        clash = F.exists(F.concat(taken, state), lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))
        return F.when(clash, state).otherwise(F.concat(state, F.array(F.struct(s["start"].alias("start"), s["nr"].alias("nr"), s["end"].alias("end")))))
    return F.aggregate(found, F.array().cast("array<struct<start:int,nr:int,end:int>>"), keep)


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, added): spans as arrays of structs (start, nr, end), nr being the kind's place in KINDS.

    base: all valid matches of the fixed formats. added: what the trees accept of the wider
    generators' candidates, best first, where it overlaps nothing chosen before. Positions are
    in code points, ends exclusive. Null text is empty; repeated rows of one key must hold the
    same text and share their spans; other columns are ignored; empty tables give empty results.
    """
    distinct = docs.select(key, text)
    nr = F.expr("array_position(array('" + "','".join(KINDS) + "'), kind) - 1").cast("int")
    base = _exploded(distinct, key, text, BASE).where(valid(F.col("kind"), F.col("text"))).withColumn("weak", F.lit(1))
    wide = _exploded(distinct, key, text, WIDE).withColumn("weak", F.lit(0))
    both = settle(base.unionByName(wide).groupBy("key", "kind", "start", "end").agg(F.max("weak").alias("weak"), *[F.max(c).alias(c) for c in ("text", "before", "after")]))
    more = accepted(both)
    span = F.struct("start", nr.alias("nr"), "end")
    per_doc = both.where("weak = 1").groupBy("key").agg(F.array_sort(F.collect_list(span)).alias("base"))
    extra = more.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("rank"), "start", nr.alias("nr"), "end"))),
                                                lambda s: F.struct(s["start"].alias("start"), s["nr"].alias("nr"), s["end"].alias("end"))).alias("found"))
    nothing = F.array().cast("array<struct<start:int,nr:int,end:int>>")
    spans = per_doc.join(extra, "key", "full").withColumn("base", F.coalesce("base", nothing))
    spans = spans.select("key", "base", F.coalesce(F.array_sort(_chosen(F.col("found"), F.col("base"))), nothing).alias("added"))
    return docs.select(F.col(key)).join(spans, F.col(key) == F.col("key"), "left").select(
        key, F.coalesce("base", nothing).alias("base"), F.coalesce("added", nothing).alias("added"))


def as_text(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["nr"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
