"""Quality by Bradley-Terry ranking: strengths of texts learned from preference pairs, cut at a quantile."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.words import slices
from flowspark.operators.ordering import hash_ranked
from flowspark.session import settle

OPPONENTS = 8  # preference pairs that each labelled text opens
PENALTY = 1e-4  # L2 penalty of the weights
ROUNDS = 100  # most iterations of the fit
MARGIN = 0.02  # the cut lies in the middle of the quantiles this share below and above
SEED = 17
SLICE = 8 << 20
FEATURES = ("words", "word_length", "upper", "letters", "digits", "symbols", "stops", "entropy", "shouted", "bare", "marked",
            "repeated_next", "distinct", "repeated_four", "repeated_lines", "top_word")


def text_features(text: bytes) -> list[float]:
    """Shape of a whole text in UTF-8: shares of kinds of characters, words and repetitions. All are 0 for an empty text."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size, n = len(text), len(words)
    upper, digits, blank = counts[65:91].sum(), counts[48:58].sum(), counts[32] + counts[9:14].sum()
    letters, stops = upper + counts[97:123].sum() + counts[128:].sum(), counts[44] + counts[46]
    share = counts[counts > 0] / size
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    shouted = sum(k for w, k in kinds.items() if len(w) > 1 and w.isupper())
    bare = sum(k for w, k in kinds.items() if not w.strip(b".,").isalnum() and w.isascii())
    marked = sum(k for w, k in kinds.items() if not (w[-1:].isalnum() or w[-1] > 127 or w[-1:] in b".,"))
    fours = {tuple(words[i:i + 4]) for i in range(n - 3)}
    lines = [line for line in text.split(b"\n") if line]
    return [float(v) for v in (
        np.log(n), min(20.0, size / n) / 20, np.sqrt(upper / max(1, letters)), letters / size, np.sqrt(digits / size),
        np.sqrt(max(0, size - letters - digits - blank - stops) / size), np.sqrt(stops / n), -(share * np.log2(share)).sum() / 8,
        shouted / n, bare / n, marked / n, sum(map(eq, words, words[1:])) / n, np.log1p(len(kinds)) / np.log1p(n),
        1 - len(fours) / (n - 3) if n > 3 else 0.0, 1 - len(set(lines)) / len(lines), max(kinds.values()) / n if n > 8 else 0.0)]


def features(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, f): features of every whole text, a row per row, in one pass without a shuffle.

    A null text counts as empty, equal texts have equal features, an empty table gives an empty one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", SLICE):
            found = [text_features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["key", "f"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs["text"].alias("_text"))
    return rows.mapInArrow(run, f"key {kind}, f array<double>").withColumnRenamed("key", key)


@dataclass
class Model:
    """Strength of a text: sum of weight times feature. Texts at `cut` score one half."""

    weights: list[float]
    cut: float


def preference_pairs(rated: DataFrame, opponents: int = OPPONENTS) -> DataFrame:
    """(label, d): each text against drawn texts of the other class.

    `rated` has `id`, `quality` (0/1) and `f`. Texts are numbered inside their class; every text draws `opponents`
    numbers of the other class by a keyed hash, so pairs grow with the texts and no text meets all others. `d`
    is the difference of features, turned round by hash, and `label` 1 where the better text comes first.
    """
    ranked = settle(hash_ranked(rated, ["quality"], ["id"], SEED, "nr"))
    sizes = {r["quality"]: r["n"] for r in ranked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return rated.sparkSession.createDataFrame([], "label double, d array<double>")
    drawn = ranked.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(opponents)))).select(
        "id", "draw", "quality", F.col("f").alias("own"), (1 - F.col("quality")).alias("other"),
        (F.pmod(F.xxhash64("id", "draw", F.lit(SEED)), F.when(F.col("quality") == 0, sizes[1]).otherwise(sizes[0])) + 1).alias("nr"))
    met = drawn.join(ranked.select(F.col("quality").alias("other"), "nr", "f"), ["other", "nr"])
    turned = F.pmod(F.xxhash64("draw", "id"), F.lit(2)) == 1
    difference = F.when(turned, F.zip_with("f", "own", lambda x, y: x - y)).otherwise(F.zip_with("own", "f", lambda x, y: x - y))
    return met.select((turned != (F.col("quality") == 1)).cast("double").alias("label"), difference.alias("d"))


def strength(weights: list[float], f: Column) -> Column:
    return F.aggregate(F.zip_with(f, F.lit(weights), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)


def fit(found: DataFrame, labels: DataFrame, key: str = "doc_id") -> Model:
    """Fit on the rows of `found` (key, f) named in `labels` (key, quality 0/1); the caller leaves out held-out rows.

    All labelled texts take part; texts of equal features count once, as good if at least half of their labels
    say so, so a group of copies weighs as one text. Logistic regression on the differences, without an intercept, is the
    Bradley-Terry likelihood with strengths linear in the features. The cut is the quantile of the strengths at
    the share of bad texts. Null keys and labels are left out. Without texts of both classes all weights
    are 0 and every text scores 0.5.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.avg("quality").alias("quality"))
    rated = (found.join(known, key).groupBy("f").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
             .withColumn("id", F.xxhash64("f")))
    rated = settle(rated)
    pairs = preference_pairs(rated).select("label", array_to_vector("d").alias("features"))
    if pairs.isEmpty():
        return Model([0.0] * len(FEATURES), 0.0)
    fitted = LogisticRegression(fitIntercept=False, regParam=PENALTY, maxIter=ROUNDS).fit(pairs)
    weights = [float(w) for w in fitted.coefficients.toArray()]
    rated = rated.select("quality", strength(weights, F.col("f")).alias("s"))
    bad = 1 - rated.agg(F.avg("quality")).first()[0]
    low, high = rated.agg(F.percentile_approx("s", [bad * (1 - MARGIN), min(1.0, bad * (1 + MARGIN))], 100_000)).first()[0]
    return Model(weights, (low + high) / 2)


def score(found: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, score) of every row of `found`: 0 to 1, one half at the model's cut, rising with the strength."""
    return found.select(key, (1 / (1 + F.exp(model.cut - strength(model.weights, F.col("f"))))).alias("score"))
