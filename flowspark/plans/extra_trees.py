"""Extremely randomized trees, grown level by level with two aggregates a level."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.session import parallelism, settle

DEPTH = 10  # levels; a tree has at most 2 ** DEPTH leaves, so a model's size does not follow the rows
SEED = 42  # fixed value: seed of the draws
ROWS = 8192  # rows routed at a time
NODES = 64  # open nodes of a tree whose counts meet in one group
SPANS = "t int, low binary, high binary"


@dataclass
class Trees:
    """Grown trees. A node is a number: the root 1, its sides 2 and 3, and so on; arrays are indexed by tree and node."""

    features: list[str]
    labels: list
    feature: np.ndarray  # -1: a leaf
    threshold: np.ndarray
    votes: np.ndarray  # share of each class, of every node
    importance: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def nodes_of(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The node that each row ends in: the left side holds values up to the threshold."""
        at = np.ones(len(x), np.int64)
        while True:
            f = self.feature[tree, at]
            inner = f >= 0
            if not inner.any():
                return at
            right = x[np.arange(len(x)), np.maximum(f, 0)] > self.threshold[tree, at]
            at = np.where(inner, 2 * at + right, at)

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Mean class shares of the leaves a row ends in."""
        return sum(self.votes[t, self.nodes_of(x, t)] for t in range(len(self.feature))) / len(self.feature)


def drawn(tree: int, level: int, nodes: int, features: int, take: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each open node of a tree's level: the features it may be split by, and where between the least and the
    greatest value of each the threshold lies."""
    rng = np.random.default_rng([seed, tree, level])
    return rng.random((nodes, features)).argsort(axis=1)[:, :take], rng.random((nodes, take))


def _batches(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for part in parts:
        for at in range(0, len(part), ROWS):
            rows = part.iloc[at:at + ROWS]
            yield np.stack(rows["x"].to_numpy()).astype(float), rows["y"].to_numpy(np.int64)


def grow(df: DataFrame, label: str, features: Sequence[str], trees: int = 200, depth: int = DEPTH, seed: int = SEED, least_rows: int = 2) -> Trees:
    """Grow trees on all rows that have a label and every feature.

    A level takes two passes over the settled rows. The first finds the least and greatest value of the features that each open node has
    drawn (the square root of all); a threshold is drawn between them. The second counts (tree, node, feature, side,
    class), and the feature with the largest fall in Gini impurity splits the node. Tasks route their rows and send back a few
    numbers per open node, packed by tree; the choice of the split is an aggregate as well, so one split per node reaches the driver. A node is
    a leaf once it is pure, has fewer than `least_rows` rows, or its drawn features are constant.
    """
    names, spark = list(features), df.sparkSession
    present = df.select(F.col(label).alias("label"), *[F.col(f"`{f}`").cast("double").alias(f"_x{i}") for i, f in enumerate(names)]).dropna()
    labels = sorted(r["label"] for r in present.select("label").distinct().collect())
    index = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col("label")) - 1
    rows = settle(present.select(index.alias("y"), F.array(*[f"_x{i}" for i in range(len(names))]).alias("x")).repartition(parallelism(spark)))
    k, d = len(labels), len(names)
    take, size = max(1, math.isqrt(d)), 1 << (depth + 1)
    model = Trees(names, labels, np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size, k)))
    totals = np.zeros(k)
    for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect():
        totals[r["y"]] = r["n"]
    if not totals.sum():
        raise ValueError("no row with a label and every feature")
    model.votes[:, 1] = totals / totals.sum()
    weight = {(t, 1): totals for t in range(trees)}
    gains = np.zeros((trees, d))
    for level in range(depth):
        live = sorted((t, n) for (t, n), c in weight.items() if c.sum() >= least_rows and (c > 0).sum() > 1)
        if not live:
            break
        open_nodes = {t: np.array([n for _, n in group]) for t, group in groupby(live, key=itemgetter(0))}
        draws = {t: drawn(t, level, len(open_nodes[t]), d, take, seed) for t in open_nodes}
        picked = {t: draws[t][0] for t in draws}
        router = Router.of(model, level)
        now = spark.sparkContext.broadcast((router, open_nodes, picked))  # bounded by trees and depth

        def spans(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            router, open_nodes, picked = now.value
            low = {t: np.full(picked[t].shape[::-1], np.inf) for t in picked}
            high = {t: np.full(picked[t].shape[::-1], -np.inf) for t in picked}
            for x, _ in _batches(parts):
                for t in picked:
                    at, _, values = router.drawn_values(x, t, open_nodes[t], picked[t])
                    for j in range(take):
                        np.minimum.at(low[t][j], at, values[j])
                        np.maximum.at(high[t][j], at, values[j])
            yield pd.DataFrame([(t, low[t].tobytes(), high[t].tobytes()) for t in picked], columns=["t", "low", "high"])

        def widest(group: pd.DataFrame) -> pd.DataFrame:
            ends = (np.stack([np.frombuffer(b) for b in group[c]]) for c in ("low", "high"))
            return pd.DataFrame([(group["t"].iloc[0], next(ends).min(axis=0).tobytes(), next(ends).max(axis=0).tobytes())], columns=["t", "low", "high"])

        found = rows.mapInPandas(spans, SPANS).groupBy("t").applyInPandas(widest, SPANS)
        cuts = {t: np.full(picked[t].shape, np.nan) for t in picked}
        for r in found.collect():  # two numbers per open node and drawn feature
            low, high = (np.frombuffer(r[c]).reshape(take, -1).T for c in ("low", "high"))
            wide = low < high
            with np.errstate(invalid="ignore"):
                cut = low + draws[r["t"]][1] * (high - low)
            cuts[r["t"]] = np.where(wide, np.where(cut < high, cut, low), np.nan)
        now = spark.sparkContext.broadcast((router, open_nodes, picked, cuts))

        def sides(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            router, open_nodes, picked, cuts = now.value
            seen = {t: np.zeros(picked[t].size * 2 * k, np.int64) for t in picked}
            for x, y in _batches(parts):
                for t in picked:
                    at, own, values = router.drawn_values(x, t, open_nodes[t], picked[t])
                    for j in range(take):
                        right = values[j] > cuts[t][:, j].take(at)
                        seen[t] += np.bincount(((at * take + j) * 2 + right) * k + y[own], minlength=len(seen[t]))
            wide = NODES * take * 2 * k
            for t in picked:
                yield pd.DataFrame([(t, c, cells.tobytes(), part[cells].tobytes()) for c, part in enumerate(np.split(seen[t], range(wide, len(seen[t]), wide)))
                                    for cells in [np.flatnonzero(part)] if len(cells)], columns=["t", "part", "cells", "n"])

        def choose(group: pd.DataFrame) -> pd.DataFrame:
            t, part = int(group["t"].iloc[0]), int(group["part"].iloc[0])
            cut = now.value[3][t][part * NODES:(part + 1) * NODES]
            counts = np.zeros(cut.size * 2 * k)
            for cells, n in zip(group["cells"], group["n"]):
                counts[np.frombuffer(cells, np.int64)] += np.frombuffer(n, np.int64)
            counts = counts.reshape(len(cut), take, 2, k)
            gain = _spread(counts.sum(axis=2)) - _spread(counts[:, :, 0]) - _spread(counts[:, :, 1])
            j = np.where(np.isnan(cut), -np.inf, gain).argmax(axis=1)  # the first drawn among equals
            i = np.arange(len(cut))
            return pd.DataFrame([(t, part, j.tobytes(), gain[i, j].tobytes(), counts[i, j].tobytes())], columns=["t", "part", "j", "gain", "c"])

        counted = rows.mapInPandas(sides, "t int, part int, cells binary, n binary")
        best = counted.groupBy("t", "part").applyInPandas(choose, "t int, part int, j binary, gain binary, c binary")
        weight = {}
        for r in best.collect():  # one split per open node
            t, j, gain = r["t"], np.frombuffer(r["j"], np.int64), np.frombuffer(r["gain"])
            at, counts = np.arange(len(j)) + r["part"] * NODES, np.frombuffer(r["c"]).reshape(len(j), 2, k)
            good = ~np.isnan(cuts[t][at, j]) & (counts.sum(axis=2) > 0).all(axis=1)
            at, j, gain, counts = at[good], j[good], gain[good], counts[good]
            nodes, f = open_nodes[t][at], picked[t][at, j]
            model.feature[t, nodes], model.threshold[t, nodes] = f, cuts[t][at, j]
            np.add.at(gains[t], f, gain)
            for side in (0, 1):
                model.votes[t, 2 * nodes + side] = counts[:, side] / counts[:, side].sum(axis=1, keepdims=True)
                weight.update(zip(((t, n) for n in (2 * nodes + side).tolist()), counts[:, side]))
    each = gains / np.maximum(gains.sum(axis=1, keepdims=True), 1e-300)
    model.importance = each.sum(axis=0) / max(1, int((gains.sum(axis=1) > 0).sum()))
    return model


def _spread(counts: np.ndarray) -> np.ndarray:
    """Rows times Gini impurity, by the counts of classes."""
    n = counts.sum(axis=-1)
    return n - (counts ** 2).sum(axis=-1) / np.maximum(n, 1)


@dataclass
class Router:
    """The splits above a level, with a leaf's left side being itself and its threshold infinite, so that every row takes as many steps."""

    level: int
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray

    @classmethod
    def of(cls, model: Trees, level: int) -> Router:
        feature = model.feature[:, :1 << level]
        inner, numbers = feature >= 0, np.arange(1 << level)
        return cls(level, np.maximum(feature, 0), np.where(inner, model.threshold[:, :1 << level], np.inf), np.where(inner, 2 * numbers, numbers))

    def drawn_values(self, x: np.ndarray, tree: int, open_nodes: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray | slice, list[np.ndarray]]:
        """Of the rows in an open node: its place among them, which rows they are, and their values of each feature the node has drawn."""
        at, first, flat = np.ones(len(x), np.int64), np.arange(len(x)) * x.shape[1], x.ravel()
        feature, threshold, left = self.feature[tree], self.threshold[tree], self.left[tree]
        for _ in range(self.level):
            at = left.take(at) + (flat.take(first + feature.take(at)) > threshold.take(at))
        slot = np.full(2 << self.level, -1)
        slot[open_nodes] = np.arange(len(open_nodes))
        place = slot.take(at)
        own: np.ndarray | slice = slice(None)
        if (place < 0).any():
            own = np.flatnonzero(place >= 0)
            place, first = place[own], first[own]
        return place, own, [flat.take(first + picked[:, j].take(place)) for j in range(picked.shape[1])]


def predict(df: DataFrame, model: Trees, out: str = "prediction") -> DataFrame:
    """Add the class with the largest mean share, ties to the smaller label; null where a feature is missing."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by trees and depth

    @F.pandas_udf("int")
    def choose(x: pd.Series) -> pd.Series:
        rows = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, len(shared.value.features)))
        return pd.Series([p for at in range(0, len(rows), ROWS) for p in shared.value.shares(rows[at:at + ROWS]).argmax(axis=1).tolist()], dtype="int32")

    vector = F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(float("nan"))) for f in model.features])
    chosen = F.get(F.array(*[F.lit(v) for v in model.labels]), choose(vector))
    return df.withColumn(out, F.when(~F.exists(vector, F.isnan), chosen))
