"""Embedding near-duplicates by spherical-cap filters: random product codes, list decoding, join on filters, verification."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.components import components
from flowspark.llm.vectors import common_width, stacked, usable
from flowspark.session import settle

PARTS = 4  # blocks of coordinates, each with a code of its own
FILTERS = 32  # filters a vector exceeds, as expected for random vectors
LEAST = 20  # filters every vector gets, by a lower bar of its own if need be
BLOCK = 1024  # vectors of a filter that meet in one matrix


class ProductCode:
    """Filter directions: every combination of one random unit vector per block of rotated coordinates."""

    def __init__(self, width: int, words: int, expected: float, seed: int):
        rng = np.random.default_rng(seed)
        self.words, self.padded = words, -(-width // PARTS) * PARTS
        self.rotation = np.linalg.qr(rng.standard_normal((self.padded, self.padded)))[0][:width]
        code = rng.standard_normal((PARTS, self.padded // PARTS, words))
        self.code = code / np.linalg.norm(code, axis=1, keepdims=True)
        share = min(0.5, expected / words ** PARTS)
        self.bar = NormalDist().inv_cdf(1 - share) / np.sqrt(self.padded) * np.sqrt(PARTS)

    def exceeded(self, units: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the sorted numbers of all filters whose cap it lies in.

        The blocks' products are added in two halves; with one half in order, each sum of the
        other finds its partners above the bar by bisection. Where fewer than LEAST filters are
        exceeded the vector's bar sinks in steps: near vectors sink alike.
        """
        y = (units @ self.rotation).reshape(len(units), PARTS, -1)
        dots = np.einsum("npd,pdw->npw", y, self.code)
        first = (dots[:, 0, :, None] + dots[:, 1, None, :]).reshape(len(units), -1)
        second = (dots[:, 2, :, None] + dots[:, 3, None, :]).reshape(len(units), -1)
        order = np.argsort(-second, axis=1, kind="stable")
        found = []
        for a, b, o in zip(first, np.take_along_axis(second, order, axis=1), order):
            bar = self.bar
            while (reach := np.searchsorted(-b, a - bar, side="right")).sum() < LEAST:
                bar -= 0.05
            left = np.repeat(np.arange(len(a)), reach)
            right = o[np.arange(len(left)) - np.repeat(np.cumsum(reach) - reach, reach)]
            found.append(np.sort(left * len(b) + right))
        return found


def _filters_shared_below(lists: list[np.ndarray], here: int) -> np.ndarray:
    """For each two vectors whether they share a filter smaller than `here`."""
    below = [f[: np.searchsorted(f, here)] for f in lists]
    names, at = np.unique(np.concatenate(below), return_inverse=True)
    member = np.zeros((len(lists), len(names)), np.float32)
    member[np.repeat(np.arange(len(lists)), [len(f) for f in below]), at] = 1
    return member @ member.T > 0


def _forest(near: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of a symmetric link matrix."""
    rest, links = np.ones(len(ids), bool), []
    for start in np.flatnonzero(near.any(axis=1)):
        if not rest[start]:
            continue
        rest[start], frontier = False, [start]
        while frontier:
            x = frontier.pop()
            new = np.flatnonzero(near[x] & rest)
            rest[new] = False
            links += [(ids[x], ids[y]) for y in new]
            frontier += new.tolist()
    return links


def _meet(cell: tuple, ids: np.ndarray, block: np.ndarray, weight: np.ndarray, unit: np.ndarray, filters: list, bar: float) -> list[tuple]:
    """Links among the vectors of one filter, or between two blocks of them: (kind, id, weight or other id)."""
    _, here, first, second = cell
    near = unit @ unit.T >= bar - 1e-9
    np.fill_diagonal(near, False)
    if first != second:  # pairs inside either block belong to that block's own task
        near &= block[:, None] != block[None, :]
    rows = np.flatnonzero(near.any(axis=1))
    if not len(rows):
        return []
    near, ids, weight, unit = near[np.ix_(rows, rows)], ids[rows], weight[rows], unit[rows]
    i, j = np.nonzero(np.triu(near))
    exact = np.einsum("ij,ij->i", unit[i], unit[j]) >= bar
    near[i[~exact], j[~exact]] = near[j[~exact], i[~exact]] = False
    own = near & ~_filters_shared_below([np.asarray(filters[r]) for r in rows], here)
    counts = own @ weight
    return [(0, ids[r], counts[r]) for r in np.flatnonzero(counts)] + [(1, a, b) for a, b in _forest(near, ids)]


def near_vectors(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", column: str = "embedding", label: str = "label",
                 expected: float = FILTERS, block: int = BLOCK, seed: int = 3) -> DataFrame:
    """(key, n_links, component_id, kept): links of equal label and cosine >= threshold, in double precision.

    Equal vectors of a label are one class with a weight. A class enters every filter of a
    random product code whose direction it exceeds (the number of directions follows the number
    of classes), classes meet by a join on (label, filter), and meetings are verified exactly. A
    pair counts only at the smallest filter it shares. A filter with over `block` classes is
    split into pairs of blocks, one task's matrix each, and a task returns counts and spanning
    links, never pairs: a crowd of near copies costs matrix products but no rows.

    A vector that is null, zero, of another length than most or with null or non-finite
    components, and one without a label, links with nothing and is kept; rows of one key and
    vector are copies and link with each other only through other keys. Empty tables give an
    empty result; other columns are ignored.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(column).cast("array<double>").alias("v"))
    valid = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    classes = valid.groupBy("label", "v").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("weight"))
    classes = settle(classes.withColumn("id", F.xxhash64("label", "v")))
    width = common_width(classes, "v")
    classes = classes.where(F.size("v") == width)
    n = classes.count()
    code = ProductCode(max(1, width), max(8, round(2 * n ** (1 / PARTS))), expected, seed)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 512):
                part = frame.iloc[at:at + 512]
                v = stacked(part["v"])
                v /= np.abs(v).max(axis=1, keepdims=True)  # neither tiny nor huge components leave the range of squares
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                yield pd.DataFrame({"label": part["label"].to_numpy(), "id": part["id"].to_numpy(), "weight": part["weight"].to_numpy(),
                                    "u": list(v), "f": code.exceeded(v)})

    kind = classes.schema["label"].dataType.simpleString()
    decoded = classes.select("label", "id", "weight", "v").mapInPandas(decode, f"label {kind}, id bigint, weight bigint, u array<double>, f array<bigint>")
    decoded = settle(decoded)
    entered = decoded.select("label", "id", "weight", "u", "f", F.explode("f").alias("filter"))
    crowd = (decoded.select("label", F.explode("f").alias("filter")).groupBy("label", "filter").agg(F.count("*").alias("n")).where("n > 1")
             .withColumn("blocks", F.ceil(F.col("n") / block).cast("int")))
    met = entered.join(crowd, ["label", "filter"]).withColumn("block", F.pmod("id", "blocks").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    cells = ["label", "filter", "i", "j"]

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def met_in(frame: pd.DataFrame, bounds: list[int]) -> pd.DataFrame:
            cell = list(frame[cells].itertuples(index=False, name=None))
            ids, block, weight = (frame[c].to_numpy() for c in ("id", "block", "weight"))
            unit, filters = stacked(frame["u"]), frame["f"].tolist()
            found = [r for a, b in zip(bounds, bounds[1:]) if b - a > 1
                     for r in _meet(cell[a], ids[a:b], block[a:b], weight[a:b], unit[a:b], filters[a:b], threshold)]
            return pd.DataFrame(found, columns=["kind", "a", "b"], dtype="int64")

        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            cell = frame[cells].to_numpy()
            cuts = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1
            if not len(cuts):
                held = frame
                continue
            held = frame.iloc[cuts[-1]:]
            yield met_in(frame.iloc[:cuts[-1]], [0, *cuts.tolist()])
        if held is not None:
            yield met_in(held, [0, len(held)])

    links = settle(met.select(*cells, "block", "id", "weight", "u", "f").repartition(*cells).sortWithinPartitions(*cells, "id")
                   .mapInPandas(verify, "kind int, a bigint, b bigint"))
    counts = links.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("linked"))
    groups = components(links.where("kind = 1").select("a", "b")).withColumnRenamed("component_id", "root")
    named = classes.join(counts, "id", "left").join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lows = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(lows, "root").select("label", "v", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n"), "component_id")
    return rows.join(named, ["label", "v"], "left").select(
        F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(True)).alias("kept"))
