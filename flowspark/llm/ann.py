"""Approximate nearest neighbours by collision counting on sorted single projections with virtual rehashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.vectors import common_width, stacked, usable
from flowspark.session import settle

PROJECTIONS = 128
THRESHOLD = 0.36  # share of the projections in which a vector must fall into the query's window
FIRST_WINDOW, GROWTH = 0.6, 1.1  # half width of the first window; its growth per round
VERIFIED, SPARE = 8, 0.2  # windows stop growing once this many times k vectors and this share of a block are verified
BLOCK = 16_384  # vectors in a block
ARRAYS = 16  # sorted arrays counted at a time
QUERY_BLOCK = 1024  # queries that meet a block in one task


class CollisionIndex:
    """The sorted projections of one block of vectors.

    Inner product search becomes distance search by one more coordinate: vectors are scaled by the largest component of
    the table and then by the largest norm, and lifted to the unit sphere; queries are scaled alone.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, top: float, top_norm: float, projections: int, seed: int):
        self.ids, self.x = ids, x
        unit = x / top / top_norm
        lift = np.sqrt(np.maximum(0.0, 1.0 - (unit ** 2).sum(axis=1)))
        self.axes = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, projections))
        at = np.column_stack([unit, lift]) @ self.axes
        order = np.argsort(at, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(at.T, order, axis=1)
        self.rank = np.empty(order.shape, np.uint16 if len(x) < 1 << 16 else np.uint32)  # place of each vector in each sorted array
        np.put_along_axis(self.rank, order, np.arange(len(x), dtype=self.rank.dtype)[None], axis=1)

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """In how many sorted arrays each vector lies from place `low` up to `high`."""
        kind = self.rank.dtype
        low, width = low.astype(kind)[:, None], (high - low).astype(kind)[:, None]
        hits = np.zeros(self.rank.shape[1], np.uint16)
        for at in range(0, len(self.rank), ARRAYS):
            inside = self.rank[at:at + ARRAYS] - low[at:at + ARRAYS] < width[at:at + ARRAYS]  # places before `low` wrap round
            hits += np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)
        return hits

    def search(self, query_id: int, q: np.ndarray, k: int, threshold: float, spare: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the best k verified vectors of the block."""
        n, need = len(self.ids), threshold * len(self.rank)
        q_unit = q / np.abs(q).max()
        centre = (q_unit / np.linalg.norm(q_unit)) @ self.axes[:-1]
        half = FIRST_WINDOW
        while True:
            low = np.array([np.searchsorted(s, c - half) for s, c in zip(self.sorted, centre)])
            high = np.array([np.searchsorted(s, c + half, side="right") for s, c in zip(self.sorted, centre)])
            found = np.flatnonzero((self.collisions(low, high) >= need) | ((high - low) == n).all())
            if len(found) >= min(n, VERIFIED * k + 1 + spare * n):
                break
            half *= GROWTH
        found = found[self.ids[found] != query_id]
        with np.errstate(over="ignore", invalid="ignore"):
            score = np.einsum("ij,j->i", self.x[found], q)
        best = np.lexsort((self.ids[found], -score))[:k]
        return self.ids[found][best], score[best]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", column: str = "embedding",
            projections: int = PROJECTIONS, threshold: float = THRESHOLD, spare: float = SPARE, block: int = BLOCK,
            seed: int = 5) -> DataFrame:
    """(query_id, rank, key, score): the k largest inner products found for each query, ties to the smaller key.

    Vectors are dealt into blocks of about `block`; each block sorts its projections on
    `projections` random axes. Around a query's own projection a window opens on every axis; a
    vector that lies in the windows of at least `threshold` of the axes is verified by its exact
    inner product. Until a few times k vectors and `spare` of the block are verified, all windows grow by a
    factor (virtual rehashing). Blocks of queries meet blocks of
    vectors in tasks of bounded memory; a task returns k rows per query, which are merged.

    A vector that is null, zero, of another length than most, or with null or non-finite
    components takes no part on either side; of rows with one key the smallest vector counts; a
    null key takes no part. A query is not its own neighbour. Fewer than k others: all of them.
    Empty tables give an empty result; other columns are ignored.
    """
    def rows(df: DataFrame) -> DataFrame:
        return (df.select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v"))
                .where(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v")))

    data, asked = settle(rows(vectors)), rows(queries)
    width = common_width(data, "v")
    data, asked = data.where(F.size("v") == width), asked.where(F.size("v") == width)
    n, top = data.agg(F.count("*"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / F.lit(top)) * (x / F.lit(top))))
    top_norm = data.agg(F.max(norm)).first()[0]
    asked = settle(asked)
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-asked.count() // QUERY_BLOCK))

    def part(count: int, salt: int):
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(count)).cast("int")

    left = data.select("id", "v", part(blocks, 1).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"))
    right = asked.select("id", "v", part(query_blocks, 2).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))

    def search(base: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "id", "score"]
        if not len(base) or not len(asks):
            return pd.DataFrame({c: np.zeros(0) for c in names}).astype({"query_id": "int64", "id": "int64"})
        base = base.sort_values("id")
        index = CollisionIndex(base["id"].to_numpy(), stacked(base["v"]), top, top_norm, projections, seed)
        found = [(i, *index.search(i, q, k, threshold, spare)) for i, q in zip(asks["id"], stacked(asks["v"]))]
        return pd.DataFrame({"query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]),
                             "id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

    hits = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(search, "query_id bigint, id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(key), "score"))
