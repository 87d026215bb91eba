"""Exact nearest neighbours without comparing every pair of rows.

Training rows are grouped round pivots, about the square root of their number. A group can hold a
neighbour only if the triangle inequality allows it, so each query row visits the groups that may
matter: first the ones that certainly cover k rows, then those the found distance does not rule out. Where that rules out little, as among
vectors of many dimensions, a row per visit would be far more than the rows themselves: blocks of query rows then meet blocks of
training rows, each within the distance its rows have found.
Groups are cut into blocks of bounded size. A block keeps the k best rows so far while it goes through
its rows in chunks, and returns k rows per query row, never its pairs; the best of all blocks are
found by a window that cuts to k rows before its shuffle as well as behind it.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.operators.ordering import hash_key
from flowspark.session import parallelism, settle

BLOCK_ROWS = 20_000  # training rows in one block
SLICE_ROWS = 20_000  # query rows that meet a block in one task
CHUNK_ROWS = 4096  # training rows compared at a time
NUMBERS = 4_000_000  # doubles in a temporary array
MOST_PIVOTS = 1024
SINGLE_ROWS = 32  # query rows whose manhattan distances are summed up at a time, so that they stay in the processor's cache
DENSE = 0.25  # share of all visits of query rows to groups from which every block of rows meets every other instead
SLACK = 1e-9  # room for rounding when a bound rules a group out


def distances(a: np.ndarray, b: np.ndarray, metric: str, p: float) -> np.ndarray:
    """All distances between two sets of vectors; temporary arrays stay below NUMBERS doubles."""
    if metric not in ("euclidean", "manhattan", "minkowski"):
        raise ValueError(f"unknown metric {metric!r}")
    out = np.empty((len(a), len(b)))
    step = max(1, NUMBERS // max(1, b.size))
    for at in range(0, len(a), step):
        gap = np.abs(a[at:at + step, None, :] - b[None, :, :])
        if metric == "euclidean":
            out[at:at + step] = np.sqrt((gap ** 2).sum(axis=2))
        elif metric == "manhattan":
            out[at:at + step] = gap.sum(axis=2)
        else:
            out[at:at + step] = (gap ** p).sum(axis=2) ** (1.0 / p)
    return out


def _first_k(row: np.ndarray, far: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k entries of each row with the least distance, ties by place, in that order."""
    order = np.lexsort((at, far, row))
    row, far, at = row[order], far[order], at[order]
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
    rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
    return row[rank < k], far[rank < k], at[rank < k]


def _pair_distances(a: np.ndarray, b: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Distances of the rows of one array to the same rows of another, as `distances` has them."""
    gap = np.abs(a - b)
    if metric == "euclidean":
        return np.sqrt((gap ** 2).sum(axis=1))
    return gap.sum(axis=1) if metric == "manhattan" else (gap ** p).sum(axis=1) ** (1.0 / p)


def _near(a: np.ndarray, b: np.ndarray, metric: str, p: float) -> tuple[np.ndarray, np.ndarray]:
    """All distances but for rounding, cheaply, and how far off each row of them may be: by a matrix product, or in single precision."""
    if metric == "euclidean":
        square, other = (a ** 2).sum(axis=1), (b ** 2).sum(axis=1)
        d = a @ b.T
        d *= -2
        d += square[:, None]
        d += other[None, :]
        off = 1e-12 * (square + other.max())  # of the squares, so its root of a distance near zero
        return np.sqrt(np.maximum(d - off[:, None], 0, out=d), out=d), np.sqrt(2 * off)
    if metric == "manhattan":
        x, y = a.astype(np.float32), np.ascontiguousarray(b.T, dtype=np.float32)
        d, gap = np.zeros((len(a), len(b)), np.float32), np.empty((SINGLE_ROWS, len(b)), np.float32)
        for at in range(0, len(a), SINGLE_ROWS):
            out = d[at:at + SINGLE_ROWS]
            g = gap[:len(out)]
            for i in range(a.shape[1]):
                np.subtract(x[at:at + SINGLE_ROWS, i, None], y[i], out=g)
                np.abs(g, out=g)
                out += g
        off = 1e-7 * (a.shape[1] + 4) * (np.abs(a).sum(axis=1) + np.abs(b).sum(axis=1).max())
        d -= off.astype(np.float32)[:, None]
        return d, 2 * off
    return distances(a, b, metric, p), np.zeros(len(a))


def nearest_places(asked: np.ndarray, stored: np.ndarray, k: int, metric: str, p: float,
                   reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of asked, distance, place in stored) of the k nearest each, ties to the smaller place.

    Only a chunk of distances and the best so far are held, whatever the sizes. Cheap lower bounds leave few pairs, whose distances are
    then computed in full; `reach` is a distance per row beyond which nothing is wanted.
    """
    parts = []
    step = max(1, NUMBERS // max(1, min(len(stored), CHUNK_ROWS)))
    for low in range(0, len(asked), step):
        some = asked[low:low + step]
        bound = np.full(len(some), np.inf) if reach is None else reach[low:low + step].astype(float)
        best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        for at in range(0, len(stored), CHUNK_ROWS):
            chunk = stored[at:at + CHUNK_ROWS]
            lower, off = _near(some, chunk, metric, p)
            if len(chunk) >= k and np.isinf(bound).any():
                bound = np.fmin(bound, np.partition(lower, k - 1, axis=1)[:, k - 1] + off)
            r, c = np.nonzero(~(lower > (bound * (1 + SLACK) + SLACK)[:, None]))
            pairs = max(1, NUMBERS // max(1, stored.shape[1]))
            d = [_pair_distances(some[r[i:i + pairs]], chunk[c[i:i + pairs]], metric, p) for i in range(0, len(r), pairs)]
            best = _first_k(*(np.concatenate(x) for x in zip(best, (r, np.concatenate(d) if d else np.zeros(0), c + at))), k)
            full = np.flatnonzero(np.bincount(best[0], minlength=len(some)) >= k)
            last = np.zeros(len(some))
            np.maximum.at(last, best[0], best[1])
            bound[full] = np.fmin(bound[full], last[full])
        parts.append((best[0] + low, best[1], best[2]))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else best_of_none()


def best_of_none() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def _in_chunks(v: pd.Series, width: int, each: Callable[[np.ndarray, int], list]) -> list:
    """Results of `each` over row chunks whose distances to `width` points stay below NUMBERS."""
    x, step = _stack(v), max(1, NUMBERS // (8 * max(1, width)))
    return [r for at in range(0, len(x), step) for r in each(x[at:at + step], at)]


def _assign(df: DataFrame, pivots: np.ndarray, metric: str, p: float) -> DataFrame:
    """Nearest pivot of each row and the distance to it."""

    def own(x: np.ndarray, at: int) -> list:
        d = distances(x, pivots, metric, p)
        return list(zip(d.argmin(axis=1).tolist(), d.min(axis=1).tolist()))

    @F.pandas_udf("cell int, radius double")
    def place(v: pd.Series) -> pd.DataFrame:
        found = _in_chunks(v, len(pivots), own) if len(v) else []
        return pd.DataFrame(found, columns=["cell", "radius"]).astype({"cell": "int32", "radius": float})

    return df.withColumn("_place", place("vector")).select("*", "_place.cell", "_place.radius").drop("_place")


def _every_block(asked: DataFrame, asked_rows: int, held: DataFrame, held_rows: int):
    """Slices of SLICE_ROWS query rows (`qkey`) cogrouped with each block of BLOCK_ROWS training rows (`tkey`)."""
    wide = parallelism(asked.sparkSession)
    blocks, slices = max(1, -(-held_rows // BLOCK_ROWS)), max(1, -(-asked_rows // SLICE_ROWS))
    if blocks * slices < wide:
        slices = -(-wide // blocks)
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asked.withColumn("slice", dealt("qkey", slices)).withColumn("block", every(blocks))
    right = held.withColumn("block", dealt("tkey", blocks)).withColumn("slice", every(slices))
    return left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice"))


def nearest_rows(queries: DataFrame, training: DataFrame, key: str, vector: str, label: str, k: int, metric: str = "euclidean",
                 p: float = 2.0, pivots: int | None = None, seed: int = 42, block_rows: int = BLOCK_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The k nearest training rows of each query row: (key, distance, neighbor, label), ties by neighbor key.

    Both keys are unique. Pivots default to the square root of the training rows, MOST_PIVOTS at most.
    """
    spark = queries.sparkSession
    as_doubles = F.col(vector).cast("array<double>").alias("vector")
    q = queries.select(F.col(key).alias("qkey"), as_doubles)
    t = training.select(F.col(key).alias("tkey"), as_doubles, F.col(label).alias("tlabel"))
    candidate_schema = f"qkey {dict(q.dtypes)['qkey']}, distance double, tkey {dict(t.dtypes)['tkey']}, tlabel {dict(t.dtypes)['tlabel']}"
    chosen = t.orderBy(hash_key(seed, ["tkey"]), "tkey").limit(pivots or max(1, min(isqrt(t.count()), MOST_PIVOTS))).collect()
    if not chosen:
        return spark.createDataFrame([], f"{key} {dict(q.dtypes)['qkey']}, rank int, distance double, neighbor {dict(t.dtypes)['tkey']}, label {dict(t.dtypes)['tlabel']}")
    centers = np.array([r["vector"] for r in chosen], dtype=float)
    placed = settle(_assign(t, centers, metric, p))
    groups = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high")).collect()
    cells = sorted((r["cell"], r["n"], r["low"], r["high"]) for r in groups)
    ids = np.array([c[0] for c in cells])
    sizes, low, high = (np.array([c[i] for c in cells], dtype=float) for i in (1, 2, 3))
    need = min(k, int(sizes.sum()))
    blocks = F.broadcast(spark.createDataFrame([(c[0], -(-c[1] // block_rows)) for c in cells], "cell int, blocks long"))  # MOST_PIVOTS rows at most
    stored = placed.join(blocks, "cell").select("tkey", "vector", "tlabel", "cell", F.pmod(F.xxhash64("tkey"), "blocks").alias("block"))

    def bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Least and greatest distance to the rows of each group, groups by least distance, and how many of them cover k rows."""
        d = distances(x, centers[ids], metric, p)
        lower = np.maximum(np.maximum(d - high, low - d), 0)
        order = lower.argsort(axis=1, kind="stable")
        return lower, d + high, order, (np.cumsum(sizes[order], axis=1) >= need).argmax(axis=1)

    def covering(x: np.ndarray, at: int) -> list:
        _, _, order, last = bounds(x)
        return [ids[o[:m + 1]].tolist() for o, m in zip(order, last)]

    def remaining(found: np.ndarray) -> Callable[[np.ndarray, int], list]:
        def pick(x: np.ndarray, at: int) -> list:
            lower, upper, order, last = bounds(x)
            ranked = upper.argsort(axis=1)  # distance within which k rows must lie
            sure = np.take_along_axis(upper, ranked, axis=1)[np.arange(len(x)), (np.cumsum(sizes[ranked], axis=1) >= need).argmax(axis=1)]
            reach = np.minimum(sure, found[at:at + len(x)]) * (1 + SLACK) + SLACK
            return [ids[o[m + 1:][lo[o[m + 1:]] <= r]].tolist() for o, m, lo, r in zip(order, last, lower, reach)]
        return pick

    @F.pandas_udf("array<int>")
    def first_cells(v: pd.Series) -> pd.Series:
        return pd.Series(_in_chunks(v, len(ids), covering) if len(v) else [], dtype=object)

    @F.pandas_udf("array<int>")
    def other_cells(v: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series(_in_chunks(v, len(ids), remaining(found.to_numpy())) if len(v) else [], dtype=object)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:  # `found`, where a query row brings it, bounds what is wanted
        if left.empty or right.empty:
            return pd.DataFrame({"qkey": [], "distance": [], "tkey": [], "tlabel": []})
        right = right.sort_values("tkey", kind="stable")
        reach = left["found"].to_numpy() if "found" in left else None
        row, far, at = nearest_places(_stack(left["vector"]), _stack(right["vector"]), k, metric, p, reach)
        return pd.DataFrame({"qkey": left["qkey"].to_numpy()[row], "distance": far, "tkey": right["tkey"].to_numpy()[at], "tlabel": right["tlabel"].to_numpy()[at]})

    nearest_first = Window.partitionBy("qkey").orderBy("distance", "tkey")

    def search(visits: DataFrame) -> DataFrame:
        """k best rows per query row over the groups it visits, numbered; settled."""
        visits = settle(visits.select("qkey", "vector", F.explode("cells").alias("cell")))
        load = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / slice_rows).alias("slices"))
        plan = F.broadcast(load.join(blocks, "cell"))  # a row per group
        asked = (visits.join(plan, "cell").withColumn("slice", F.pmod(F.xxhash64("qkey"), "slices"))
                 .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))).drop("slices", "blocks")
        held = stored.join(F.broadcast(load), "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
        spots = ["cell", "block", "slice"]
        found = asked.groupBy(*spots).cogroup(held.groupBy(*spots)).applyInPandas(best, candidate_schema)
        return settle(found.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k))

    def meet_all(asked: DataFrame, asked_rows: int) -> DataFrame:
        """k best rows per query row, numbered, every block of BLOCK_ROWS training rows against every slice of SLICE_ROWS query rows."""
        right = placed.select("tkey", "vector", "tlabel")
        found = _every_block(asked, asked_rows, right, int(sizes.sum())).applyInPandas(best, candidate_schema)
        return settle(found.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k))

    first = search(q.withColumn("cells", first_cells("vector")))
    reached = first.groupBy("qkey").agg(F.when(F.count(F.lit(1)) >= need, F.max("distance")).otherwise(float("inf")).alias("found"))
    todo = settle(q.join(reached, "qkey").withColumn("cells", other_cells("vector", "found")))
    visits, asked_rows = todo.agg(F.sum(F.size("cells")), F.count(F.lit(1))).first()
    if (visits or 0) > DENSE * len(cells) * asked_rows:
        final = meet_all(todo.drop("cells"), asked_rows)
    else:
        final = first.unionByName(search(todo.drop("found"))).withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)
    return final.select(F.col("qkey").alias(key), "rank", "distance", F.col("tkey").alias("neighbor"), F.col("tlabel").alias("label"))


def vote(neighbors: DataFrame, key: str, weights: str = "uniform") -> DataFrame:
    """Label with the most votes per query row; ties go to the smaller label.

    `distance` weighs by 1/d; a row at distance 0 leaves the others without a vote.
    """
    if weights == "uniform":
        counted = neighbors.withColumn("_w", F.lit(1.0))
    elif weights == "distance":
        exact = neighbors.groupBy(key).agg(F.min("distance").alias("_low"))
        weight = F.when(F.col("_low") == 0, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
        counted = neighbors.join(exact, key).withColumn("_w", weight)
    else:
        raise ValueError(f"unknown weights {weights!r}")
    totals = counted.groupBy(key, "label").agg(F.sum("_w").alias("_w"))
    return totals.groupBy(key).agg(F.min_by("label", F.struct(-F.col("_w"), F.col("label"))).alias("prediction"))


def knn_classify(queries: DataFrame, training: DataFrame, key: str, vector: str, label: str, k: int = 5, metric: str = "euclidean",
                 p: float = 2.0, weights: str = "uniform", **options) -> DataFrame:
    """(key, prediction) by the vote of the k nearest training rows."""
    return vote(nearest_rows(queries, training, key, vector, label, k, metric, p, **options), key, weights)


def _lsh(training: DataFrame, bucket: float, tables: int, seed: int):
    from pyspark.ml.feature import BucketedRandomProjectionLSH

    return BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(training)


def _side(df: DataFrame, key: str, vector: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))


def approximate_rows(queries: DataFrame, training: DataFrame, key: str, vector: str, threshold: float, bucket: float, tables: int = 3,
                     seed: int = 42) -> DataFrame:
    """Pairs within a euclidean distance by locality-sensitive hashing, for when a miss is allowed."""
    left, right = _side(queries, key, vector), _side(training, key, vector)
    found = _lsh(right, bucket, tables, seed).approxSimilarityJoin(left, right, threshold, "distance")
    return found.select(F.col(f"datasetA.{key}").alias(key), F.col(f"datasetB.{key}").alias("neighbor"), "distance")


def _closest_sharing(left: pd.DataFrame, right: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The least distance, below the threshold, of each query row to a training row with a bucket in common."""
    if left.empty or right.empty:
        return pd.DataFrame({"qkey": [], "nearest": []})
    asked, stored, mine, theirs = _stack(left["vector"]), _stack(right["vector"]), _stack(left["buckets"]), _stack(right["buckets"])
    closest, pairs = np.full(len(asked), np.inf), max(1, NUMBERS // asked.shape[1])
    step = max(1, NUMBERS // min(len(stored), CHUNK_ROWS))
    for low in range(0, len(asked), step):
        best = closest[low:low + step]
        for at in range(0, len(stored), CHUNK_ROWS):
            chunk, theirs_now = stored[at:at + CHUNK_ROWS], theirs[at:at + CHUNK_ROWS]
            lower, _ = _near(asked[low:low + step], chunk, "euclidean", 2.0)
            rows, places = np.nonzero(~(lower > np.minimum(best, threshold)[:, None] * (1 + SLACK) + SLACK))
            for i in range(0, len(rows), pairs):
                r, c = rows[i:i + pairs], places[i:i + pairs]
                shared = (mine[low + r] == theirs_now[c]).any(axis=1)
                r, c = r[shared], c[shared]
                square = np.zeros(len(r))
                for j in range(asked.shape[1]):  # in order, as MLlib adds
                    square += (asked[low + r, j] - chunk[c, j]) ** 2
                far = np.sqrt(square)
                np.minimum.at(best, r[far < threshold], far[far < threshold])
    some = np.isfinite(closest)
    return pd.DataFrame({"qkey": left["qkey"].to_numpy()[some], "nearest": closest[some]})


def approximate_nearest(queries: DataFrame, training: DataFrame, key: str, vector: str, threshold: float, bucket: float, tables: int = 3,
                        seed: int = 42) -> DataFrame:
    """(key, nearest): least distance of the pairs of `approximate_rows`, for query rows that have one.

    Where buckets hold much of the table, their pairs are never rows: blocks of query rows meet blocks of training rows, and each returns one
    row per query row. Few pairs are joined by their buckets.
    """
    from pyspark.ml.functions import vector_to_array

    model = _lsh(_side(training, key, vector), bucket, tables, seed)

    def hashed(df: DataFrame, name: str) -> DataFrame:
        h = F.array(*[F.get(vector_to_array(F.get("h", F.lit(i))), F.lit(0)) for i in range(tables)])
        return settle(model.transform(_side(df, key, vector)).select(F.col(key).alias(name), vector_to_array("v").alias("vector"), h.alias("buckets")))

    left, right = hashed(queries, "qkey"), hashed(training, "tkey")
    sizes = lambda d, n: d.select(F.posexplode("buckets").alias("table", "bucket")).groupBy("table", "bucket").agg(F.count(F.lit(1)).alias(n))
    pairs = sizes(left, "a").join(sizes(right, "b"), ["table", "bucket"]).agg(F.sum(F.col("a").cast("double") * F.col("b"))).first()[0] or 0.0
    asked_rows, held_rows = left.count(), right.count()
    if pairs > DENSE * asked_rows * held_rows:
        schema = f"qkey {dict(left.dtypes)['qkey']}, nearest double"
        found = _every_block(left, asked_rows, right, held_rows).applyInPandas(lambda a, b: _closest_sharing(a, b, threshold), schema)
        return found.groupBy(F.col("qkey").alias(key)).agg(F.min("nearest").alias("nearest"))
    return approximate_rows(queries, training, key, vector, threshold, bucket, tables, seed).groupBy(key).agg(F.min("distance").alias("nearest"))
