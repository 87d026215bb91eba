"""Random forests grown until leaves are pure, kept as a table: neither the rows nor a tree pass through the driver.

Features become bins by quantiles of all rows, as in MLlib, whose defaults hold here as well: 32 bins, Poisson bootstraps, the square
root of the features per node, Gini impurity. Rows of equal bins and label are one row with a count, and rows of equal bins are judged
once. Nodes of more than LOCAL_ROWS rows are split by histograms, one pass and one aggregate a
level. A smaller one is a bounded group, (tree, node): its rows meet in one task, which grows what lies below and returns it as one row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import TypeConverters
from pyspark.ml.param.shared import HasProbabilityCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.plans.estimators import _Columns, _param
from flowspark.session import parallelism, settle

BINS = 32
LOCAL_ROWS = 50_000  # rows of a node that one task may finish
BLOCK = 2048  # rows that meet a part of a tree at a time
PART = "t int, node long, feature binary, cut binary, child binary, share binary, gains array<double>"
HELD = 64 << 20  # bytes of coded tables that every task may hold, about
SIDE_ROWS = 50_000  # rows whose trees grow side by side in a task, about
SUMMED = 64  # copies of a row up to which their bootstraps are drawn one by one and added
DENSE = 4  # cells of a histogram for each row, at most; where nodes are smaller, rows are sorted
EXACT = 2 ** 26  # rows whose squares add up exactly
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])  # of mean 1


def _uniform(ids: np.ndarray, number: int) -> np.ndarray:
    """A number from 0 to 1 per row, by a hash of the row and a number."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) + np.uint64((number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def copies(ids: np.ndarray, n: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree's bootstrap takes rows that occur `n` times: Poisson of mean n, the same in every run."""
    base, many = (seed << 40) + (tree << 8), n > SUMMED
    out = np.zeros(len(ids))
    left = np.flatnonzero(~many)
    for i in range(SUMMED):
        left = left[n[left] > i]
        if not len(left):
            break
        out[left] += np.searchsorted(POISSON, _uniform(ids[left], base + i), side="right")
    for i in np.flatnonzero(many):
        out[i] = np.random.default_rng([seed, tree, int(ids[i]) & (1 << 64) - 1]).poisson(n[i])
    return out


def _score(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What a split leaves of purity, higher is better; below every other where a side is empty."""
    a, b = left.sum(axis=-1), right.sum(axis=-1)
    return np.where((a > 0) & (b > 0), (left ** 2).sum(axis=-1) / np.maximum(a, 1) + (right ** 2).sum(axis=-1) / np.maximum(b, 1), -1.0)


Cuts = tuple[np.ndarray, np.ndarray, np.ndarray]  # nodes, how pure their best cut leaves them less how pure they are, its bin


def _tops(fall: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of the first of the greatest values of each stretch, which begin at the places `first`."""
    top = np.maximum.reduceat(fall, first)
    hit = np.flatnonzero(fall == np.repeat(top, np.diff(np.append(first, len(fall)))))
    return hit[np.searchsorted(hit, first)]


def _starts(numbers: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))


def _dense_cuts(at: np.ndarray, y: np.ndarray, w: np.ndarray, counts: np.ndarray, parent: np.ndarray) -> Callable[[np.ndarray], Cuts]:
    """The best cuts of nodes by the bins of their rows, from a histogram of the cells (node, bin) that occur and classes."""
    nodes, classes = counts.shape

    def cuts(b: np.ndarray) -> Cuts:
        cell, seen = at * BINS + b, np.zeros(nodes * BINS, bool)
        seen[cell] = True
        used = np.flatnonzero(seen)
        node = used // BINS
        own = np.bincount((np.cumsum(seen) - 1)[cell] * classes + y, w, len(used) * classes).reshape(-1, classes)
        first = _starts(node)
        total_left = np.cumsum(own, axis=0)
        left = total_left - np.repeat(total_left[first] - own[first], np.diff(np.append(first, len(node))), axis=0)
        fall = _score(left, counts[node] - left) - parent[node]
        top = _tops(fall, first)
        return node[first], fall[top], used[top] % BINS

    return cuts


def _sparse_cuts(at: np.ndarray, y: np.ndarray, w: np.ndarray, counts: np.ndarray, parent: np.ndarray) -> Callable[[np.ndarray], Cuts]:
    """As `_dense_cuts`, where nodes hold few rows a class: sums of squares move row by row.

    Rows are put in order of (node, class, bin) for the counts of their class to the left, then of (node, bin). Numbers of rows sort with
    them in the low bits. Either order leaves the stretches of nodes and classes in place, so that what was before them is known.
    """
    classes, size, bits = counts.shape[1], len(at), len(at).bit_length()
    group, low = at * classes + y, (1 << bits) - 1
    order = group.argsort(kind="stable")
    group_at, node_at, number = group[order], at[order], np.arange(size)
    by_class, by_node = ((group * BINS) << bits) + number, ((node_at * BINS) << bits) + number
    before = lambda sums: np.cumsum(sums) - sums
    sums, total, squares = counts.ravel(), counts.sum(axis=1), (counts ** 2).sum(axis=1)
    class_before, class_sum = before(sums)[group_at], sums[group_at]
    rows_before, rows_sum, squares_before, squares_sum, pure = before(total)[node_at], total[node_at], before(squares)[node_at], squares[node_at], parent[node_at]
    first = _starts(node_at)

    def cuts(b: np.ndarray) -> Cuts:
        found = np.sort(by_class + (b << bits))
        own = w[found & low]
        left = np.cumsum(own) - own - class_before
        found = np.sort(by_node + ((found >> bits) % BINS << bits))
        place, cell = found & low, found >> bits
        a = np.cumsum(own[place]) - rows_before
        plus = np.cumsum((own * (2 * left + own))[place]) - squares_before
        minus = np.cumsum((own * (2 * (class_sum - left) - own))[place]) - squares_before
        rest = rows_sum - a
        fall = np.where(rest > 0, plus / a + (squares_sum - minus) / np.maximum(rest, 1), -1.0) - pure
        fall[:-1][cell[1:] == cell[:-1]] = -np.inf  # a cut is behind the last row of a bin
        top = _tops(fall, first)
        return node_at[first], fall[top], cell[top] % BINS

    return cuts


def _levels(x: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, classes: int, take: int, levels: int, draws: list[np.random.Generator]) -> Iterator[tuple]:
    """Grow trees side by side, all nodes of a level at once: (tree, class counts, feature or -1, greatest bin to the left, fall of impurity) by open node.

    Row i is one of tree `at[i]`, whose features are drawn by `draws[at[i]]`: a tree is the same whatever others it grows beside.
    """
    rows, tree, exact = np.arange(len(x)), np.arange(len(draws)), w.sum() < EXACT
    for level in range(levels + 1):
        open_nodes = len(tree)
        own_y, own_w = y[rows], w[rows]
        counts = np.bincount(at * classes + own_y, own_w, open_nodes * classes).reshape(open_nodes, classes)
        total = counts.sum(axis=1)
        best, best_f, best_cut = np.zeros(open_nodes), np.full(open_nodes, -1), np.zeros(open_nodes, np.int64)
        if level < levels:
            node_mixed = (counts > 0).sum(axis=1) > 1
            mixed = node_mixed[at]
            rows, at, own_y, own_w = rows[mixed], at[mixed], own_y[mixed], own_w[mixed]
            parent = (counts ** 2).sum(axis=1) / np.maximum(total, 1)
            held = counts * node_mixed[:, None]
            chance = np.concatenate([rng.random((n, x.shape[1])) for rng, n in zip(draws, np.bincount(tree, minlength=len(draws)))])
            picked = np.zeros((open_nodes, take), np.int64)
            picked[node_mixed] = chance[node_mixed].argsort(axis=1)[:, :take]
            sparse = exact and int(node_mixed.sum()) * BINS * classes > DENSE * len(rows)
            cuts = (_sparse_cuts if sparse else _dense_cuts)(at, own_y, own_w, held, parent) if len(rows) else None
            for j in range(take if len(rows) else 0):
                n, fall, cut = cuts(x[rows, picked[at, j]].astype(np.int64))
                better = fall > np.maximum(best[n], 1e-9 * total[n])
                n = n[better]
                best[n], best_f[n], best_cut[n] = fall[better], picked[n, j], cut[better]
        split = best_f >= 0
        yield tree, counts, best_f, best_cut, best
        if not split.any():
            break
        rank, keep = np.cumsum(split) - 1, split[at]
        rows, at = rows[keep], at[keep]
        at = 2 * rank[at] + (x[rows, best_f[at]] > best_cut[at])
        tree = np.repeat(tree[split], 2)


def grow_part(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, take: int, levels: int, rng: np.random.Generator) -> tuple:
    """(feature or -1, greatest bin to the left, left child, class shares) by node and the fall of impurity by feature, of one tree."""
    feature, cut, child, share, gains, size = [], [], [], [], np.zeros(x.shape[1]), 1
    for _, counts, best_f, best_cut, best in _levels(x, y, w, np.zeros(len(x), np.int64), classes, take, levels, [rng]):
        split = best_f >= 0
        np.add.at(gains, best_f[split], best[split])
        feature.append(best_f.astype(np.int32))
        cut.append(best_cut.astype(np.uint8))
        child.append(np.where(split, size + 2 * (np.cumsum(split) - 1), 0).astype(np.int32))
        share.append((counts / counts.sum(axis=1)[:, None]).astype(np.float32))
        size += 2 * int(split.sum())
    return (*(np.concatenate(c) for c in (feature, cut, child, share)), gains)


def gains_of(x: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, classes: int, take: int, levels: int, draws: list[np.random.Generator]) -> np.ndarray:
    """The fall of impurity by feature of each of several trees, which `grow_part` gives one by one; row i is one of tree `at[i]`."""
    gains = np.zeros((len(draws), x.shape[1]))
    for tree, _, best_f, _, best in _levels(x, y, w, at, classes, take, levels, draws):
        split = best_f >= 0
        np.add.at(gains, (tree[split], best_f[split]), best[split])
    return gains


def shares_of(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Class shares of the leaf that each row ends in."""
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows):
        rows = rows[feature[at[rows]] >= 0]
        n = at[rows]
        at[rows] = child[n] + (x[rows, feature[n]] > cut[n])
    return share[at]


def route(x: np.ndarray, top: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The node below the upper splits of a tree (their numbers in order, feature, cut) that each row belongs to; the root is 1, its sides 2 and 3."""
    numbers, feature, cut = top
    at, rows = np.ones(len(x), np.int64), np.arange(len(x)) if len(numbers) else np.zeros(0, np.int64)
    while len(rows):
        place = np.minimum(np.searchsorted(numbers, at[rows]), len(numbers) - 1)
        inner = numbers[place] == at[rows]
        rows, place = rows[inner], place[inner]
        at[rows] = 2 * at[rows] + (x[rows, feature[place]] > cut[place])
    return at


def _bins(x: Column, cuts: list[np.ndarray]) -> Column:
    """The bins of the features, a byte each."""

    @F.pandas_udf("binary")
    def place(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        values = np.stack(x.to_numpy()).astype(float)
        return pd.Series([r.tobytes() for r in np.stack([np.searchsorted(c, values[:, i]) for i, c in enumerate(cuts)], axis=1).astype(np.uint8)])

    return place(x)


def _matrix(blobs: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)


def _by_node(at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = at.argsort(kind="stable")
    numbers, first = np.unique(at[order], return_index=True)
    return zip(numbers.tolist(), np.split(order, first[1:]))


class DeepForest(Estimator, _Columns, HasProbabilityCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random forest for labels 0, 1, 2, ... Rows without a label are passed over."""

    numTrees = _param("numTrees", "trees", TypeConverters.toInt)
    maxDepth = _param("maxDepth", "most levels below the root", TypeConverters.toInt)
    seed = _param("seed", "seed of bootstraps and draws", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability", numTrees=100, maxDepth=30, seed=42):
        super().__init__()
        self._setDefault(numTrees=100, maxDepth=30, seed=42)
        self._take(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> DeepForestModel:
        coded, cuts, k = self.coded(dataset)
        binned = settle(_counted(coded.withColumn("n", F.lit(1))))
        parts, tops, upper = self.grown(binned, binned.count(), len(cuts), k, PART)
        parts = settle(parts)
        model = DeepForestModel(parts)
        model._set(classes=k, cuts=[c.tolist() for c in cuts], tops=[[a.tolist() for a in t] for t in tops], importances=importance_of(parts, upper).tolist())
        return self._copyValues(model)

    def coded(self, dataset: DataFrame) -> tuple[DataFrame, list[np.ndarray], int]:
        """Labels and bins of the labelled rows, the bounds of the bins, the number of classes."""
        label = F.col(self.getLabelCol()).cast("double")
        rows = dataset.where(label.isNotNull()).select(label.cast("int").alias("y"), vector_to_array(F.col(self.getFeaturesCol())).alias("x"))
        head = rows.select(F.size("x")).first()
        if head is None:
            raise ValueError("no labelled row")
        quantiles = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
        found = rows.agg(F.min("y"), F.max("y"), *[F.percentile_approx(F.get("x", F.lit(i)), quantiles, F.lit(10_000)) for i in range(head[0])]).first()
        low, high, *cuts = found
        if low < 0:
            raise ValueError("labels must be 0, 1, 2, ...")
        cuts = [np.unique(np.array(c, float)) for c in cuts]
        return rows.select("y", _bins(F.col("x"), cuts).alias("bins")), cuts, high + 1

    def taken(self, d: int) -> int:
        """Features that a node of a tree over `d` features draws."""
        return d if self.getOrDefault(self.numTrees) == 1 else math.ceil(math.sqrt(d))

    def grown(self, binned: DataFrame, size: int, d: int, k: int, returned: str) -> tuple[DataFrame, list[tuple], np.ndarray]:
        """The trees over a table of `size` counted rows below their upper splits (the columns of PART named in `returned`), these splits, and the fall of impurity they bring."""
        spark, take = binned.sparkSession, self.taken(d)
        trees, depth, seed = (self.getOrDefault(p) for p in (self.numTrees, self.maxDepth, self.seed))
        tops = [tuple(np.zeros(0, np.int64) for _ in range(3)) for _ in range(trees)]
        upper = np.zeros((trees, d))
        if size > LOCAL_ROWS:
            tops, upper = _upper(binned, trees, depth, d, k, take, seed)
        shared = spark.sparkContext.broadcast(tops)  # a few splits a tree: those of nodes of more than LOCAL_ROWS rows
        names = [c.split()[0] for c in returned.split(", ")]

        def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                ids, n, y, x = part["id"].to_numpy(), part["n"].to_numpy(), part["y"].to_numpy(np.int32), _matrix(part["bins"], d)
                out = []
                for t in range(trees):
                    w = copies(ids, n, t, seed)
                    own = np.flatnonzero(w)
                    for node, at in _by_node(route(x[own], shared.value[t])):
                        at = own[at]
                        out.append((t, node, y[at].tobytes(), w[at].tobytes(), x[at].tobytes()))
                yield pd.DataFrame(out, columns=["t", "node", "y", "w", "bins"])

        def finish(group: pd.DataFrame) -> pd.DataFrame:
            t, node = int(group["t"].iloc[0]), int(group["node"].iloc[0])
            y, w = (np.frombuffer(b"".join(group[c]), kind) for c, kind in (("y", np.int32), ("w", float)))
            *arrays, gains = grow_part(_matrix(group["bins"], d), y.astype(np.int64), w, k, take, depth + 1 - node.bit_length(), np.random.default_rng([seed, t, node]))
            return pd.DataFrame([(t, node, *[a.tobytes() for a in arrays], gains.tolist())], columns=["t", "node", "feature", "cut", "child", "share", "gains"])[names]

        dealt = binned.mapInPandas(deal, "t int, node long, y binary, w binary, bins binary").repartition(parallelism(spark), "t", "node")
        return dealt.groupBy("t", "node").applyInPandas(finish, returned), tops, upper


def _counted(coded: DataFrame) -> DataFrame:
    """Rows of equal bins and label as one, with their number and what their bootstraps are drawn by."""
    return coded.groupBy("y", "bins").agg(F.sum("n").alias("n")).withColumn("id", F.xxhash64("y", "bins"))


def importance_of(parts: DataFrame, upper: np.ndarray) -> np.ndarray:
    """Importance by feature, the same weight for each tree: `upper` is the fall of impurity by tree and feature above the parts."""
    for r in parts.groupBy("t").agg(*[F.sum(F.get("gains", F.lit(i))) for i in range(upper.shape[1])]).collect():
        upper[r[0]] += np.array(r[1:], float)
    return shared_out(upper)


def shared_out(gains: np.ndarray) -> np.ndarray:
    """Importance by feature from the fall of impurity by tree and feature."""
    share = gains / np.maximum(gains.sum(axis=1, keepdims=True), 1e-300)
    return share.sum(axis=0) / max(share.sum(), 1e-300)


def row_hashes(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """`F.xxhash64` of a label and the bytes of a row, of many rows at once."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, by: (v << np.uint64(by)) | (v >> np.uint64(64 - by))

    def mixed(h: np.ndarray) -> np.ndarray:
        for shift, factor in ((33, p2), (29, p3)):
            h = (h ^ (h >> np.uint64(shift))) * factor
        return h ^ (h >> np.uint64(32))

    d = x.shape[1]
    x = np.ascontiguousarray(np.pad(x, ((0, 0), (0, -d % 8))))
    words, halves = x.view("<u8").astype(np.uint64), x.view("<u4").astype(np.uint64)
    with np.errstate(over="ignore"):
        h = mixed(turn(np.uint64(42) + p5 + np.uint64(4) ^ y.astype(np.uint32).astype(np.uint64) * p1, 23) * p2 + p3)
        done = d // 32 * 4
        if done:
            lanes = [h + p1 + p2, h + p2, h, h - p1]
            for i in range(done):
                lanes[i % 4] = turn(lanes[i % 4] + words[:, i] * p2, 31) * p1
            h = sum((turn(v, by) for v, by in zip(lanes, (1, 7, 12, 18))), np.uint64(0))
            for v in lanes:
                h = (h ^ turn(v * p2, 31) * p1) * p1 + p4
        else:
            h = h + p5
        h = h + np.uint64(d)
        for i in range(done, d // 8):
            h = turn(h ^ turn(words[:, i] * p2, 31) * p1, 27) * p1 + p4
        at = d // 8 * 8
        if at + 4 <= d:
            h, at = turn(h ^ halves[:, at // 4] * p1, 23) * p2 + p3, at + 4
        for i in range(at, d):
            h = turn(h ^ x[:, i].astype(np.uint64) * p5, 11) * p1
        return mixed(h).astype(np.int64)


def merged(y: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What `_counted` gives, of rows in memory: labels, bins, counts and hashes."""
    ids = row_hashes(y, x)
    if len(np.unique(ids)) == len(ids):
        return y, x, n, ids
    whole = np.ascontiguousarray(np.concatenate([y.astype("<i4")[:, None].view(np.uint8), x], axis=1))
    _, first, place = np.unique(whole.view(f"V{whole.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return y[first], x[first], np.bincount(place, n, len(first)).astype(np.int64), ids[first]


class Rounds:
    """Importances of the features left, as `DeepForest` fits find them, for several tables round by round.

    Bins are found once a table. A table of at most LOCAL_ROWS counted rows, which is what one task may finish of a tree, is sent to the
    tasks whole if all fit in HELD; these grow the trees of all such tables in one job a round, many at a time, and return the fall of impurity. The
    trees of a larger one are grown as in a fit, without being kept.
    """

    def __init__(self, forest: DeepForest, tables: Sequence[DataFrame], parallel: int = 4):
        self.forest, self.spark, self.parallel = forest, tables[0].sparkSession, parallel

        def begin(table: DataFrame) -> tuple:
            coded, cuts, k = forest.coded(table)
            whole = settle(_counted(coded.withColumn("n", F.lit(1)))).drop("id")
            most = min(LOCAL_ROWS, HELD // (len(tables) * (len(cuts) + 16)))
            head = whole.limit(most + 1).toPandas()
            if len(head) > most:
                return whole, None, len(cuts), k
            return whole, (head["y"].to_numpy(np.int64), _matrix(head["bins"], len(cuts)), head["n"].to_numpy(np.int64)), len(cuts), k

        with ThreadPoolExecutor(parallel) as pool:
            self.tables = list(pool.map(begin, tables))
        self.held = self.spark.sparkContext.broadcast({i: (small, k) for i, (_, small, _, k) in enumerate(self.tables) if small})

    def importances(self, left: Sequence[Sequence[int]]) -> list[np.ndarray]:
        """Importances by table, of the features at the places `left` of it."""
        small = [i for i, t in enumerate(self.tables) if t[1]]
        large = [i for i, t in enumerate(self.tables) if not t[1]]
        found = self._side_by_side(small, left) if small else {}
        with ThreadPoolExecutor(self.parallel) as pool:
            found.update(zip(large, pool.map(lambda i: self._alone(i, left[i]), large)))
        return [found[i] for i in range(len(left))]

    def _side_by_side(self, small: list[int], left: Sequence[Sequence[int]]) -> dict[int, np.ndarray]:
        forest, held = self.forest, self.held
        trees, depth, seed = (forest.getOrDefault(p) for p in (forest.numTrees, forest.maxDepth, forest.seed))
        take = {i: forest.taken(len(left[i])) for i in small}
        columns = {i: list(left[i]) for i in small}

        def rate(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                number = part["id"].to_numpy()
                for i, own in _by_node(number // trees):
                    (y, x, n), k = held.value[small[i]]
                    y, x, n, ids = merged(y, np.ascontiguousarray(x[:, columns[small[i]]]), n)
                    step = max(1, SIDE_ROWS // len(y))
                    for low in range(0, len(own), step):
                        drawn = (number[own[low:low + step]] % trees).tolist()
                        w = np.stack([copies(ids, n, t, seed) for t in drawn])
                        at, rows = np.nonzero(w)
                        gains = gains_of(x[rows], y[rows], w[at, rows], at, k, take[small[i]], depth, [np.random.default_rng([seed, t, 1]) for t in drawn])
                        yield pd.DataFrame({"i": small[i], "t": drawn, "gains": list(gains)})

        asked = self.spark.range(0, len(small) * trees, 1, parallelism(self.spark))
        rows = asked.mapInPandas(rate, "i int, t int, gains array<double>").collect()  # a few numbers a tree
        falls = {i: np.zeros((trees, len(columns[i]))) for i in small}
        for r in rows:
            falls[r["i"]][r["t"]] = r["gains"]
        return {i: shared_out(f) for i, f in falls.items()}

    def _alone(self, i: int, left: Sequence[int]) -> np.ndarray:
        whole, _, width, k = self.tables[i]

        @F.pandas_udf("binary")
        def kept(bins: pd.Series) -> pd.Series:
            return pd.Series([r.tobytes() for r in _matrix(bins, width)[:, left]], dtype=object)

        binned = _counted(whole.withColumn("bins", kept("bins"))).persist(StorageLevel.DISK_ONLY)
        try:
            parts, _, upper = self.forest.grown(binned, binned.count(), len(left), k, "t int, gains array<double>")
            return importance_of(parts, upper)
        finally:
            binned.unpersist()

    def close(self) -> None:
        """Let the tasks forget the tables."""
        self.held.unpersist()


def _upper(binned: DataFrame, trees: int, depth: int, d: int, k: int, take: int, seed: int) -> tuple[list[tuple], np.ndarray]:
    """The splits of nodes of more than LOCAL_ROWS rows, by tree, and the fall of impurity they bring."""
    spark = binned.sparkSession
    splits: list[dict[int, tuple[int, int]]] = [{} for _ in range(trees)]
    gains, live = np.zeros((trees, d)), {t: [1] for t in range(trees)}
    as_arrays = lambda s: (np.array(sorted(s), np.int64), np.array([s[i][0] for i in sorted(s)], np.int64), np.array([s[i][1] for i in sorted(s)], np.int64))
    for _ in range(depth):
        if not live:
            break
        picked = {t: np.array([np.random.default_rng([seed, t, i, 1]).permutation(d)[:take] for i in nodes]) for t, nodes in live.items()}
        now = spark.sparkContext.broadcast(({t: np.array(nodes) for t, nodes in live.items()}, picked, {t: as_arrays(splits[t]) for t in live}))

        def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            nodes, picked, tops = now.value
            held = {t: np.zeros(picked[t].size * BINS * k) for t in nodes}
            for part in parts:
                ids, n, y, x = part["id"].to_numpy(), part["n"].to_numpy(), part["y"].to_numpy(np.int64), _matrix(part["bins"], d)
                for t in nodes:
                    w, at = copies(ids, n, t, seed), route(x, tops[t])
                    place = np.minimum(np.searchsorted(nodes[t], at), len(nodes[t]) - 1)
                    own = np.flatnonzero((nodes[t][place] == at) & (w > 0))
                    place = place[own]
                    cell = (place[:, None] * take + np.arange(take)) * BINS + x[own[:, None], picked[t][place]]
                    held[t] += np.bincount((cell * k + y[own, None]).ravel(), np.repeat(w[own], take), len(held[t]))
            yield pd.DataFrame([(t, int(i), h.tobytes()) for t in nodes for i, h in zip(nodes[t], held[t].reshape(len(nodes[t]), -1))], columns=["t", "node", "cells"])

        def choose(group: pd.DataFrame) -> pd.DataFrame:
            t, node = int(group["t"].iloc[0]), int(group["node"].iloc[0])
            nodes, picked, _ = now.value
            cells = sum(np.frombuffer(c) for c in group["cells"]).reshape(take, BINS, k)
            left, total = np.cumsum(cells, axis=1), cells[0].sum(axis=0)
            fall = _score(left, total - left) - (total ** 2).sum() / max(total.sum(), 1)
            j, b = np.unravel_index(fall.argmax(), fall.shape)
            out = (t, node, int(picked[t][np.searchsorted(nodes[t], node)][j]), int(b), float(fall[j, b]), float(left[j, b].sum()), float((total - left[j, b]).sum()))
            return pd.DataFrame([out], columns=["t", "node", "f", "cut", "gain", "a", "b"]).query("gain > 1e-9 * (a + b)")

        counted = binned.mapInPandas(count, "t int, node long, cells binary")
        best = counted.groupBy("t", "node").applyInPandas(choose, "t int, node long, f int, cut int, gain double, a double, b double").collect()  # a row per open node
        live = {}
        for r in sorted(best, key=lambda r: (r["t"], r["node"])):
            splits[r["t"]][r["node"]] = r["f"], r["cut"]
            gains[r["t"], r["f"]] += r["gain"]
            live.setdefault(r["t"], []).extend(2 * r["node"] + side for side, rows in ((0, r["a"]), (1, r["b"])) if rows > LOCAL_ROWS)
        live = {t: nodes for t, nodes in live.items() if nodes}
    return [as_arrays(s) for s in splits], gains


class DeepForestModel(Model, _Columns, HasProbabilityCol, MLReadable, MLWritable):
    """A grown forest: one row per (tree, node) of `parts`. `transform` runs jobs: it settles the distinct bins of the asked rows."""

    numTrees, maxDepth, seed = DeepForest.numTrees, DeepForest.maxDepth, DeepForest.seed
    classes = _param("classes", "number of classes", TypeConverters.toInt)
    cuts = _param("cuts", "bounds of the bins of each feature")
    tops = _param("tops", "upper splits of each tree")
    importances = _param("importances", "importance of each feature", TypeConverters.toListFloat)

    def __init__(self, parts: DataFrame | None = None):
        super().__init__()
        self._setDefault(numTrees=100, maxDepth=30, seed=42)
        self.parts = parts

    @property
    def featureImportances(self):
        return Vectors.dense(self.getOrDefault(self.importances))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        k, trees = self.getOrDefault(self.classes), self.getOrDefault(self.numTrees)
        cuts = [np.array(c) for c in self.getOrDefault(self.cuts)]
        spark, d = dataset.sparkSession, len(cuts)
        tops = spark.sparkContext.broadcast([tuple(np.array(a, np.int64) for a in t) for t in self.getOrDefault(self.tops)])
        coded = dataset.withColumn("_bins", _bins(vector_to_array(F.col(self.getFeaturesCol())), cuts))
        seen = settle(coded.select("_bins").distinct())

        def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            number = 0
            for part in parts:
                for low in range(0, len(part), BLOCK):
                    x, block = _matrix(part["_bins"].iloc[low:low + BLOCK], d), (TaskContext.get().partitionId() << 32) + number
                    number += 1
                    out = [(block, t, node, at.tobytes(), x[at].tobytes()) for t in range(trees) for node, at in _by_node(route(x, tops.value[t]))]
                    yield pd.DataFrame(out, columns=["block", "t", "node", "places", "bins"])

        def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                out = []
                for r in part.itertuples():
                    arrays = [np.frombuffer(b, kind) for b, kind in ((r.feature, np.int32), (r.cut, np.uint8), (r.child, np.int32), (r.share, np.float32))]
                    arrays[3] = arrays[3].reshape(-1, k)
                    x = np.frombuffer(r.bins, np.uint8).reshape(-1, d)
                    out.append((r.block, r.t, r.node, r.places, None if r.t else r.bins, shares_of(x, *arrays).tobytes()))
                yield pd.DataFrame(out, columns=["block", "t", "node", "places", "bins", "share"])

        def total(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["t", "node"])
            place = np.concatenate([np.frombuffer(b, np.int64) for b in group["places"]])
            votes = np.concatenate([np.frombuffer(b, np.float32).reshape(-1, k) for b in group["share"]]).astype(float)
            sums = np.stack([np.bincount(place, votes[:, c]) for c in range(k)], axis=1) / trees
            first = _matrix(group["bins"].dropna(), d)  # of the first tree, which meets every row
            return pd.DataFrame({"_bins": [r.tobytes() for r in first], "_p": list(sums[place[:len(first)]]), "_best": sums.argmax(axis=1)[place[:len(first)]].astype(float)})

        met = seen.mapInPandas(deal, "block long, t int, node long, places binary, bins binary").join(self.parts.drop("gains"), ["t", "node"])
        judged = met.mapInPandas(judge, "block long, t int, node long, places binary, bins binary, share binary")
        voted = judged.groupBy("block").applyInPandas(total, "_bins binary, _p array<double>, _best double")
        out, chance = self.getPredictionCol(), self.getProbabilityCol()
        return (coded.drop(out, chance).join(voted, "_bins", "left").withColumns({chance: array_to_vector("_p"), out: F.col("_best")})
                .drop("_bins", "_p", "_best"))

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, model: DeepForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.parts.write.parquet(f"{path}/parts")


class _ForestReader(MLReader):
    def load(self, path: str) -> DeepForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = DeepForestModel(self.sparkSession.read.parquet(f"{path}/parts"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
