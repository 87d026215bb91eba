"""Evolving feature subsets: the driver holds masks, Spark scores them."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame

from flowspark.operators.scoring import PENALTY, fold_statistics, score_masks
from flowspark.plans.fitness import FitnessStore

# Rates and limits of the search.
CROSSOVER, MUTATION, FLIP, PATIENCE, GENERATIONS, RUNS = 0.5, 0.01, 0.05, 10, 200, 10
FEW_SUBSETS = 64  # subsets that one pass rates for all searches of a sweep

Mask = tuple[int, ...]


@dataclass
class SearchResult:
    """Best subset with its scores, the last population, and one history row per generation."""

    best: Mask
    scores: dict[str, float]
    population: list[Mask]
    history: list[dict] = field(default_factory=list)

    def history_table(self, spark) -> DataFrame:
        """The history as a table for the run reports."""
        rows = [(h["gen"], h["best_f1"], h["avg_f1"], h["avg_features"], h["diversity"], h["pareto_size"], h["hypervolume"]) for h in self.history]
        return spark.createDataFrame(rows, "gen int, best_f1 double, avg_f1 double, avg_features double, diversity double, pareto_size int, hypervolume double")


def dominates(a: tuple[float, float], b: tuple[float, float]) -> bool:
    """At least as good on both objectives and better on one; both are maximized."""
    return a[0] >= b[0] and a[1] >= b[1] and a != b


def fronts(points: Sequence[tuple[float, float]]) -> list[list[int]]:
    """Positions by non-domination rank."""
    left, out = set(range(len(points))), []
    while left:
        front = sorted(i for i in left if not any(dominates(points[j], points[i]) for j in left))
        out.append(front)
        left -= set(front)
    return out


def crowding(points: Sequence[tuple[float, float]], front: Sequence[int]) -> dict[int, float]:
    """Room round each member of a front; the ends have all the room."""
    room = dict.fromkeys(front, 0.0)
    for axis in (0, 1):
        order = sorted(front, key=lambda i: points[i][axis])
        width = points[order[-1]][axis] - points[order[0]][axis]
        room[order[0]] = room[order[-1]] = float("inf")
        for low, mid, high in zip(order, order[1:], order[2:]):
            if width:
                room[mid] += (points[high][axis] - points[low][axis]) / width
    return room


def survivors(masks: Sequence[Mask], points: Sequence[tuple[float, float]], size: int) -> list[Mask]:
    """The best `size` masks by rank, then by room."""
    kept: list[int] = []
    for front in fronts(points):
        room = crowding(points, front)
        kept += sorted(front, key=lambda i: (-room[i], i))[: size - len(kept)]
        if len(kept) == size:
            break
    return [masks[i] for i in kept]


def _children(parents: list[Mask], rng: random.Random) -> list[Mask]:
    out = []
    for a, b in zip(parents[::2], parents[1::2]):
        if rng.random() < CROSSOVER and len(a) > 1:
            i, j = sorted(rng.sample(range(len(a) + 1), 2))
            a, b = a[:i] + b[i:j] + a[j:], b[:i] + a[i:j] + b[j:]
        out += [a, b]
    out += parents[len(out):]
    flip = lambda m: tuple(1 - bit if rng.random() < FLIP else bit for bit in m)
    return [flip(m) if rng.random() < MUTATION else m for m in out]


Fitness = Callable[[Sequence[Mask]], DataFrame]


def statistics_fitness(df: DataFrame, fold: str, label: str, features: Sequence[str], scorer: str = "centroid", early_accuracy: float = 0.75) -> Fitness:
    """Fitness from class statistics, which are gathered once and serve every call: one pass over `df` per call."""
    stats = fold_statistics(df, fold, label, features)
    return lambda masks: score_masks(df, fold, label, features, masks, scorer, early_accuracy=early_accuracy, stats=stats)


def _state_of(rng: random.Random, masks: Sequence[Mask], best: Mask, still: int, history: list[dict]) -> dict:
    return {"random": rng.getstate(), "masks": masks, "best": best, "still": still, "history": history}


def evolve(df: DataFrame | None, fold: str, label: str, features: Sequence[str], population: int = 20, generations: int = GENERATIONS,
           patience: int = PATIENCE, seed: int = 42, scorer: str = "centroid", early_accuracy: float = 0.75,
           fitness: Fitness | None = None, store: FitnessStore | None = None, known: dict[Mask, dict[str, float]] | None = None) -> SearchResult:
    """Search for a subset with a high F1 and few features.

    `df` holds a fold number and is read once per generation: persist or settle it first. Every generation is one call of
    `fitness` over all masks not seen before (class statistics of `df` unless another is given, such as
    `fitness.estimator_scores` of a forest); the best mask always stays.

    With a store, subsets scored by any earlier search of the study are looked up instead of scored, and the population, the
    random state and the history are kept after each generation: a search that is started again goes on behind
    the last generation it finished, and ends as one that was never stopped. `known` shares scores between searches of one program.
    """
    rng = random.Random(seed)
    width = len(features)
    known = {} if known is None else known
    rated_by = fitness or statistics_fitness(df, fold, label, features, scorer, early_accuracy)

    def rate(masks: Sequence[Mask]) -> None:
        fresh = [m for m in dict.fromkeys(masks) if m not in known]
        if store and fresh:
            known.update(store.known(fresh))
            fresh = [m for m in fresh if m not in known]
        if fresh:
            scored = {fresh[row["id"]]: {c: row[c] for c in (*PENALTY, "n_features")} for row in rated_by(fresh).collect()}
            known.update(scored)
            if store:
                store.add(scored)

    point = lambda m: (known[m]["f1"], -float(known[m]["n_features"]))
    first, saved = 1, store.load_state() if store else None
    if saved:
        first, state = saved[0] + 1, saved[1]
        version, numbers, gauss = state["random"]
        rng.setstate((version, tuple(numbers), gauss))
        masks, best = [tuple(m) for m in state["masks"]], tuple(state["best"])
        still, history = state["still"], state["history"]
        rate([*masks, best])
    else:
        masks = [tuple(rng.randint(0, 1) for _ in range(width)) for _ in range(population)]
        rate(masks)
        best, still, history = max(masks, key=point), 0, []
    for gen in range(first, generations + 1):
        if still >= patience:
            break
        children = _children(rng.sample(masks, len(masks)), rng)
        rate(children)
        pool = [*masks, *children]
        masks = survivors(pool, [point(m) for m in pool], population)
        if best not in masks:
            masks[-1] = best
        top = max(masks, key=point)
        improved = known[top]["f1"] > known[best]["f1"]
        best, still = max(best, top, key=point), 0 if improved else still + 1
        front = [masks[i] for i in fronts([point(m) for m in masks])[0]]
        ones = [sum(m[g] for m in masks) for g in range(width)]
        pairs = population * (population - 1) / 2
        history.append({
            "gen": gen, "best_f1": known[best]["f1"], "avg_f1": sum(known[m]["f1"] for m in masks) / population,
            "avg_features": sum(map(sum, masks)) / population, "diversity": sum(o * (population - o) for o in ones) / pairs if pairs else 0.0,
            "pareto_size": len(set(front)), "hypervolume": known[best]["f1"] * max(0.0, 100.0 - known[best]["n_features"])})
        if store:
            store.save_state(gen, _state_of(rng, masks, best, still, history))
    return SearchResult(best, known[best], masks, history)


def sweep(df: DataFrame, fold: str, label: str, features: Sequence[str], sizes: Sequence[int], runs: int = RUNS, scorer: str = "centroid",
          early_accuracy: float = 0.75, fitness: Fitness | None = None, **options) -> DataFrame:
    """Several runs per population size: (size, run, f1, feature) rows for the sweep report. A subset is scored once for all runs.

    So few features that all their subsets are FEW_SUBSETS at most are rated in one pass, before the searches ask for them.
    """
    rows, known = [], {}
    rated_by = fitness or statistics_fitness(df, fold, label, features, scorer, early_accuracy)
    if fitness is None and 2 ** len(features) <= FEW_SUBSETS:
        every = list(product((0, 1), repeat=len(features)))
        known = {every[r["id"]]: {c: r[c] for c in (*PENALTY, "n_features")} for r in rated_by(every).collect()}
    for size in sizes:
        for run in range(1, runs + 1):
            result = evolve(df, fold, label, features, size, seed=1000 * size + run, fitness=rated_by, known=known, **options)
            rows += [(size, run, float(result.scores["f1"]), f) for f, bit in zip(features, result.best) if bit]
    return df.sparkSession.createDataFrame(rows, "size int, run int, f1 double, feature string")
