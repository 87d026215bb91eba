"""Periodic runs of words: minimizers of several scales propose periods, direct scans cover the short ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowspark.llm.words import slices

LEAST_LENGTH = 12  # words of the shortest run
SHORT = 16  # periods below this are found by comparing the text with itself shifted; a power of two
SLICE = 4 << 20  # bytes of text worked on at a time
CELLS = 1 << 20  # words compared at a time while candidates are extended
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _sliding(a: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over every window of `width` (a power of two) positions, by doubling."""
    step = 1
    while step < width:
        a = f(a[:-step], a[step:])
        step *= 2
    return a


def _true_stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of at least `least` true values."""
    kept, width = equal, 1
    while width < least and len(kept):
        step = min(width, least - width)
        kept = kept[:-step] & kept[step:]
        width += step
    at = np.flatnonzero(kept) if len(equal) >= least else np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return at[first], at[last] + least


def _matched(x: np.ndarray, a: np.ndarray, b: np.ndarray, sign: int) -> np.ndarray:
    """For each pair of places a < b, how many words in a row agree from there on (sign 1) or before (sign -1)."""
    out, live, width = np.zeros(len(a), np.int64), np.arange(len(a)), 16
    while len(live):
        rest = []
        for part in np.array_split(live, -(-len(live) * width // CELLS)):
            steps = out[part, None] + np.arange(width)
            differ = x[np.clip(a[part, None] + sign * steps, 0, len(x) - 1)] != x[np.clip(b[part, None] + sign * steps, 0, len(x) - 1)]
            first = differ.argmax(axis=1)
            done = differ[np.arange(len(part)), first]
            out[part] += np.where(done, first, width)
            rest.append(part[~done])
        live, width = np.concatenate(rest), min(2 * width, 4096)
    return out


def _proposals(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places m and periods q in [2k, 4k) such that the k words at m and m + q have equal hashes.

    A place is a minimizer if its hash is the least of some window of k places. In a run of period q
    a window and the window q further on lie both inside, and hold the same minima. Equal
    minimizers at most k / 2 apart form a chain, a stretch of some shorter period; the distances between two
    chains are then a progression with that step, and one place stands for each distance, so that
    long stretches of a short period stay linear. Distances inside a chain are multiples of its period.
    """
    low = np.pad(_sliding(h, k, np.minimum), (k - 1, k - 1))
    place = np.flatnonzero(_sliding(low, k, np.maximum) == h)
    place = place[np.argsort(h[place], kind="stable")]
    key = h[place]
    near = (key[1:] == key[:-1]) & (np.diff(place) < 4 * k)
    used = np.append(near, False) | np.append(False, near)
    place, key = place[used], key[used]
    if not len(place):
        return place, place
    gap = np.diff(place, prepend=0)
    head = np.append(True, (key[1:] != key[:-1]) | (gap[1:] > k // 2))
    starts = np.flatnonzero(head)
    first, last = place[starts], place[np.append(starts[1:], len(place)) - 1]
    step, key = np.gcd.reduceat(np.where(head, 0, gap), starts), key[starts]
    places, periods = [], []
    for ahead in range(1, len(first)):
        a = np.flatnonzero((key[:-ahead] == key[ahead:]) & (first[ahead:] - last[:-ahead] < 4 * k))
        if not len(a):
            break
        b = a + ahead
        low, high, by = first[b] - last[a], np.minimum(last[b] - first[a], 4 * k - 1), np.maximum(np.gcd(step[a], step[b]), 1)
        low += np.maximum(0, -((low - 2 * k) // by)) * by
        count = np.maximum(0, (high - low) // by + 1)
        q = np.repeat(low, count) + np.repeat(by, count) * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        places.append(np.maximum(np.repeat(first[a], count), np.repeat(first[b], count) - q))
        periods.append(q)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *places]), np.concatenate([none, *periods])


def _extended(x: np.ndarray, m: np.ndarray, q: np.ndarray, k: int) -> list[np.ndarray]:
    """Whole stretches [low, high) of places t with x[t] = x[t + q] round the proposals: one extension for neighbours."""
    order = np.lexsort((m, q))
    m, q, found = m[order], q[order], []
    while len(m):
        group = np.append(True, (np.diff(q) != 0) | (np.diff(m) > k))
        at = np.flatnonzero(group)
        a, p = m[at], q[at]
        high, low = a + _matched(x, a, a + p, 1), a - _matched(x, a - 1, a + p - 1, -1)
        found.append(np.stack([low, high, p], axis=1))
        left = ~group & (m >= high[np.cumsum(group) - 1])  # words of equal hash that differ
        m, q = m[left], q[left]
    return found


def find_runs(x: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period.

    `x` holds texts as word numbers, one behind the other; a negative number, different each time,
    stands before, between and behind them. A run is a longest stretch of smallest period q with at least
    max(LEAST_LENGTH, 2 q) words. Memory is linear in the words; time is the words
    times the scales plus the lengths of runs.
    """
    found = []
    for q in range(1, min(SHORT, len(x))):
        low, high = _true_stretches(x[:-q] == x[q:], max(LEAST_LENGTH - q, q))
        found.append(np.stack([low, high, np.full(len(low), q)], axis=1))
    edges = np.flatnonzero(x < 0)
    sizes = np.diff(edges) - 1
    h, k, at = _mixed(x.astype(np.int64).view(np.uint64) + np.uint64(1)), 1, np.arange(len(x))
    while True:
        if 2 * k >= SHORT:  # only texts with room for two periods of 2 k go on
            own = np.repeat(np.append(sizes >= 4 * k, False), np.append(sizes + 1, 1))
            x_on = own[at - edges[0]]
            h, at = h[x_on], at[x_on]
            if not len(at):
                break
            m, q = _proposals(h, k)
            for stretch in _extended(x, at[m], q, k):
                found.append(stretch[stretch[:, 1] - stretch[:, 0] >= np.maximum(stretch[:, 2], LEAST_LENGTH - stretch[:, 2])])
        h = _mixed(h * np.uint64(0xD6E8FEB86659FD93) + np.append(h[k:], np.zeros(min(k, len(h)), np.uint64)))
        k *= 2
    runs = np.concatenate([np.zeros((0, 3), np.int64), *found])
    runs[:, 1] += runs[:, 2] - runs[:, 0]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]  # a multiple of the period gives the same stretch
    runs = runs[np.append(True, (np.diff(runs[:, :2], axis=0) != 0).any(axis=1))[: len(runs)]]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


Tail = Callable[[object, int], "tuple[int, int] | None"]


def periodic_runs(docs: DataFrame, key: str = "doc_id", tail: Tail | None = None) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row: its runs of words and its text without their repetitions.

    `runs` are structs (start, length, period) in words from 0, by start and period; `collapsed` is the
    words that no run holds behind its first period, joined by one space. `tail(key, words)`
    may give (a, p): word i >= a is then first replaced by word a + (i - a) % p.

    Each row is worked on alone, with memory linear in its text: nothing is shuffled. A null or empty text has
    no words, no runs and an empty `collapsed`. Repeated rows give equal rows, a null key is passed on, an empty table
    gives an empty one, and other columns are not looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", SLICE):
            keys = batch.column(0).to_pylist() if tail else []
            words: list[bytes] = []
            starts = [0]
            for text in batch.column(1):
                words += text.as_buffer().to_pybytes().split() if text.is_valid else ()
                starts.append(len(words))
            source = np.arange(len(words))
            for i, name in enumerate(keys):
                n = starts[i + 1] - starts[i]
                if shape := tail(name, n) if n else None:
                    a, p = shape
                    source[starts[i] + a:starts[i + 1]] = starts[i] + a + np.arange(n - a) % p
            ids = pa.array(words, pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32)
            x = np.insert(ids[source], starts, -1 - np.arange(len(starts), dtype=np.int32))
            found = find_runs(x)
            origin = np.array(starts) + np.arange(len(starts)) + 1  # place of each text's first word in x
            of = np.searchsorted(origin, found[:, 0], "right") - 1
            level = np.zeros(len(x) + 1, np.int64)
            np.add.at(level, found[:, 0] + found[:, 2], 1)
            np.add.at(level, found[:, 0] + found[:, 1], -1)
            kept = np.delete(np.cumsum(level)[:-1] == 0, origin - 1)
            changed = (~kept | (source != np.arange(len(source))))
            changes = np.append(0, np.cumsum(changed))
            cut = np.searchsorted(of, np.arange(batch.num_rows + 1))
            collapsed = []
            for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
                own = words[a:b] if changes[a] == changes[b] else [words[j] for j in source[a:b][kept[a:b]].tolist()]
                collapsed.append(b" ".join(own))
            fields = [pa.array(c, pa.int64()) for c in (found[:, 0] - origin[of], found[:, 1], found[:, 2])]
            spans = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(starts), pa.int64()), spans, pa.array(collapsed, pa.binary()).cast(pa.string())],
                ["key", "n_words", "runs", "collapsed"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs["text"].alias("_text"))
    return rows.mapInArrow(run, f"key {kind}, n_words bigint, runs array<{RUN}>, collapsed string").withColumnRenamed("key", key)
