"""Language-model scores from a hierarchical Pitman-Yor model with Gibbs-sampled restaurant seating.

Each context (the word before, hashed into CONTEXTS restaurants) is a restaurant whose dishes are
words; all of them share the unigram restaurant as parent, and that one a uniform base over the
vocabulary and one unseen word. A restaurant's predictive probability discounts its dishes by
their tables and hands what is left to the parent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.words import slices, words_of
from flowspark.session import parallelism, settle

CONTEXTS = 1 << 16  # restaurants below the unigram restaurant
HEAVY = 1024  # a word with over 1 / HEAVY of the tokens is dealt out by context, so at most HEAVY of them
SAMPLES, BURN_IN = 3, 2  # seatings averaged, and sweeps before them
TABLED = 48  # customers up to which a dish's number of tables is drawn from its exact conditional
STRENGTH, PARENT_STRENGTH = 0.5, 1.0
CHUNK = 12 << 20  # bytes of text packed together
SPLIT = np.uint64(0x9E3779B97F4A7C15)
END, START = xxhash.xxh64_intdigest(b"end", 1), xxhash.xxh64_intdigest(b"start", 1)
HELD_OUT_PARTS = 10


class Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def mixed(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """One 64-bit number per (word, context)."""
    x = (words ^ (contexts.astype(np.uint64) + np.uint64(1)) * SPLIT) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)


def _among(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each x in sorted values, and whether it is there."""
    if not len(sorted_values):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return at, sorted_values[at] == x


def narrow(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, each in as few bytes as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def widened(packed: bytes, size: int) -> np.ndarray:
    """The `size` numbers that `narrow` packed."""
    return np.frombuffer(packed, np.dtype(f"u{len(packed) // size if size else 1}")).astype(np.int64)


def _packed_chunk(ids: list, words: list[np.ndarray], train: np.ndarray, heavy: np.ndarray, chunk: int, parts: np.ndarray) -> Iterator[dict]:
    """Rows of a chunk: its documents, and per part the counted (word, context, document) entries."""
    sizes = np.array([len(w) for w in words])
    yield {"p": int(parts[chunk % len(parts)]), "chunk": chunk, "docs": True, "words": b"", "runs": b"", "contexts": b"", "at": b"", "n": sizes.astype(np.int64).tobytes(),
           "train": np.packbits(train).tobytes(), "ids": ids}
    flat, starts = np.concatenate(words), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    context = np.empty(len(flat), np.uint16)
    context[1:] = flat[:-1] >> np.uint64(48)
    context[starts] = START >> 48
    at = np.repeat(np.arange(len(words), dtype=np.uint32), sizes)
    route = np.where(_among(heavy, flat)[1], mixed(flat, context), flat)
    inner = context.astype(np.uint64) << np.uint64(32) | at
    order = np.lexsort((inner, route))
    flat, route, inner = flat[order], route[order], inner[order]
    new = np.flatnonzero(np.concatenate([[True], (route[1:] != route[:-1]) | (inner[1:] != inner[:-1])]))
    n = np.diff(np.append(new, len(flat))).astype(np.int32)
    flat, route, inner = flat[new], route[new], inner[new]
    part = (route >> np.uint64(32)) * np.uint64(len(parts)) >> np.uint64(32)
    bounds = np.searchsorted(part, np.arange(len(parts) + 1))
    for p, a, b in zip(parts, bounds, bounds[1:]):
        if a < b:
            first = np.flatnonzero(np.concatenate([[True], flat[a + 1:b] != flat[a:b - 1]]))
            yield {"p": int(p), "chunk": chunk, "docs": False, "words": flat[a:b][first].tobytes(), "runs": np.diff(np.append(first, b - a)).astype(np.int32).tobytes(),
                   "contexts": (inner[a:b] >> np.uint64(32)).astype(np.uint16).tobytes(), "at": narrow(inner[a:b] & np.uint64(0xFFFFFFFF)),
                   "n": narrow(n[a:b]), "train": np.packbits(train).tobytes(), "ids": None}


PACKED = pa.schema([("p", pa.int64()), ("chunk", pa.int64()), ("docs", pa.bool_()), ("words", pa.binary()), ("runs", pa.binary()), ("contexts", pa.binary()),
                    ("at", pa.binary()), ("n", pa.binary()), ("train", pa.binary()), ("ids", pa.list_(pa.int64()))])
PACKED_DDL = "p bigint, chunk bigint, docs boolean, words binary, runs binary, contexts binary, at binary, n binary, train binary, ids array<bigint>"


def heavy_words(docs: DataFrame, key: str, text: str, texts: int = 2000) -> np.ndarray:
    """Hashes of words with over 1 / HEAVY of the tokens of about `texts` texts. They only decide which task counts what."""
    step = max(1, docs.count() // texts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, CHUNK):
            known = Hashes()
            words = np.array([known[w] for t in batch.column(0).to_pylist() for w in words_of(t)] or [END], np.uint64)
            values, n = np.unique(words, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["w", "n"])

    seen = docs.where(F.pmod(F.xxhash64(key), F.lit(step)) == 0).select(text).mapInArrow(count, "w bigint, n bigint")
    counts = settle(seen.groupBy("w").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return np.sort(np.array([r["w"] for r in counts.where(F.col("n") > total / HEAVY).collect()], np.int64).view(np.uint64))


def pack(docs: DataFrame, held_out: Column, heavy: np.ndarray, parts: np.ndarray, key: str, text: str) -> DataFrame:
    """All tokens as counted entries in binary columns, dealt to tasks by word (heavy words by word and context)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = Hashes(), TaskContext.get().partitionId() << 32
        for batch in slices(batches, "_text", CHUNK):
            if len(known) > 300_000:
                known.clear()
            words = [np.fromiter(map(known.__getitem__, w), np.uint64, len(w)) for w in map(words_of, batch.column(2).to_pylist())]
            words = [np.append(w, np.uint64(END)) for w in words]
            train = ~np.array(batch.column(1).to_pylist(), bool)
            for row in _packed_chunk(batch.column(0).to_pylist(), words, train, heavy, number, parts):
                yield pa.RecordBatch.from_pylist([row], schema=PACKED)
            number += 1

    return docs.select(F.col(key).cast("long"), F.coalesce(held_out, F.lit(False)), F.col(text).alias("_text")).mapInArrow(run, PACKED_DDL)


@dataclass
class Totals:
    """What all restaurants know of each other: totals over all tasks, of bounded size."""

    tokens: int  # N
    vocabulary: int  # V
    customers: np.ndarray  # of each context restaurant
    tables: np.ndarray  # by sample and context
    heavy_count: np.ndarray  # customers of each heavy word
    heavy_tables: np.ndarray  # by sample and heavy word: tables over all contexts
    parent_customers: np.ndarray  # by sample: tables of all contexts
    parent_tables: np.ndarray  # by sample
    discount: float = 0.5
    parent_discount: float = 0.5
    before: Totals | None = None  # what the seatings of these totals were drawn from


def stirling(discount: float, most: int = TABLED) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: weights of seatings of c customers at t tables."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            s[c + 1, 1:c + 2] = np.logaddexp(s[c, t - 1], s[c, t] + np.log(np.maximum(c - t * discount, 1e-300)))
    return s


def draw_tables(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, strength: float,
                log_s: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Gibbs step: the number of tables of each dish given its customers, the restaurant's other tables and the parent.

    Up to TABLED customers the exact conditional is drawn by its weights. Of more, TABLED sit
    down so and the rest in growing groups, each opening tables at the rate of its middle.
    """
    tables = np.minimum(customers, 1)
    base = np.log(parent)
    few = np.minimum(customers, TABLED)
    for c in np.unique(few[few > 1]).tolist():
        rows = np.flatnonzero(few == c)
        for at in range(0, len(rows), 1 << 18):
            r = rows[at:at + (1 << 18)]
            rise = np.cumsum(np.log(strength + discount * (others[r][:, None] + np.arange(c))), axis=1)
            weight = log_s[c, 1:c + 1] + rise + base[r][:, None] * np.arange(1, c + 1)
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            tables[r] = 1 + (rng.random(len(r))[:, None] * weight[:, -1:] > weight).sum(axis=1)
    r, seated = np.flatnonzero(customers > TABLED), TABLED
    while len(r):
        group = np.minimum(customers[r] - seated, max(1, seated // 8))
        fresh = (strength + discount * (others[r] + tables[r])) * parent[r]
        rate = fresh / (fresh + np.maximum(seated + group / 2 - discount * tables[r], 1e-9))
        tables[r] += rng.binomial(group, rate)
        seated += max(1, seated // 8)
        r = r[customers[r] > seated]
    return tables


class Part:
    """The restaurants' dishes that one task serves: training counts by (word, context)."""

    def __init__(self, rows: list[dict], heavy: np.ndarray):
        found = []
        for row in rows:
            words, context, at, n = self.entries(row)
            keep = np.unpackbits(np.frombuffer(row["train"], np.uint8)).astype(bool)[at]
            words, context, n = words[keep], context[keep], n[keep]
            if len(words):
                new = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (context[1:] != context[:-1])]))
                found.append((words[new], context[new], np.add.reduceat(n, new)))
        words, context, n = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.int64))
        pair, first, at = np.unique(mixed(words, context), return_index=True, return_inverse=True)
        self.pair, self.context = pair, context[first].astype(np.int64)
        self.count = np.bincount(at, weights=n, minlength=len(pair)).astype(np.int64)
        self.words, self.word = np.unique(words[first], return_inverse=True)
        self.heavy_at, self.is_heavy = _among(heavy, self.words)
        self.word_count = np.bincount(self.word, weights=self.count, minlength=len(self.words)).astype(np.int64)

    @staticmethod
    def entries(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        words = np.repeat(np.frombuffer(row["words"], np.uint64), np.frombuffer(row["runs"], np.int32))
        return words, np.frombuffer(row["contexts"], np.uint16), widened(row["at"], len(words)), widened(row["n"], len(words))

    def seatings(self, totals: Totals, seed: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """After the burn-in, SAMPLES seatings: tables of each dish, tables of each word over all contexts, parent tables of each word.

        Other tasks' tables enter as their totals of the round before. Draws follow the seed, so
        a second call, in another job or a repeated task, gives the same seatings.
        """
        rng = np.random.default_rng(seed)
        log_s, parent_s = stirling(totals.discount), stirling(totals.parent_discount)
        tables, base = np.minimum(self.count, 1), 1.0 / (totals.vocabulary + 1)
        context_tables, uniform = totals.tables[-1], np.full(len(self.words), base)
        elsewhere = totals.heavy_tables[-1].astype(np.int64)[self.heavy_at] if len(totals.heavy_count) else np.zeros(len(self.words), np.int64)
        served = np.minimum(self.word_count, 1)
        for sweep in range(BURN_IN + SAMPLES):
            own = np.bincount(self.word, weights=tables, minlength=len(self.words)).astype(np.int64)
            parent = self.parent_probability(np.where(self.is_heavy, elsewhere, own), served, totals.parent_customers[-1], totals.parent_tables[-1], totals)
            others = np.maximum(context_tables[self.context] - tables, 0)
            tables = draw_tables(self.count, others, parent[self.word], totals.discount, STRENGTH, log_s, rng)
            own = np.bincount(self.word, weights=tables, minlength=len(self.words)).astype(np.int64)
            served = draw_tables(np.where(self.is_heavy, elsewhere, own), np.maximum(totals.parent_tables[-1] - served, 0), uniform, totals.parent_discount, PARENT_STRENGTH, parent_s, rng)
            served = np.where(self.is_heavy, 1, served)  # a heavy word's parent tables: one, wherever it is dealt
            if sweep >= BURN_IN:
                yield tables, own, served

    @staticmethod
    def parent_probability(customers, tables, all_customers: float, all_tables: float, totals: Totals):
        """Predictive probability of words in the unigram restaurant."""
        new = (PARENT_STRENGTH + totals.parent_discount * all_tables) / (all_customers + PARENT_STRENGTH) / (totals.vocabulary + 1)
        return np.maximum(customers - totals.parent_discount * tables, 0) / (all_customers + PARENT_STRENGTH) + new


def _by_part(work: Callable, heavy: np.ndarray) -> Callable:
    """Hand each part's rows, in order, to `work(part number, rows)`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["docs"]:
                    continue
                if held is not None and row["p"] != held:
                    yield from work(held, rows)
                    rows = []
                held = row["p"]
                rows.append(row)
        if rows:
            yield from work(held, rows)

    return run


def _summed(packed: DataFrame, heavy: np.ndarray, measure: Callable) -> pd.DataFrame:
    """Totals over all tasks of what `measure(part, number)` returns: rows of (kind, id, values); at most CONTEXTS + HEAVY + a few."""
    def work(number: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        for kind, ids, values in measure(Part(rows, heavy), number):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), pa.array(np.asarray(ids, np.int64)), *[pa.array(np.asarray(v, np.float64)) for v in values]],
                                             ["kind", "id", "v0", "v1", "v2"])

    seen = packed.mapInArrow(_by_part(work, heavy), "kind int, id bigint, v0 double, v1 double, v2 double")
    return pd.DataFrame(seen.groupBy("kind", "id").agg(*[F.sum(v).alias(v) for v in ("v0", "v1", "v2")]).collect(), columns=["kind", "id", "v0", "v1", "v2"])


def _dense(found: pd.DataFrame, kind: int, size: int) -> np.ndarray:
    out, rows = np.zeros((3, size)), found[found["kind"] == kind]
    out[:, rows["id"].to_numpy(np.int64)] = rows[["v0", "v1", "v2"]].to_numpy(float).T
    return out


def _by_context(part: Part, *values: np.ndarray) -> tuple:
    sums = [np.bincount(part.context, weights=v, minlength=CONTEXTS) for v in values]
    ids = np.flatnonzero(sums[0])
    return 0, ids, [s[ids] for s in sums] + [np.zeros(len(ids))] * (3 - len(sums))


def train(packed: DataFrame, heavy: np.ndarray, seed: int) -> Totals:
    """Totals of all restaurants after the counts, one round of seatings, and the seatings that are averaged."""
    def counts(part: Part, number: int) -> Iterator[tuple]:
        types = np.bincount(part.word, minlength=len(part.words))
        yield _by_context(part, part.count, np.ones(len(part.count)))
        h = np.flatnonzero(part.is_heavy)
        yield 1, part.heavy_at[h], [part.word_count[h], types[h], np.zeros(len(h))]
        light = ~part.is_heavy
        facts = [part.count.sum(), light.sum(), len(part.pair), (part.count == 1).sum(), (part.count == 2).sum(), (types[light] == 1).sum(), (types[light] == 2).sum()]
        yield 2, range(len(facts)), [np.array(facts, float), np.zeros(len(facts)), np.zeros(len(facts))]

    found = _summed(packed, heavy, counts)
    contexts, words, facts = _dense(found, 0, CONTEXTS), _dense(found, 1, len(heavy)), _dense(found, 2, 7)[0]
    vocabulary = int(facts[1] + (words[0] > 0).sum())
    rate = lambda one, two: min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5
    totals = Totals(int(facts[0]), vocabulary, contexts[0], contexts[1:2], words[0], words[1:2], facts[2:3], np.array([float(vocabulary)]),
                    rate(facts[3], facts[4]), rate(facts[5], facts[6]))
    for _ in range(2):  # the second round's seatings are those that scoring draws again and averages
        now = totals

        def tables(part: Part, number: int, now: Totals = now) -> Iterator[tuple]:
            drawn = list(part.seatings(now, [seed, number]))
            yield _by_context(part, *[t for t, _, _ in drawn])
            h, light = np.flatnonzero(part.is_heavy), ~part.is_heavy
            yield 1, part.heavy_at[h], [own[h] for _, own, _ in drawn]
            yield 2, range(2), [np.array([t.sum(), served[light].sum()], float) for t, _, served in drawn]

        found = _summed(packed, heavy, tables)
        contexts, words, facts = _dense(found, 0, CONTEXTS), _dense(found, 1, len(heavy)), _dense(found, 2, 2)
        last, totals = totals, Totals(totals.tokens, vocabulary, totals.customers, contexts, totals.heavy_count, words, facts[:, 0],
                                      facts[:, 1] + (totals.heavy_count > 0).sum(), totals.discount, totals.parent_discount)
    totals.before = last
    return totals


def score_texts(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", seed: int = 23) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    The model learns from the rows that are not held out. Tokens are counted by (word, context,
    document) once, packed, and dealt to tasks by word; a task counts and seats its own dishes,
    the restaurants' totals pass between rounds (CONTEXTS and at most HEAVY words, whatever the
    input), and the last pass scores every entry by the mean of the seatings' predictive
    probabilities, which are proper: totals and seatings belong together. Partial scores meet by
    chunk of documents.

    Null text counts as empty, which is one end token; repeated rows count as often as they
    occur; keys must be integers or null; without training rows every word is unseen; empty
    tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    width = parallelism(spark)
    spread = spark.range(64 * width).select("id", F.pmod(F.hash("id"), F.lit(width)).alias("to")).groupBy("to").agg(F.min("id").alias("id"))
    parts = np.array([r["id"] for r in spread.orderBy("to").collect()], np.int64)  # numbers that hash to different partitions
    heavy = heavy_words(docs, key, text)
    packed = settle(pack(docs, held_out, heavy, parts, key, text).repartition(width, "p").sortWithinPartitions("p", "chunk"))
    totals = train(packed, heavy, seed)
    shared = spark.sparkContext.broadcast(totals)

    def work(number: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        t, part = shared.value, Part(rows, heavy)
        back_off = [(STRENGTH + t.discount * tables) / (t.customers + STRENGTH) for tables in t.tables]
        mean, parents, unseen = np.zeros(len(part.pair)), [], []
        for s, (tables, own, served) in enumerate(part.seatings(t.before, [seed, number])):
            known = np.where(part.is_heavy, t.heavy_tables[s][part.heavy_at] if len(heavy) else 0, own)
            parent = part.parent_probability(known, served, t.parent_customers[s], t.parent_tables[s], t)
            seat = (part.count - t.discount * tables) / (t.customers[part.context] + STRENGTH)
            mean += (seat + back_off[s][part.context] * parent[part.word]) / SAMPLES
            parents.append(parent)
            unseen.append(part.parent_probability(0, 0, t.parent_customers[s], t.parent_tables[s], t))
        for row in rows:
            words, context, at, n = part.entries(row)
            pair, seated = _among(part.pair, mixed(words, context))
            word, heard = _among(part.words, words)
            heavy_word, is_heavy = _among(heavy, words)
            p = np.zeros(len(words))
            for s in range(SAMPLES):
                parent = np.where(heard, parents[s][word], unseen[s]) if len(part.words) else np.full(len(words), unseen[s])
                if is_heavy.any():
                    whole = part.parent_probability(t.heavy_tables[s], np.minimum(t.heavy_count, 1), t.parent_customers[s], t.parent_tables[s], t)
                    parent = np.where(is_heavy, whole[heavy_word], parent)
                p += back_off[s][context] * parent / SAMPLES
            if len(part.pair):
                p = np.where(seated, mean[pair], p)
            count = np.where(heard, part.word_count[word], 0) if len(part.words) else np.zeros(len(words))
            if is_heavy.any():
                count = np.where(is_heavy, t.heavy_count[heavy_word], count)
            docs_at, local = np.unique(at, return_inverse=True)
            add = lambda w: np.bincount(local, weights=w, minlength=len(docs_at))
            base = np.log10((count + 0.1) / (t.tokens + 0.1 * (t.vocabulary + 1)))
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]]), *[pa.array([x.tobytes()], pa.binary()) for x in (
                docs_at.astype(np.uint32), add(n * (count > 0)), add(n * base), add(n * np.log10(p)))]], ["chunk", "at", "known", "base", "score"])

    partial = packed.mapInArrow(_by_part(work, heavy), "chunk bigint, at binary, known binary, base binary, score binary")
    named = packed.where("docs").select("chunk", "ids", "n")

    def merge(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        columns = ["id", "n_tokens", "n_known", "base", "score"]
        if not len(own):
            return pd.DataFrame({c: [] for c in columns})
        size = np.frombuffer(own["n"].iat[0], np.int64)
        sums = np.zeros((3, len(size)))
        for at, *values in found[["at", "known", "base", "score"]].itertuples(index=False):
            rows = np.frombuffer(at, np.uint32)
            for k, v in enumerate(values):
                sums[k, rows] += np.frombuffer(v)
        return pd.DataFrame({"id": pd.array(list(own["ids"].iat[0]), dtype="Int64"), "n_tokens": size, "n_known": sums[0].astype(np.int64), "base": sums[1], "score": sums[2]})

    merged = named.groupBy("chunk").cogroup(partial.groupBy("chunk")).applyInPandas(merge, "id bigint, n_tokens bigint, n_known bigint, base double, score double")
    return merged.select(F.col("id").alias(key), "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
