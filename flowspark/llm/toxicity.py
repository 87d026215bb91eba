"""Toxicity by weak supervision: voters, a generative label model of their accuracies and correlations, a linear classifier."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.words import slices, tidied, words_of
from flowspark.session import settle

STEMS = (4, 5, 6)  # characters of the beginnings of words that are terms besides whole words
MOST_WORDS = 4  # a beginning counts again as a term of its own from 2, 3 and 4 different words with it
LEAST_TEXTS = 2  # labelled texts a term must occur in
FIT_ROWS = 100_000  # labelled texts, about, that lexicons, label model and classifier are fitted on
LEXICONS = 6  # lexicon voters per kind of term
ROUNDS = 40  # of expectation maximisation
SLICE = 8 << 20
KNOWN = 50_000  # words whose terms a task remembers
EDGES = b".,;:!?\"'()[]{}<>|*-_~/\\"
DISGUISE = bytes.maketrans(b"013457@$", b"oieastas")
TRUST, REJECT = 0.7, 0.7
NO_TERMS = ((), False)  # what most words are to the lexicons


def crc_remainder(key: Column, n: int) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


class Terms(dict):
    """word -> its terms: the word itself and its beginnings, as bytes with a kind in front."""

    def __missing__(self, word: bytes) -> tuple:
        bare = word.strip(EDGES)
        text = bare.decode("utf-8", "replace")
        terms = (b"w" + bare, *(b"s" + text[:n].encode() for n in STEMS if len(text) > n)) if bare else ()
        if len(self) > KNOWN:
            self.clear()
        self[word] = terms
        return terms


@dataclass
class Model:
    """A fitted scorer: lexicon terms by voter, voters' qualities and classifier weights."""

    terms: dict[bytes, int]  # term -> its number
    voter: list[int]  # voter of each term
    weights: np.ndarray  # of the classifier: terms, then voters for and against
    bias: float
    accuracies: np.ndarray
    correlations: np.ndarray

    @property
    def voters(self) -> int:
        return 2 * LEXICONS + 4


def levels(terms: dict[bytes, int]) -> dict[bytes, list[tuple[int, int]]]:
    """Base term -> (words it takes, number) of the lexicon's terms that come from it."""
    out: dict[bytes, list[tuple[int, int]]] = {}
    for term, number in terms.items():
        base, least = (term[1:], int(term[:1])) if term[:1].isdigit() else (term, 1)
        out.setdefault(base, []).append((least, number))
    return out


def evidence(text: str | None, watched: dict[bytes, list], voter: list[int], known: dict) -> tuple[list[int], np.ndarray]:
    """Lexicon terms of a whole text, and the votes: 1 toxic, -1 clean, 0 abstains.

    Voters: lexicons of words and of word beginnings; words found in a lexicon once digits and
    signs are read as letters; shouting; an accumulation of several different terms; and the
    absence of every term, which votes clean.
    """
    counts: Counter = Counter()
    disguised = False
    for word in set(words_of(text)):
        found = known.get(word)
        if found is None:
            plain = tuple(t for t in Terms.__missing__({}, word) if t in watched)
            bare = word.strip(EDGES)
            read = b"w" + bare.translate(DISGUISE)
            hidden = not plain and read[1:] != bare and read in watched and any(c.isalpha() for c in bare.decode("utf-8", "replace"))
            found = (plain + ((read,) if hidden else ()), hidden) if plain or hidden else NO_TERMS
            if len(known) > KNOWN:
                known.clear()
            known[word] = found
        if found[0]:
            counts.update(found[0])
            disguised |= found[1]
    hits = sorted({number for base, n in counts.items() for least, number in watched[base] if n >= least})
    votes = np.zeros(2 * LEXICONS + 4, np.int8)
    for h in hits:
        votes[voter[h]] = 1
    letters = [c for c in (text or "") if c.isalpha()] if hits else []
    votes[-4] = disguised
    votes[-3] = bool(letters) and sum(c.isupper() for c in letters) > 0.5 * len(letters)
    votes[-2] = len(hits) > 2
    votes[-1] = 0 if hits else -1
    return hits, votes


def induce_lexicon(labelled: DataFrame) -> tuple[dict[bytes, int], list[int]]:
    """Terms with evidence of toxicity and their voters, from labelled texts (`text`, `toxic`), each of them once.

    Every term is kept that at least LEAST_TEXTS toxic texts hold and of whose texts, with half a clean text added, at
    least TRUST are toxic. Terms are dealt to the lexicons of their kind by hash, so voters differ.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms()
        for batch in slices(batches, "text", SLICE):
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = Counter(t for w in set(words_of(text)) for t in known[w])
                often = [b"%d" % k + t for t, n in found.items() if n > 1 for k in range(2, min(n, MOST_WORDS) + 1)]
                (toxic if label else clean).update([*found, *often])
            names = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([toxic[t] for t in names], pa.int64()),
                                              pa.array([clean[t] for t in names], pa.int64())], ["term", "toxic", "clean"])

    counts = labelled.select("text", "toxic").mapInArrow(tidied(count), "term binary, toxic bigint, clean bigint")
    kept = (counts.groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
            .where((F.col("t") >= LEAST_TEXTS) & (F.col("t") >= TRUST * (F.col("t") + F.col("c") + 0.5)))
            .select("term").orderBy("term").collect())  # as many as about FIT_ROWS texts have
    terms = {bytes(r["term"]): i for i, r in enumerate(kept)}
    return terms, [LEXICONS * (t[:1] != b"w") + sum(t) % LEXICONS for t in terms]


def label_model(votes: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of toxic, accuracies, correlations): a two-class model of the votes by expectation maximisation.

    Each voter has for each class a rate of voting either way or abstaining. Voters that agree
    beyond what the class explains are correlated: the correlation of their residuals is
    estimated every few rounds, and a voter's say is divided by one plus the correlations it
    has with the others, so that one clue seen by many voters counts about once.
    """
    n, m = votes.shape
    onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(np.float64)
    post = ((votes == 1).sum(axis=1) + prior) / ((votes != 0).sum(axis=1) + 1)
    say, corr = np.ones(m), np.zeros((m, m))
    for step in range(ROUNDS):
        rates = [(np.tensordot(w, onehot, axes=(0, 0)) + 0.5) / (w.sum() + 1.5) for w in (1 - post, post)]
        if step % 8 == 0:
            rest = votes - ((1 - post)[:, None] * (rates[0][:, 2] - rates[0][:, 0]) + post[:, None] * (rates[1][:, 2] - rates[1][:, 0]))
            spread = np.sqrt((rest ** 2).mean(axis=0)) + 1e-6
            corr = np.clip((rest.T @ rest) / n / np.outer(spread, spread), 0, 1)
            np.fill_diagonal(corr, 0)
            say = 1 / (1 + np.where(corr > 0.2, corr, 0).sum(axis=1))
        share = min(0.5, max(1e-4, post.mean()))
        logit = np.log(share / (1 - share)) + np.einsum("nmk,mk,m->n", onehot, np.log(rates[1] / rates[0]), say)
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    active = (votes != 0).sum(axis=0)
    right = ((votes == 1) * post[:, None] + (votes == -1) * (1 - post)[:, None]).sum(axis=0)
    return post, right / np.maximum(active, 1), corr


def fit_linear(rows: list[list[int]], votes: np.ndarray, target: np.ndarray, terms: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels (full-batch Adam, small L2 penalty)."""
    width, m = terms + 2 * votes.shape[1], votes.shape[1]
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], np.int64)
    r, c = np.nonzero(votes)
    at, col = np.concatenate([at, r]), np.concatenate([col, terms + c + m * (votes[r, c] < 0)])
    w, bias = np.zeros(width), float(np.log((target.mean() + 1e-4) / (1 - target.mean() + 1e-4)))
    g1, g2 = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, 201):
        z = np.bincount(at, weights=w[col], minlength=len(rows)) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / max(1, len(rows))
        grad = np.append(np.bincount(col, weights=err[at], minlength=width) + 1e-6 * w, err.sum())
        g1, g2 = 0.9 * g1 + 0.1 * grad, 0.999 * g2 + 0.001 * grad ** 2
        move = 0.1 * (g1 / (1 - 0.9 ** step)) / (np.sqrt(g2 / (1 - 0.999 ** step)) + 1e-10)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on the documents named in `labels` (key, toxic 0/1); the caller leaves out held-out rows.

    The model is fitted on about `fit_rows` labelled texts, chosen by a hash of the key; equal texts among them count once, as
    toxic if one of their labels says so. The chosen keys are broadcast, so no text is shuffled whatever the number of labels. Labels
    reach the lexicons and the prior only; the classifier's targets are the label model's posteriors. Without labels, or
    without a toxic one, every text scores the same low value. A key labelled more than once is
    toxic if any label says so.
    """
    labels = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows, share = labels.agg(F.count("*"), F.avg("toxic")).first()
    chosen = labels.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, fit_rows / max(1, rows)))))
    hashed = docs.select(key, F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    once = hashed.select(key, "_h").join(F.broadcast(chosen), key).groupBy("_h").agg(F.min(key).alias(key), F.max("toxic").alias("toxic"))
    labelled = hashed.join(F.broadcast(settle(once)), [key, "_h"])  # about fit_rows rows at most
    terms, voter = induce_lexicon(labelled)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        watched = levels(terms)
        for batch in slices(batches, "text", SLICE):
            found = [evidence(t, watched, voter, known) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.list_(pa.int32())),
                                              pa.array([f[1].tobytes() for f in found], pa.binary())], ["hits", "votes"])

    seen = labelled.select("text").mapInArrow(tidied(vote), "hits array<int>, votes binary").toPandas()
    width = 2 * LEXICONS + 4
    votes = np.array([np.frombuffer(v, np.int8) for v in seen["votes"]], np.int8).reshape(-1, width)
    post, right, corr = label_model(votes, share or 0.05) if len(votes) else (np.zeros(0), np.zeros(width), np.zeros((width, width)))
    if len(votes):
        weights, bias = fit_linear([list(h) for h in seen["hits"]], votes, post, len(terms))
    else:
        weights, bias = np.zeros(len(terms) + 2 * width), -4.0
    return Model(terms, voter, weights, bias, right, corr)


def score(docs: DataFrame, model: Model, key: str = "doc_id", keep: bool = False) -> DataFrame:
    """(key, score) of every whole text, or with `keep` all columns and `score`.

    A null or empty text has no term and scores as such a text does. Rows are scored alone, so
    repeated rows score alike, and an empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c != "score"] if keep else [key]
    carried = docs.select(*kept, *([] if "text" in kept else ["text"]))  # a text goes to the task once
    at_text = carried.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # terms of about FIT_ROWS texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, {}
        watched = levels(m.terms)
        width, terms = m.voters, len(m.terms)
        for batch in slices(batches, "text", SLICE):
            out = []
            for text in batch.column(at_text):
                hits, votes = evidence(text.as_py(), watched, m.voter, known)
                z = m.bias + m.weights[hits].sum() + m.weights[terms:terms + width][votes > 0].sum() + m.weights[terms + width:][votes < 0].sum()
                out.append(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(out, pa.float64())], [*kept, "score"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in carried.schema if f.name in kept)
    return carried.mapInArrow(tidied(run), f"{fields}score double")
