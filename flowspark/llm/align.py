"""Alignment of two tokenizers over one byte string: token ends merged by merge-path pieces."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.words import forgotten_by_worker, kept_by_worker, slices
from flowspark.session import scratch_path

MODEL_A = "/opt/tokenizers/byte_bpe_50k.json"  # of public tokenizers; every node has them
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
PIECE = 8192  # steps of the merge path in one piece
SLICE = 1 << 18  # bytes of text that a task aligns at once
LINKS = 1 << 19  # links that a task counts at once
# The word pattern of byte-level vocabularies, and the first character of those not left to it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SIMPLE = "\u0250"
NONE = np.zeros(0, np.int64)
PAIR = 1 << 16  # more than the ids of either vocabulary: a pair is a * PAIR + b


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the rest follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers, with the bytes of every token and its length.

    A text of characters below U+0250 is encoded by A's vocabulary as ranks, which is several times faster and
    needs no second copy of the merges; other texts, and a vocabulary whose numbers do not follow its merges, by A itself.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece

        self.path_a, self._a = path_a, None
        with open(path_a, encoding="utf-8") as file:
            stored = json.load(file)
        alphabet = byte_alphabet()
        special = {t["id"]: t["content"].encode() for t in stored["added_tokens"]}
        words = {i: special.get(i) or bytes(alphabet[c] for c in w) for w, i in stored["model"]["vocab"].items()} | special
        self.bytes_a = [words.get(i, b"") for i in range(max(words) + 1)]
        self.ranks = self._by_rank(stored, {w: i for i, w in words.items() if i not in special})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
                        for i in range(self.b.vocab_size())]
        self.texts_a, self.texts_b = _decimals(len(self.bytes_a)), _decimals(len(self.bytes_b))
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in names]) for names in (self.bytes_a, self.bytes_b))

    @staticmethod
    def _by_rank(stored: dict, ids: dict[bytes, int]):
        """An encoder by ranks, if the numbers of merged tokens rise with the merges and words are cut by the usual pattern."""
        vocab, merges = stored["model"]["vocab"], stored["model"]["merges"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        cut = stored["pre_tokenizer"]
        plain = cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and stored["normalizer"] is None
        if not plain or any(x >= y for x, y in zip(made, made[1:])) or min(made) < 256:
            return None
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ids, special_tokens={})

    @property
    def a(self):
        if self._a is None:
            import tokenizers

            self._a = tokenizers.Tokenizer.from_file(self.path_a)
            self._a.encode_special_tokens = True
        return self._a

    def encode_a(self, text: str) -> np.ndarray:
        if self.ranks is not None and (text.isascii() or max(text) < SIMPLE):
            return self.ranks.encode_to_numpy(text, disallowed_special=())
        return np.array(self.a.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def load(path_a: str, path_b: str) -> Tokenizers:
    """The tokenizers, read once."""
    return Tokenizers(path_a, path_b)


def merge_path(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Places (i, j) where the merge of two sorted arrays crosses the diagonals i + j = 0, piece, 2 piece, ...

    Each diagonal is searched alone, all of them at once: the smallest i whose a[i] is greater than
    b[d - i - 1]. Equal values take a first. The pieces between two crossings have the same number of steps.
    """
    d = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        mid, open_ = (low + high) // 2, low < high
        at_a, at_b = np.minimum(mid, len(a) - 1), np.clip(d - mid - 1, 0, len(b) - 1)
        first = open_ & (a[at_a] <= b[at_b])
        low, high = np.where(first, mid + 1, low), np.where(open_ & ~first, mid, high)
    return np.stack([low, d - low], axis=1)


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with a[i] = b[j] in two strictly rising arrays of token ends.

    Every piece of the merge path is searched by itself. An equal pair that a crossing parts, a the last of one piece
    and b the first of a later one, is stitched: it can only be the last a before the crossing and the first b behind it.
    """
    if not len(a) or not len(b):
        return NONE, NONE
    cross = merge_path(a, b, piece)
    found_a, found_b = [], []
    for (i, j), (k, m) in zip(cross[:-1].tolist(), cross[1:].tolist()):
        if k > i and m > j:
            at = np.searchsorted(b[j:m], a[i:k])
            same = np.flatnonzero(b[j:m][np.minimum(at, m - j - 1)] == a[i:k])
            found_a.append(i + same)
            found_b.append(j + at[same])
    inner = cross[1:-1]
    inner = inner[(inner[:, 0] > 0) & (inner[:, 1] < len(b))]
    parted = inner[a[inner[:, 0] - 1] == b[inner[:, 1]]]
    i = np.concatenate([*found_a, parted[:, 0] - 1])
    j = np.concatenate([*found_b, parted[:, 1]])
    i, once = np.unique(i, return_index=True)
    return i.astype(np.int64), j[once].astype(np.int64)


def _decimals(n: int) -> np.ndarray:
    """Texts of ids followed by each sign: row , | ; and none."""
    return np.array([[f"{i}{sign}" for i in range(n)] for sign in (",", "|", ";", "")], dtype=object)


def aligned(texts: list[str | None], t: Tokenizers, piece: int = PIECE) -> list[tuple]:
    """(n_a, n_b, groups text, pairs of linked ids as numbers in order) of each text.

    A encodes a space and the text, B the text, which adds the space. All texts of the list lie one behind the other on one
    byte line, so the merge is cut into equal pieces whatever the texts' lengths. Texts that are null, empty or not
    rebuilt byte for byte by both have no tokens.
    """
    full = [i for i, x in enumerate(texts) if x]
    whole = [" " + texts[i] for i in full]
    ids_a = [t.encode_a(x) for x in whole]
    ids_b = t.b.encode([texts[i] for i in full], num_threads=1) if full else []
    kept = [n for n, x in enumerate(whole) if x.encode() == b"".join([t.bytes_a[i] for i in ids_a[n].tolist()]) == b"".join([t.bytes_b[i] for i in ids_b[n]])]
    out: list[tuple] = [(0, 0, "", NONE)] * len(texts)
    if not kept:
        return out
    n_a, n_b = np.array([len(ids_a[n]) for n in kept]), np.array([len(ids_b[n]) for n in kept])
    all_a = np.concatenate([ids_a[n] for n in kept]).astype(np.int64)
    all_b = np.fromiter(chain.from_iterable(ids_b[n] for n in kept), np.int64, n_b.sum())
    i, j = common_ends(np.cumsum(t.sizes_a[all_a]), np.cumsum(t.sizes_b[all_b]), piece)
    pairs = all_a[i] * PAIR + all_b[j]
    last_a, last_b = np.zeros(len(all_a), bool), np.zeros(len(all_b), bool)
    last_a[i] = last_b[j] = True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    before = np.append(0, i + 1)  # tokens of A up to the end of a group
    before_b = np.append(0, j + 1)
    place_a, place_b = np.arange(len(all_a)) + before_b[group_a], np.arange(len(all_b)) + before[group_b + 1]
    signs = np.empty(len(all_a) + len(all_b), dtype=object)
    signs[place_a] = t.texts_a[last_a.astype(np.int64), all_a]
    end_b = np.cumsum(n_b) - 1
    kind = np.where(last_b, 2, 0)
    kind[end_b] = 3
    signs[place_b] = t.texts_b[kind, all_b]
    signs = signs.tolist()
    ends, cut = np.cumsum(n_a + n_b), np.searchsorted(i, np.cumsum(n_a))
    start = first = 0
    for n, a, b, end, link in zip(kept, n_a.tolist(), n_b.tolist(), ends.tolist(), cut.tolist()):
        out[full[n]] = (a, b, "".join(signs[start:end]), pairs[first:link])
        start, first = end, link
    return out


def align(docs: DataFrame, key: str = "doc_id", model_a: str = MODEL_A, model_b: str = MODEL_B, digest: bool = False) -> DataFrame:
    """(key, n_a, n_b, groups, links) of every row: tokens of both, the groups as text, and linked id pairs in order.

    Ends that A and B share cut the tokens into groups `a1,a2|b1;a3|b2,b3`. No token is empty, so every shared
    end links just the A token and the B token that end there; a link is a * PAIR + b. Rows are worked on alone and
    nothing is shuffled. Null and empty texts, and texts that a tokenizer changes, have 0 tokens, '' and no links.
    Repeated rows give equal rows, a null key is passed on, an empty table gives an empty one, other columns are not looked at.
    With `digest`, `groups_sha256` (hexadecimal, '' without tokens) stands in place of `groups`, which then never leave the task.
    """
    named = "groups_sha256" if digest else "groups"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = kept_by_worker(("align", model_a, model_b), lambda: Tokenizers(model_a, model_b))
        for batch in slices(batches, "_text", SLICE):
            rows = aligned(batch.column(1).to_pylist(), t)
            offsets = np.append(0, np.cumsum([len(r[3]) for r in rows]))
            texts = [hashlib.sha256(r[2].encode()).hexdigest() if digest and r[2] else r[2] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(texts, pa.string()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([r[3] for r in rows])))],
                ["key", "n_a", "n_b", named, "links"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs["text"].alias("_text"))
    return rows.mapInArrow(run, f"key {kind}, n_a bigint, n_b bigint, {named} string, links array<bigint>").withColumnRenamed("key", key)


def link_slices(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` links (a row of more stands alone). An engine's batch may hold ten thousand rows."""
    for batch in batches:
        ends = np.cumsum(batch.column(column).value_lengths().to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def link_counts(found: DataFrame) -> DataFrame:
    """(pair, n): how many links of the whole table hold each id pair.

    Tasks count their own links first. Of two tokens that end together one's bytes end the other's, so
    there are at most as many pairs as such endings, a bound set by the two vocabularies and not by the texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forgotten_by_worker("align")  # texts are encoded by now
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in link_slices(batches, 0, LINKS):
            seen = np.asarray(batch.column(0).flatten())
            own, n = np.unique(seen, return_counts=True)
            pairs, back = np.unique(np.concatenate([pairs, own]), return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(pairs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

    return found.select("links").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def with_counts(found: DataFrame, counts: DataFrame, keep_links: bool = True) -> DataFrame:
    """`found` and, for each row, n_links, n_best and count_sum: its links, those whose count is the highest
    of their B id (ties included), and the sum of their counts. Without `keep_links` the links themselves stay in the task.

    The counts go to every task as two arrays, within the bound that `link_counts` states.
    """
    table = counts.toPandas().sort_values("pair")
    pairs, n = table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.int64)
    top = np.zeros(PAIR, np.int64)
    np.maximum.at(top, pairs % PAIR, n)
    shared = found.sparkSession.sparkContext.broadcast((pairs, n, n == top[pairs % PAIR]))
    columns = [c for c in found.columns if c not in ("n_links", "n_best", "count_sum")]
    where = columns.index("links")
    given = [i for i in range(len(columns)) if keep_links or i != where]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forgotten_by_worker("align")
        pairs, n, best = shared.value
        for batch in link_slices(batches, where, LINKS):
            links = batch.column(where)
            at = np.searchsorted(pairs, np.asarray(links.flatten()))
            ends = np.append(0, np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False)))
            sums = [np.append(0, np.cumsum(x[at]))[ends] for x in (n, best.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in given], pa.array(np.diff(ends), pa.int64()), pa.array(np.diff(sums[1])), pa.array(np.diff(sums[0]))],
                [*[columns[i] for i in given], "n_links", "n_best", "count_sum"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in found.select(*[columns[i] for i in given]).schema)
    return found.select(*columns).mapInArrow(run, f"{fields}n_links bigint, n_best bigint, count_sum bigint")


def align_counted(docs: DataFrame, key: str = "doc_id", model_a: str = MODEL_A, model_b: str = MODEL_B, digest: bool = False,
                  keep_links: bool = True) -> DataFrame:
    """`align` with the corpus-wide counts of `with_counts`; texts are encoded once, the result waits as Parquet.

    `digest` as for `align`, `keep_links` as for `with_counts`.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "aligned")
    align(docs, key, model_a, model_b, digest).write.parquet(path)
    found = spark.read.parquet(path)
    return with_counts(found, link_counts(found), keep_links)
