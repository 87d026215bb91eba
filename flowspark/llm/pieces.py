"""SentencePiece encoding with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from flowspark.llm.words import kept_by_worker, slices, tidied

MODEL = "/opt/tokenizers/piece_bpe_32k.model"  # of a public tokenizer; every node has it or the driver alone
SPACE = "▁"
DROPOUT = 0.1
CACHED = 200_000  # cuts of segments that a task remembers
MANY = 5_000  # segments merged at a time
BLOCK = 1 << 15  # occurrences whose merges are asked for at a time, so that they stay in a core's cache
SLICE = 1 << 20  # bytes of text encoded at a time
MASK = (1 << 64) - 1
PAIR_BITS = 18  # of the hash that finds a pair of symbols
LETTERS = 1 << 9  # code points whose pairs are found by a table
SHORT = 24  # characters up to which segments are merged many at a time
NEVER = np.iinfo(np.int32).max


def skipped(base: int, start: int, end: int, bar: int) -> bool:
    """Whether the keyed hash drops the candidate merge of these characters."""
    return ((base ^ (start * 0x9E3779B97F4A7C15 + end * 0xC2B2AE3D27D4EB4F)) * 0xD6E8FEB86659FD93 & MASK) >> 32 < bar


def both_ends(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What `skipped` joins with the base, for many merges."""
    return start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + end.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def occurrence_bases(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A 64-bit hash per occurrence of a segment from its document's hash and its place there."""
    x = doc + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


class Pieces:
    """A merge vocabulary: pieces with ids and scores, and a piece for each byte."""

    def __init__(self, ids: dict[str, int], scores: dict[str, float], byte_ids: list[int], table: list[bytes]):
        self.ids, self.scores, self.byte_ids, self.table = ids, scores, byte_ids, table
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in ids):
            raise ValueError("pieces that run across a word's end can't be encoded word by word")
        apart = "".join(c for c in "\n\r\t" if not any(c in p and len(p) > 1 for p in ids))
        cut = re.escape(apart)
        self.of_char = np.arange(0x110000) + len(table)
        self.of_char[[ord(p) for p in ids if len(p) == 1]] = [i for p, i in ids.items() if len(p) == 1]
        rank = dict(zip(ids, np.unique([-scores[p] for p in ids], return_inverse=True)[1].tolist()))
        joins = sorted((ids[p[:k]] << 21 | ids[p[k:]], rank[p], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
        codes, ranks, results = (np.array(x, np.int64) for x in zip(*joins))
        bucket = self._bucket(codes)
        order = np.argsort(bucket, kind="stable")
        self.pair_codes, self.pair_ranks, self.pair_results = codes[order], ranks[order].astype(np.int32), results[order].astype(np.int32)
        in_bucket = np.bincount(bucket, minlength=1 << PAIR_BITS)
        self.pair_first = (np.cumsum(in_bucket) - in_bucket).astype(np.int32) % len(codes)
        self.pair_more = np.maximum(in_bucket - 1, 0).astype(np.uint8)
        letters = np.arange(LETTERS)
        letters[0] = ord(SPACE)  # in the place of the character 0
        both = self.of_char[letters][:, None] << 21 | self.of_char[letters]
        self.letter_pairs = self.pairs(both.ravel()).astype(np.int32)
        # no piece joins what lies on two sides of these cuts, so no merge does
        self.segments = re.compile(f"{SPACE}*[^{SPACE}{cut}]+|{SPACE}+" + (f"|[{cut}]" if cut else ""))

    @staticmethod
    def _bucket(codes: np.ndarray) -> np.ndarray:
        return (codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def pairs(self, codes: np.ndarray) -> np.ndarray:
        """Places of pairs of symbols among those that a merge joins, -1 for others."""
        bucket = self._bucket(codes)
        at = self.pair_first[bucket]
        missed = self.pair_codes[at] != codes
        rest = np.flatnonzero(missed & (self.pair_more[bucket] > 0))
        at[missed] = -1
        step = 1
        while len(rest):
            place = self.pair_first[bucket[rest]] + step
            hit = self.pair_codes[place] == codes[rest]
            at[rest[hit]] = place[hit]
            rest = rest[~hit]
            rest = rest[self.pair_more[bucket[rest]] > step]
            step += 1
        return at

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, scores, byte_ids, table = {}, {}, [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
                table.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                table.append(b"")
            else:
                ids[piece], scores[piece] = i, model.get_score(i)
                table.append(piece.replace(SPACE, " ").encode())
        return cls(ids, scores, byte_ids, table)

    def merge(self, segment: str, dropout: float = 0.0, key: int = 0, base: int | None = None) -> list[int]:
        """Ids of one segment: the agenda yields the best-scored merge, leftmost first.

        With dropout, a candidate merge of the characters from `start` to `end` is skipped when
        a hash of the base and both ends falls below the rate. The base is given or a hash of
        the key and the segment.
        """
        out = []
        for piece in self._merge_heap(segment, int(dropout * (1 << 32)), self.base(segment, key) if base is None else base):
            found = self.ids.get(piece)
            if found is not None:
                out.append(found)
            else:
                out += [self.byte_ids[x] for x in piece.encode("utf-8", "surrogatepass")]
        return out

    @staticmethod
    def base(segment: str, key: int) -> int:
        return xxhash.xxh64_intdigest(segment.encode("utf-8", "surrogatepass"), key)

    def merge_many(self, segments: list[str], dropout: float = 0.0, key: int = 0, base: np.ndarray | None = None) -> list[bytes]:
        """`merge` of many short segments at once, as 32-bit ids."""
        if dropout and base is None:
            base = np.array([self.base(x, key) for x in segments], np.uint64)
        flat, sizes, _, _ = self.merge_rows(segments, dropout, base)
        ends = (4 * np.cumsum(sizes)).tolist()
        flat = flat.tobytes()
        return [flat[x:y] for x, y in zip([0, *ends], ends)]

    def merge_rows(self, segments: list[str], dropout: float = 0.0, base: np.ndarray | None = None,
                   without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, how many per segment, merges made, how many per segment): each round takes the best merge of every segment.

        A row per segment holds its symbols (a piece's id, or beyond them the code point of a
        character that is none), links to the next and previous symbol, and as agenda the rank
        of the merge each symbol would make with the next. A merge is given as what `skipped` hashes of both its ends;
        those in the segment's row of `without` are not made.
        """
        sizes = np.array([len(x) for x in segments])
        n, width, rows = len(segments), int(sizes.max()), np.arange(len(segments))
        bar = int(dropout * (1 << 32))
        inside = np.arange(width) < sizes[:, None]
        point = np.zeros((n, width), np.int64)
        point[inside] = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = self.of_char[point]
        after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
        before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
        stop = after.copy()  # where the symbol ends
        agenda, result = np.full((n, width), NEVER, np.int32), np.zeros((n, width), np.int32)

        def offer(r: np.ndarray, a: np.ndarray, at: np.ndarray | None = None) -> None:
            if at is None:
                b = after[r, a]
                fits = b < sizes[r]
                agenda[r[~fits], a[~fits]] = NEVER
                r, a, b = r[fits], a[fits], b[fits]
                at = self.pairs(symbol[r, a] << 21 | symbol[r, b])
                end = stop[r, b]
            else:
                end = a + 2
            hit = at >= 0
            if bar or without is not None:
                ends = both_ends(a, end)
            if bar:
                hit &= ((base[r] ^ ends) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)) >= bar
            if without is not None:
                hit &= (without[r] != ends[:, None]).all(axis=1)
            agenda[r, a] = np.where(hit, self.pair_ranks[at], NEVER)
            result[r, a] = self.pair_results[at]

        low = np.where((point > 0) & (point < LETTERS), point, np.where(point == ord(SPACE), 0, -1))
        pair = np.where(low[:, :-1] < 0, -1, low[:, :-1] * LETTERS + low[:, 1:])
        found = self.letter_pairs[np.maximum(pair, 0)]
        found[~inside[:, 1:]] = -1
        other = np.nonzero(((low[:, :-1] < 0) | (low[:, 1:] < 0)) & inside[:, 1:])
        found[other] = self.pairs(symbol[:, :-1][other] << 21 | symbol[:, 1:][other])
        r, a = np.nonzero(found >= 0)
        offer(r, a, found[r, a])
        live, made = rows, [(rows[:0], np.zeros(0, np.uint64))]
        while len(live):
            a = agenda[live].argmin(axis=1)
            live, a = live[(found := agenda[live, a] < NEVER)], a[found]
            b = after[live, a]
            symbol[live, a], stop[live, a], after[live, a] = result[live, a], stop[live, b], after[live, b]
            agenda[live, b], inside[live, b] = NEVER, False
            made.append((live, both_ends(a, stop[live, a])))
            has_next = after[live, a] < sizes[live]
            before[live[has_next], after[live, a][has_next]] = a[has_next]
            offer(live, a)
            has_last = before[live, a] >= 0
            offer(live[has_last], before[live, a][has_last])
        row, ends = (np.concatenate(x) for x in zip(*made))
        flat, left = symbol[inside], inside.sum(axis=1)
        bare = np.flatnonzero(flat >= len(self.table))  # characters that are no piece
        if len(bare):
            as_bytes = [[self.byte_ids[z] for z in chr(x - len(self.table)).encode("utf-8", "surrogatepass")] for x in flat[bare].tolist()]
            each = np.ones(len(flat), np.int64)
            each[bare] = [len(x) for x in as_bytes]
            owner = np.repeat(rows, left)
            left = np.bincount(owner, weights=each, minlength=n).astype(np.int64)
            is_bare = np.zeros(len(flat), bool)
            is_bare[bare] = True
            flat, is_bare = np.repeat(flat, each), np.repeat(is_bare, each)
            flat[is_bare] = list(chain.from_iterable(as_bytes))
        return flat.astype("<i4"), left, ends[np.argsort(row, kind="stable")], np.bincount(row, minlength=n)

    def _merge_heap(self, segment: str, bar: int, base: int) -> list[str]:
        """Agenda as a heap, for segments of any length."""
        n, get = len(segment), self.scores.get
        left, right, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))  # end 0: merged away
        agenda: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            score = get(segment[a:end[b]])
            if score is not None and not (bar and skipped(base, a, end[b], bar)):
                heapq.heappush(agenda, (-score, a, b, end[b]))

        for a in range(n - 1):
            offer(a, a + 1)
        while agenda:
            _, a, b, stop = heapq.heappop(agenda)
            if not end[a] or end[b] != stop or right[a] != b:
                continue
            end[a], end[b], right[a] = stop, 0, right[b]
            if right[b] < n:
                left[right[b]] = a
                offer(a, right[b])
            if left[a] >= 0:
                offer(left[a], a)
        cut, at = [], 0
        while at < n:
            cut.append(segment[at:end[at]])
            at = right[at]
        return cut

    def decode(self, ids) -> str:
        """The text of ids, without the leading space of encoding."""
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


class Grown:
    """A vector that grows at its end."""

    def __init__(self, kind: type):
        self.held, self.size = np.empty(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.held):
            more = np.empty(max(end, 2 * len(self.held)), self.held.dtype)
            more[:self.size] = self.held[:self.size]
            self.held = more
        self.held[self.size:end] = values
        self.size = end


class Cuts(dict):
    """Cuts of segments, by number: segment -> the number of its cut without dropout.

    Skipping a merge that is not made changes nothing. So a cut knows the merges it made, and for each of them, once asked
    for, the cut that comes about without that merge and those that its own way leads round.
    """

    def __init__(self, pieces: Pieces, whole: bool):
        super().__init__()
        self.pieces, self.whole = pieces, whole  # whether segments of any length are cut, or those up to SHORT only
        self.text: list[str] = []
        self.ids, self.made, self.other = Grown(np.int32), Grown(np.uint64), Grown(np.int32)
        self.ids_at, self.n_ids, self.made_at, self.n_made = (Grown(np.int32) for _ in range(4))
        self.origin, self.avoided, self.before = Grown(np.int32), Grown(np.uint64), Grown(np.int32)

    def __missing__(self, segment: str) -> int:
        self[segment] = number = len(self.text)
        self.text.append(segment)
        return number

    def settle(self) -> None:
        """Cut the segments numbered last."""
        n = len(self.text) - self.n_ids.size
        if n:
            self._append(np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.int64), None)

    def without(self, cut: np.ndarray, at: np.ndarray, depth: int) -> None:
        """Add the cuts that avoid the made merge `at` of each of these cuts, which avoid `depth` merges already."""
        avoided, up = [self.made.held[at]], cut
        for _ in range(depth):
            avoided.append(self.avoided.held[up])
            up = self.origin.held[up]
        self.other.held[at] = np.arange(len(self.text), len(self.text) + len(at))
        self.text += [self.text[i] for i in cut.tolist()]
        self._append(cut, avoided[0], self.before.held[cut] + at - self.made_at.held[cut], np.stack(avoided, axis=1))

    def _append(self, origin: np.ndarray, avoided: np.ndarray, before: np.ndarray, without: np.ndarray | None) -> None:
        """`before`: made merges that are as in the cut it comes from, and known not to be skipped."""
        texts = self.text[self.n_ids.size:]
        sizes = np.array([len(x) for x in texts])
        order = np.argsort(sizes, kind="stable")
        n_ids, n_made = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        ids_at, made_at = n_ids.copy(), n_made.copy()
        if self.whole:
            for i in np.flatnonzero(sizes > SHORT).tolist():
                ids = self.pieces.merge(texts[i])
                ids_at[i], n_ids[i] = self.ids.size, len(ids)
                self.ids.add(ids)
        order = order[(sizes[order] > 0) & (sizes[order] <= SHORT)]
        step = max(1, min(MANY, -(-len(order) // 2)))  # shorter ones apart from longer ones
        for start in range(0, len(order), step):
            some = order[start:start + step]
            ids, each, ends, merges = self.pieces.merge_rows([texts[i] for i in some.tolist()], without=without if without is None else without[some])
            ids_at[some], n_ids[some] = self.ids.size + np.cumsum(each) - each, each
            self.ids.add(ids)
            owner = np.repeat(np.arange(len(some)), merges)
            begin = np.cumsum(merges) - merges
            ends = ends[np.arange(len(ends)) - begin[owner] >= before[some][owner]]
            merges = merges - before[some]
            made_at[some], n_made[some] = self.made.size + np.cumsum(merges) - merges, merges
            self.made.add(ends)
            self.other.add(np.full(len(ends), -1, np.int32))
        for i in np.flatnonzero(sizes == 0).tolist():  # a U+2581 of the text itself
            ids_at[i], n_ids[i] = self.ids.size, len(SPACE.encode())
            self.ids.add([self.pieces.byte_ids[x] for x in SPACE.encode()])
        for grown, values in ((self.ids_at, ids_at), (self.n_ids, n_ids), (self.made_at, made_at), (self.n_made, n_made),
                              (self.origin, origin), (self.avoided, avoided), (self.before, before)):
            grown.add(values)


class Encoder:
    """Encodes texts, every occurrence of a segment with a dropout of its own.

    An occurrence starts from its segment's cut without dropout; the first made merge that its hash skips leads on to the
    cut without it, whose later merges are asked next, until none is skipped. Cuts are remembered, so that a merge runs
    once for all occurrences that skip the same merges, many at a time.
    """

    def __init__(self, pieces: Pieces, dropout: float):
        self.pieces, self.dropout = pieces, dropout
        self.forget()

    def forget(self) -> None:
        self.cuts = Cuts(self.pieces, not self.dropout)

    def _settle(self, number: np.ndarray, base: np.ndarray) -> None:
        """Replace the number of each occurrence's cut without dropout by that of its own."""
        cuts, bar = self.cuts, np.uint64(int(self.dropout * (1 << 32)))
        asked, depth = np.arange(len(number)), 0
        while len(asked):
            losing, lost = [], []
            for start in range(0, len(asked), BLOCK):
                some = asked[start:start + BLOCK]
                own, at, left = base[some], cuts.made_at.held[number[some]], cuts.n_made.held[number[some]]
                live = np.flatnonzero(left > 0)
                while len(live):
                    place = at[live]
                    hit = (own[live] ^ cuts.made.held[place]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32) < bar
                    losing.append(some[live[hit]])
                    lost.append(place[hit])
                    live = live[~hit]
                    at[live] += 1
                    left[live] -= 1
                    live = live[left[live] > 0]
            if not losing:
                break
            asked, lost = np.concatenate(losing), np.concatenate(lost)
            fresh = cuts.other.held[lost] < 0
            if fresh.any():
                places, first = np.unique(lost[fresh], return_index=True)
                cuts.without(number[asked[fresh][first]], places, depth)
            number[asked] = cuts.other.held[lost]
            depth += 1

    def flat(self, texts: list[str | None], docs: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has), with every document's hash in `docs`; a null text has none."""
        find = self.pieces.segments.findall
        found = []
        for t in texts:
            if t and SPACE in t:  # a U+2581 of the text itself becomes bytes, so that decoding tells it from a space
                first, *rest = t.split(SPACE)
                found.append(find(SPACE + first.replace(" ", SPACE)))
                for part in rest:
                    found[-1] += [""] + find(part.replace(" ", SPACE))
            else:
                found.append(find((SPACE + t).replace(" ", SPACE)) if t else [])
        if len(self.cuts.text) > CACHED:
            self.forget()
        cuts, counts = self.cuts, np.array([len(x) for x in found], np.int64)
        words = list(chain.from_iterable(found))
        number = np.fromiter(map(cuts.__getitem__, words), np.int64, len(words))
        cuts.settle()
        starts = np.cumsum(counts) - counts
        at, sizes, kept = cuts.ids_at.held[number], cuts.n_ids.held[number].astype(np.int64), cuts.ids.size
        if self.dropout and words:
            base = occurrence_bases(np.repeat(np.array(docs, np.uint64), counts), np.arange(len(words)) - np.repeat(starts, counts))
            long = np.flatnonzero(sizes == 0).tolist()
            self._settle(number, base)
            at, sizes, kept = cuts.ids_at.held[number], cuts.n_ids.held[number].astype(np.int64), cuts.ids.size
            for i in long:
                ids = self.pieces.merge(words[i], self.dropout, base=int(base[i]))
                at[i], sizes[i] = cuts.ids.size, len(ids)
                cuts.ids.add(ids)
        ends = np.cumsum(sizes)
        ids = cuts.ids.held[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - sizes), sizes)]
        cuts.ids.size = kept
        before = np.concatenate([[0], ends])
        return ids, before[starts + counts] - before[starts]

    def encode(self, texts: list[str | None], docs: list[int]) -> list[bytes | None]:
        """32-bit ids of each text, with its document's hash in `docs`."""
        ids, sizes = self.flat(texts, docs)
        flat, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [None if t is None else flat[x:y] for t, x, y in zip(texts, [0, *ends], ends)]


def _pieces(spark: SparkSession, path: str):
    """The vocabulary, read by the driver and broadcast: its size is the model's, some 2 MB."""
    return spark.sparkContext.broadcast(Pieces.load(path))


def encode(docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = 13,
           key: str = "doc_id", text: str = "text", check: bool = False, copy: str | None = None) -> DataFrame:
    """All columns of `docs` that are not clashing, plus `ids` (array<int>) and `n_pieces`; with `check`, `lossless`.

    A text is cut where no piece of the vocabulary can join, its segments are merged by score
    with merge-dropout, and what the vocabulary lacks becomes bytes. The dropout key comes from
    the seed, the document's key and text and the place of the segment in it, so every
    occurrence of a word has a draw of its own and reruns agree. A column named by `copy` (not
    in the result) tells equal rows of one key apart, as passes over a document. Rate 0 gives
    the model's own segmentation. Decoding gives the text back, character for character.

    Null text gives null ids and 0 pieces, empty text no ids; without `copy` equal rows
    are cut alike; input columns called ids, n_pieces or lossless are replaced; empty tables stay empty.
    """
    shared = _pieces(docs.sparkSession, model)
    kept = [c for c in docs.columns if c not in ("ids", "n_pieces", "lossless", copy)]
    given = docs.select(*kept, *([copy] if copy else []))
    docs = docs.select(*kept)
    at_key, at_text = kept.index(key), kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        encoder = kept_by_worker(("pieces", model, dropout), lambda: Encoder(pieces, dropout))
        for batch in slices(batches, text, SLICE):
            texts = batch.column(at_text).to_pylist()
            copies = batch.column(len(kept)).to_pylist() if copy else [0] * len(texts)
            hashes = [xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass"), xxhash.xxh64_intdigest(f"{seed}:{k}:{c}"))
                      for t, k, c in zip(texts, batch.column(at_key).to_pylist(), copies)]
            flat, sizes = encoder.flat(texts, hashes)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            missing = pa.array([t is None for t in texts]) if None in texts else None
            columns = [*batch.columns[:len(kept)], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=missing), pa.array(sizes.astype(np.int32))]
            if check:
                ends, all_ids = offsets.tolist(), flat.tolist()
                columns.append(pa.array([t is None or pieces.decode(all_ids[x:y]) == t for t, x, y in zip(texts, ends, ends[1:])]))
            yield pa.RecordBatch.from_arrays(columns, names)
        encoder.forget()  # the worker goes on with other work

    names = [*kept, "ids", "n_pieces"] + ["lossless"] * check
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return given.mapInArrow(tidied(run), f"{fields}, ids array<int>, n_pieces int" + ", lossless boolean" * check)


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids", out: str = "text") -> DataFrame:
    """Replace the column of ids by the text they stand for; null ids give null."""
    shared = _pieces(encoded.sparkSession, model)
    kept = [c for c in encoded.columns if c not in (ids, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else shared.value.decode(x) for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*kept, out])

    fields = "".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}, " for c in kept)
    return encoded.select(*kept, ids).mapInArrow(tidied(run), f"{fields}`{out}` string")
