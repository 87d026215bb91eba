"""Fuzzy line dedup by MinHash: character-shingle signatures, banding, exact Jaccard, union-find.

Signatures and exact comparisons run in Arrow batches; everything else is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.components import components
from flowspark.llm.words import tidied
from flowspark.session import parallelism, scratch_path, settle

SHINGLE = 5  # characters of a shingle, in signatures and in the exact comparison
THRESHOLD = 0.8
BANDS, ROWS = 12, 5  # two lines of similarity 0.8 share a band with probability 1 - (1 - 0.8 ** 5) ** 12 = 0.991
BLOCK = 512  # lines of an unsettled band that meet at a time
AGREEING = 34  # bins of BANDS * ROWS in which a pair must agree to be compared; at similarity 0.8 fewer have a probability of 1e-5
PLANES = 4  # bits of each minimum that tell whether two lines agree in a bin; all are equal by chance in one of 16
FILTER_WORDS = 1 << 16  # 64-bit words of the filter that keeps texts out of a shuffle
CHUNK = 1 << 16  # characters hashed at a time, so that their hashes stay in a core's cache
PAIRS = 1 << 10  # pairs compared at a time
PAIR_CHARS = 1 << 20  # characters of the pairs compared at a time
SEEN = 1 << 18  # lines of which a task remembers that it has signed them
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def normalized(line: Column) -> Column:
    """What two equal lines share: no blanks at the ends, lower case."""
    return F.lower(F.trim(line))


def _line_ids(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.xxhash64(normalized(x)))


def _kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows, written to the shared folder, and their path; the shuffles that made them are freed at once."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path), path


def _discard(df: DataFrame, path: str) -> None:
    """Remove a table that nothing reads any more."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, lengths): a 64-bit hash of every shingle, one line's after the other's, and how many each line has."""
    chars = np.frombuffer("".join(lines).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    if len(chars) < SHINGLE:
        return np.zeros(0, np.uint64), np.zeros(len(lines), np.int64)
    last = len(chars) - SHINGLE + 1
    h = chars[:last].copy()
    for i in range(1, SHINGLE):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += chars[i:i + last]
    for _ in range(2):  # every bit of the sum reaches every other
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    counts = np.maximum(sizes - SHINGLE + 1, 0)
    inside = np.ones(len(chars), bool)
    ends = np.cumsum(sizes)
    for back in range(1, SHINGLE):  # a shingle that would start among the last characters of a line runs over its end
        at = ends - back
        inside[at[sizes >= back]] = False
    return h[inside[:last]], counts


# Bins in the order in which an empty bin asks them for their minimum.
ASKED = np.argsort(np.random.default_rng(17).random((BANDS * ROWS, BANDS * ROWS)), axis=1)


def minima(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(least, counts): the least hash of every line in each of BANDS * ROWS bins, and how many shingles it has.

    One hash of a shingle gives its bin and its value. An empty bin takes the minimum of the first filled bin in its own
    fixed order, so two lines agree in a bin with a probability equal to their similarity, however short they are.
    """
    h, counts = shingle_hashes(lines)
    bins = BANDS * ROWS
    least = np.full(len(lines) * bins, NONE)
    owner = np.repeat(np.arange(len(lines)), counts)
    bin_of = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(least, owner * bins + bin_of, h)
    least = least.reshape(len(lines), bins)
    given = least.copy()
    row, col = np.nonzero((given == NONE) & (counts > 0)[:, None])
    for turn in range(bins):
        if not len(row):
            break
        offered = given[row, ASKED[col, turn]]
        least[row, col] = offered
        row, col = row[offered == NONE], col[offered == NONE]
    return least, counts


def band_hashes(least: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(lines, BANDS): a hash per band of a line's minima; zeros for a line without a full shingle."""
    band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(least), BANDS)).copy()
    for row in range(ROWS):
        band ^= least[:, row::ROWS]
        band *= np.uint64(0x9FB21C651E98DF25)
        band ^= band >> np.uint64(29)
    band[counts == 0] = 0
    return band.view(np.int64)


def planes(least: np.ndarray) -> np.ndarray:
    """(lines, PLANES): bit p of every minimum of a line, as one 64-bit number."""
    bits = np.zeros((len(least), PLANES, 64), np.uint8)
    for p in range(PLANES):
        bits[:, p, :BANDS * ROWS] = least >> np.uint64(32 + p) & np.uint64(1)
    return np.packbits(bits, axis=2).view(np.int64)[:, :, 0]


def _chunks(lines: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of lines of about CHUNK characters."""
    start = size = 0
    for i, line in enumerate(lines):
        size += len(line)
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(lines):
        yield start, len(lines)


def lines_of(docs: DataFrame, text: str, *columns: Column) -> DataFrame:
    """(columns, line, id): every line that is not blank."""
    lines = docs.select(*columns, F.explode(F.split(F.col(text), "\n")).alias("line")).where("trim(line) <> ''")
    return lines.withColumn("line", normalized(F.col("line"))).withColumn("id", F.xxhash64("line"))


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, key, bands, marks): every line with its bands, null for lines without a full shingle, and PLANES bits of each minimum.

    A line that the task has signed already, as far as it remembers, has neither bands nor marks again.
    """
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column("id").to_pylist()
            fresh = np.zeros(len(ids), bool)
            for i, x in enumerate(ids):
                if x not in seen:
                    seen.add(x)
                    fresh[i] = True
            if len(seen) > SEEN:
                seen.clear()
            at, lines = np.flatnonzero(fresh), batch.column("line").filter(pa.array(fresh)).to_pylist()
            bands, marks = np.zeros((len(ids), BANDS), np.int64), [None] * len(ids)
            for start, end in _chunks(lines):
                least, counts = minima(lines[start:end])
                bands[at[start:end]] = band_hashes(least, counts)
                for i, row in zip(at[start:end].tolist(), planes(least).tolist()):
                    marks[i] = row
            none = ~bands.any(axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()), mask=pa.array(none))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), lists, pa.array(marks, pa.list_(pa.int64()))],
                                             names=["id", "key", "bands", "marks"])

    lines = lines_of(docs, text, F.col(key).alias("key")).select("id", "key", "line")
    kind = docs.schema[key].dataType.simpleString()
    return lines.mapInArrow(tidied(sign), f"id bigint, key {kind}, bands array<bigint>, marks array<bigint>")


def shared_bands(signed: DataFrame) -> DataFrame:
    """(id, k): the bands that several different lines have; one shuffle serves the aggregate, the join and the distinct rows."""
    keyed = signed.select("id", F.explode("bands").alias("k")).repartition("k")
    shared = keyed.groupBy("k").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("k")
    return keyed.join(shared.hint("shuffle_hash"), "k").distinct()


WORD_OF_ID = f"cast(pmod(id, {FILTER_WORDS}) as int)"
BIT_OF_ID = "shiftleft(1L, cast(pmod(shiftright(id, 40), 64) as int))"


def _filter_words(ids: DataFrame) -> DataFrame:
    """Bits of the ids by word: at most FILTER_WORDS rows whatever the number of ids."""
    return ids.groupBy(F.expr(WORD_OF_ID).alias("w")).agg(F.expr(f"bit_or({BIT_OF_ID})").alias("bits"))


def promising(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b) whose minima agree in AGREEING bins or more, by the marks (id, marks) of their lines."""
    left, right = (marks.select(F.col("id").alias(i), F.col("marks").alias(m)) for i, m in (("a", "x"), ("b", "y")))
    unlike = " | ".join(f"(x[{p}] ^ y[{p}])" for p in range(PLANES))
    return pairs.join(right, "b").join(left, "a").where(f"bit_count({unlike}) <= {BANDS * ROWS - AGREEING}").select("a", "b")


def texts_of(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(id, line): the wanted lines, once each."""
    words = _filter_words(wanted).hint("broadcast")
    maybe = lines_of(docs, text).join(words, F.expr(f"{WORD_OF_ID} = w")).where(f"bits & {BIT_OF_ID} <> 0")
    return maybe.select("id", "line").join(wanted, "id", "left_semi").dropDuplicates(["id"])


def alike(lines: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs (left, right) of at most 2 * PAIRS lines, at most PAIRS, have a Jaccard similarity of THRESHOLD or more.

    A line is hashed and sorted once, however many pairs hold it. The pair's number and 53 bits of a shingle's hash make one
    number, so merging two sorted runs finds what every pair shares.
    """
    h, counts = shingle_hashes(lines)
    shift, low = np.uint64(53), np.uint64((1 << 53) - 1)
    sets = np.unique(np.repeat(np.arange(len(lines), dtype=np.uint64), counts) << shift | h >> np.uint64(11))
    sizes = np.bincount((sets >> shift).astype(np.int64), minlength=len(lines))
    ends = np.cumsum(sizes)
    sets &= low
    x, y = sizes[left], sizes[right]
    near = np.minimum(x, y) >= THRESHOLD * np.maximum(x, y)  # what they share is no more than the less, their union no less than the more
    runs = []
    for side in (left[near], right[near]):
        n = sizes[side]
        at = np.repeat(ends[side] - np.cumsum(n), n) + np.arange(n.sum())
        runs.append(np.repeat(np.arange(len(side), dtype=np.uint64), n) << shift | sets[at])
    both = np.sort(np.concatenate(runs), kind="stable")
    common = np.zeros(len(left), np.int64)
    common[near] = np.bincount((both[1:][both[1:] == both[:-1]] >> shift).astype(np.int64), minlength=int(near.sum()))
    return (common > 0) & (common >= THRESHOLD * (x + y - common))


def similar(xs: list[str], ys: list[str]) -> np.ndarray:
    """Which pairs of lines have a Jaccard similarity of THRESHOLD or more, for at most PAIRS pairs."""
    return alike(xs + ys, np.arange(len(xs)), np.arange(len(xs), 2 * len(xs)))


def alike_rows(lines: pa.Array, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The same for any number of pairs of an array of lines, PAIRS or PAIR_CHARS at a time."""
    chars = pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    done, size, found, start = len(left), np.cumsum(chars[left] + chars[right]), np.zeros(len(left), bool), 0
    while start < done:
        before = size[start - 1] if start else 0
        end = max(start + 1, min(start + PAIRS, int(np.searchsorted(size, before + PAIR_CHARS))))
        used, place = np.unique(np.concatenate([left[start:end], right[start:end]]), return_inverse=True)
        found[start:end] = alike(lines.take(pa.array(used)).to_pylist(), *np.split(place, 2))
        start = end
    return found


def linked_lines(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets of SHINGLE-character shingles have a Jaccard similarity of THRESHOLD or more."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.concatenate([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")])
            _, first, number = np.unique(ids, return_index=True, return_inverse=True)
            lines = pa.chunked_array([batch.column("x"), batch.column("y")]).take(pa.array(first)).combine_chunks()
            keep = alike_rows(lines, *np.split(number, 2))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    left = texts.select(F.col("id").alias("a"), F.col("line").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("line").alias("y"))
    met = pairs.join(right, "b").join(left, "a")
    return met.select("a", "b", "x", "y").mapInArrow(tidied(compare), "a bigint, b bigint")


def spanning_links(ids: list[int], roots: list[int], lines: list[str], first: int) -> list[tuple[int, int]]:
    """Links between roots that the first `first` lines make with each other and with the rest; none that joins what is joined already."""
    h, counts = shingle_hashes(lines)
    owner = np.repeat(np.arange(len(lines)), counts)
    order = np.lexsort((owner, h))
    h, owner = h[order], owner[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[once], owner[once]
    sizes = np.bincount(owner, minlength=len(lines))
    by_line = np.split(h[np.argsort(owner, kind="stable")], np.cumsum(sizes)[:-1])
    up: dict[int, int] = {}

    def top(r: int) -> int:
        while up.get(r, r) != r:
            r = up[r]
        return r

    links = []
    for i in range(first):
        low, high = np.searchsorted(h, by_line[i]), np.searchsorted(h, by_line[i], side="right")
        spans = high - low
        at = np.repeat(low - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
        common = np.bincount(owner[at], minlength=len(lines))
        for j in np.flatnonzero((common > 0) & (common >= THRESHOLD * (sizes[i] + sizes - common))):
            a, b = top(roots[i]), top(roots[j])
            if j > i and a != b:
                up[max(a, b)] = min(a, b)
                links.append((a, b))
    return links


def joined_roots(roots_a: np.ndarray, roots_b: np.ndarray) -> list[tuple[int, int]]:
    """Of links between roots those that join what is not joined by the links before: fewer than there are roots."""
    up: dict[int, int] = {}

    def top(r: int) -> int:
        while up.get(r, r) != r:
            up[r] = r = up.get(up[r], up[r])
        return r

    links = []
    for a, b in zip(roots_a.tolist(), roots_b.tolist()):
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            links.append((a, b))
    return links


def band_links(named: DataFrame, texts: DataFrame, marks: DataFrame) -> DataFrame:
    """Links (a, b) between roots that lines of one band and different roots (id, k, root) make.

    Pairs are compared where their band is, by marks and then exactly; only links that join two roots leave the task.
    """
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in chain(batches, (None,)):
            if batch is not None:
                held = batch if held is None or not held.num_rows else pa.concat_batches([held, batch])
            if held is None or not held.num_rows:
                continue
            band = held.column("k").to_numpy(zero_copy_only=False)
            cut = len(band) if batch is None else int(np.flatnonzero(band == band[-1])[0])  # the last band may go on
            now, held, band = held.slice(0, cut), held.slice(cut), band[:cut]
            line, root = (now.column(c).to_numpy(zero_copy_only=False) for c in ("id", "root"))
            mark = now.column("marks").flatten().to_numpy(zero_copy_only=False).reshape(-1, PLANES)
            at, step, pairs = np.arange(cut), 1, [np.zeros((2, 0), np.int64)]
            while len(at):
                at = at[at + step < cut]
                at = at[band[at] == band[at + step]]
                far = at[root[at] != root[at + step]]
                unlike = np.bitwise_count(np.bitwise_or.reduce(mark[far] ^ mark[far + step], axis=1).view(np.uint64))  # of signed numbers it counts the amount
                near = far[unlike <= BANDS * ROWS - AGREEING]
                pairs.append(np.stack([near, near + step]))
                step += 1
            _, first, number = np.unique(line, return_index=True, return_inverse=True)
            met = np.sort(first[number][np.concatenate(pairs, axis=1)], axis=0)  # a line where it stands first, so that pairs of a band stay together
            a, b = np.divmod(np.unique(met[0] * cut + met[1]), max(cut, 1))  # a pair of several bands once
            like = alike_rows(now.column("line"), a, b)
            links = joined_roots(root[a[like]], root[b[like]])
            yield pa.RecordBatch.from_arrays([pa.array([l[i] for l in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    rows = named.join(marks, "id").join(texts, "id").select("k", "id", "root", "marks", "line").repartition("k").sortWithinPartitions("k")
    return rows.mapInArrow(tidied(meet), "a bigint, b bigint").distinct()


def open_links(bands: DataFrame, roots: DataFrame, texts: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that the lines of bands (id, k) make which hold lines of several roots (id, root).

    Of bands with the same lines one is enough. With `marks`, pairs of different roots of a band of up to BLOCK lines are
    compared exactly if they agree in enough minima. The lines of a larger band are dealt into
    blocks of about BLOCK, and every block meets itself and each other: no pair is lost, and a pair of blocks gives only
    links that join two roots.
    """
    named = bands.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    groups = named.groupBy("k").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(id))").alias("set"), F.min("root").alias("low"), F.max("root").alias("high"))
    groups = groups.where("low <> high").groupBy("n", "set").agg(F.min("k").alias("k"))
    named = _kept(named.join(groups.select("k", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "k"), "open")[0]
    crowds = named if marks is None else named.where("blocks > 1")
    small = None if marks is None else _kept(band_links(named.where("blocks = 1"), texts, marks), "links")[0]
    if small is not None and crowds.isEmpty():
        return small
    dealt = crowds.join(texts, "id").withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
    member = F.struct("id", "root", "line")
    blocks, path = _kept(dealt.groupBy("k", "blocks", "block").agg(F.collect_list(member).alias("xs")), "blocks")
    later = blocks.select("k", "xs", F.col("block").alias("own"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("block"))
    met = later.join(blocks.select("k", "block", F.col("xs").alias("ys")), ["k", "block"]).repartition(parallelism(bands.sparkSession))
    met = met.select("xs", F.when(F.col("own") < F.col("block"), F.col("ys")).otherwise(F.array().cast(blocks.schema["xs"].dataType)).alias("ys"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for row in range(batch.num_rows):
                xs, ys = batch.column("xs")[row].as_py(), batch.column("ys")[row].as_py()
                every = xs + ys
                links += spanning_links([m["id"] for m in every], [m["root"] for m in every], [m["line"] for m in every], len(xs))
            yield pa.RecordBatch.from_arrays([pa.array([l[i] for l in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    links = _kept(met.mapInArrow(tidied(meet), "a bigint, b bigint").distinct(), "links")[0]
    _discard(blocks, path)
    return links if small is None else links.unionByName(small)


def components_of(bands: DataFrame, docs: DataFrame, text: str, marks: DataFrame | None = None) -> DataFrame:
    """(id, root): lines linked to another, directly or over others, among those that share a band.

    The lines of a band first meet its smallest id, which settles variants of one line. Bands that
    still hold lines of several roots go to `open_links`, which loses no pair. With `marks` (id, marks) only
    pairs that agree in enough minima are compared, but for bands of over BLOCK lines.
    """
    texts, path = _kept(texts_of(docs, bands.select("id").distinct(), text), "lines")
    hubs = bands.groupBy("k").agg(F.min("id").alias("a"))
    pairs = bands.join(hubs, "k").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    pairs = _kept(promising(pairs, marks) if marks is not None else pairs, "pairs")[0]
    linked = _kept(linked_lines(texts, pairs), "linked")[0]
    stars = components(linked).withColumnRenamed("component_id", "root")
    more = open_links(bands, stars, texts, marks)
    _discard(texts, path)
    if more.isEmpty():
        return stars
    return components(more.unionByName(stars.select(F.col("id").alias("a"), F.col("root").alias("b")))).withColumnRenamed("component_id", "root")


def line_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, root, first): lines that occur more than once or are linked, their component and the smallest key that holds it."""
    signed, path = _kept(signatures(docs, key, text), "signatures")
    bands = _kept(shared_bands(signed), "bands")[0]
    lines = _kept(signed.groupBy("id").agg(F.min("key").alias("first"), F.count("*").alias("n")), "firsts")[0]
    banded = bands.select("id").distinct()
    marked = signed.where("marks is not null").select("id", "marks").join(_filter_words(banded).hint("broadcast"), F.expr(f"{WORD_OF_ID} = w"))
    marked = marked.where(f"bits & {BIT_OF_ID} <> 0").select("id", "marks").join(banded, "id", "left_semi")
    marks = _kept(marked.dropDuplicates(["id"]), "marks")[0]
    _discard(signed, path)
    named = lines.join(components_of(bands, docs, text, marks), "id", "left").where("n > 1 or root is not null")
    named = named.withColumn("root", F.coalesce("root", "id"))
    firsts = named.groupBy("root").agg(F.min("first").alias("first"))
    return named.select("id", "root").join(firsts, "root")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the text of kept lines, `n_lines` and `n_dropped`.

    Lines are equal if they are without blanks at the ends and case; fuzzy duplicates share at
    least THRESHOLD of their character shingles, directly or over other lines. Of each
    component the first line of the smallest key stays and all others go. Blank lines stay.
    Lines of fewer than SHINGLE characters are one shingle, so they have only exact duplicates.

    Null text stays null with 0 lines; empty text is one blank line. Rows of one key come at the same place: if it is the
    first, each of them keeps the line, so different texts of one key lose nothing to each other and repeated rows keep the same
    lines. Rows without a key come behind all others. Input columns called n_lines or n_dropped are replaced; empty tables
    give empty results.
    """
    classes = settle(line_classes(docs, key, text))
    row = F.xxhash64(key, text).alias("_doc")  # tells rows of one key apart by their text
    own = docs.select(row, F.posexplode(_line_ids(F.col(text))).alias("_at", "id"))
    marked = settle(own.join(classes, "id").groupBy("_doc").agg(F.array_distinct(F.collect_list(F.struct("_at", "root", "first"))).alias("_marks")))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # documents that surely have no marked line pass by the shuffle: the filter never misses a marked one
    words = _filter_words(marked.select(F.col("_doc").alias("id")))
    flagged = docs.select(*kept).withColumn("_id", row).join(words.hint("broadcast"), F.expr(WORD_OF_ID.replace("id,", "_id,") + " = w"), "left")
    flagged = flagged.withColumn("_maybe", F.expr(f"coalesce(bits & {BIT_OF_ID.replace('(id', '(_id')}, 0) <> 0"))
    through = flagged.where("_maybe").select(*kept, F.col("_id").alias("_own")).join(marked, F.col("_own") == F.col("_doc"), "left").drop("_own", "_doc")
    past = flagged.where("not _maybe").select(*kept, F.lit(None).cast(marked.schema["_marks"].dataType).alias("_marks"))
    joined = through.unionByName(past)
    marks = F.array_sort("_marks")
    roots = F.transform(marks, lambda m: m["root"])
    dropped = F.transform(F.filter(marks, lambda m, i: ~m["first"].eqNullSafe(F.col(key)) | (F.array_position(roots, m["root"]) != i + 1)), lambda m: m["_at"])
    lines = F.split(F.col(text), "\n")
    drops = F.coalesce(F.size("_dropped"), F.lit(0))
    cleaned = F.when(F.coalesce(F.size("_dropped"), F.lit(0)) > 0, F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_dropped", i)), "\n")).otherwise(F.col(text))
    return joined.withColumn("_dropped", dropped).select(
        *[cleaned.alias(text) if c == text else c for c in kept],
        F.coalesce(F.when(F.col(text).isNotNull(), F.size(lines)), F.lit(0)).alias("n_lines"), F.greatest(drops, F.lit(0)).alias("n_dropped"))
