"""SimHash near-duplicates by covering locality-sensitive hashing: every pair within the radius meets in some table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.components import components
from flowspark.llm.words import tidied, words_of
from flowspark.session import settle

BITS = 64
RADIUS = 4
SHINGLE = 4
HASH_SEED = 42
HOT = 256  # fingerprints in a bucket from which it is cut by a second family of masks
CHUNK = 1 << 16  # hashes summed at a time


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text: a bit is set if it is in over half the shingles' hashes."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, HASH_SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())], dtype="<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at:at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def with_fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long): the fingerprint's bits as a signed number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(tidied(run), f"key {kind}, fp bigint").withColumnRenamed("key", key)


def covering_masks(radius: int, seed: int, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks as signed numbers, such that any `radius` bits lie outside one of them.

    Bit i gets a random vector a(i) of radius + 1 bits; mask v keeps the bits with a(i).v = 1 over
    GF(2). For any `radius` bits the equations a(i).v = 0 have a solution v other than zero, whose
    mask leaves out all of them: two values that differ there agree under that mask.
    """
    vectors = np.random.default_rng(seed).permutation(np.arange(bits) % ((1 << (radius + 1)) - 1) + 1)
    masks = [sum(1 << i for i, a in enumerate(vectors.tolist()) if bin(a & v).count("1") & 1) for v in range(1, 1 << (radius + 1))]
    return [m - (1 << bits) if m >> (bits - 1) else m for m in masks]


def _tables(fp: Column, masks: list[int]) -> Column:
    return F.array(*[F.struct(F.lit(v).alias("v"), fp.bitwiseAND(F.lit(m)).alias("kept")) for v, m in enumerate(masks)])


def _spanning_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join the fingerprints within `radius` of each other, at most one fewer than there are."""
    rest, links = np.sort(fps), []
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count((rest ^ x).view(np.uint64)) <= radius
            links += [(int(y), int(x)) for y in rest[near]]
            frontier += list(rest[near])
            rest = rest[~near]
    return links


def _links(keyed: DataFrame, radius: int) -> DataFrame:
    """Links of all buckets; rows of a bucket meet in one task in order, one bucket in memory at a time."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            bucket, fps = frame[["h", "v", "kept"]].to_numpy(), frame["fp"].to_numpy()
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]).any(axis=1)) + 1
            if not len(cuts):
                held = frame
                continue
            held = frame.iloc[cuts[-1]:]
            out = [l for part in np.split(fps[:cuts[-1]], cuts[:-1]) if len(part) > 1 for l in _spanning_links(part, radius)]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        if held is not None:
            yield pd.DataFrame(_spanning_links(held["fp"].to_numpy(), radius), columns=["a", "b"], dtype="int64")

    return (keyed.repartition("h", "v", "kept").sortWithinPartitions("h", "v", "kept", "fp")
            .mapInPandas(tidied(run), "a bigint, b bigint"))


def fingerprint_components(fps: DataFrame, radius: int = RADIUS, seed: int = 11, hot: int = HOT) -> DataFrame:
    """(fp, root): components of distinct fingerprints linked at `radius` or fewer differing bits.

    Every pair within the radius shares a bucket of the first family of masks. Buckets of over
    `hot` fingerprints are cut by a second family: a pair within the radius that shares such a
    bucket also shares one of its parts, so nothing is lost; a part holds fingerprints that agree
    in some three quarters of the bits. A bucket yields a spanning set of links, never its pairs.
    """
    first, second = covering_masks(radius, seed), covering_masks(radius, seed + 1)
    distinct = settle(fps.select("fp").where("fp is not null").distinct())
    keyed = distinct.select("fp", F.explode(_tables(F.col("fp"), first)).alias("t")).select("fp", "t.v", "t.kept")
    shared = keyed.groupBy("v", "kept").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(shared, ["v", "kept"])
    cool = met.where(F.col("n") <= hot).select(F.lit(-1).alias("h"), "v", "kept", "fp")
    cut = met.where(F.col("n") > hot).select("fp", F.col("v").alias("h"), "kept", F.explode(_tables(F.col("fp"), second)).alias("t"))
    cut = cut.select("h", "t.v", F.col("kept").bitwiseOR(F.lit(0)).alias("_k"), F.col("t.kept").alias("_k2"), "fp")
    cut = cut.select("h", "v", F.xxhash64("_k", "_k2").alias("kept"), "fp")
    return components(_links(cool.unionByName(cut), radius)).select(F.col("id").alias("fp"), F.col("component_id").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint, component_id): SimHash of whole texts and the smallest key reachable by links.

    Documents of one fingerprint are linked first (fingerprint zero, for texts without words,
    like any other), then distinct fingerprints by covering hashing. Null and empty texts have
    fingerprint zero; repeated rows come back as often as they went in; an empty table gives an
    empty one; other columns are ignored; a null key is never the smallest.
    """
    fps = settle(with_fingerprint(docs, key, text))
    roots = fingerprint_components(fps, radius)
    smallest = fps.groupBy("fp").agg(F.min(key).alias("low"))
    grouped = smallest.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    named = grouped.join(lows, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
