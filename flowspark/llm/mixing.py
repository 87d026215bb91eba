"""Mixing sources to target weights: fixed-length blocks drawn by multinomial counts per shard and joined by index."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.session import parallelism, settle

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 128  # words in a block
SHARD_SLOTS = 131_072  # blocks in an output shard, some 17 million words
RUN_SLOTS = 8192  # slots that one row stands for until it is dealt to a task
ROUNDS = 24  # of the block permutation
HASH_BUCKETS = 1024  # parts a source is cut into for running totals


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shares(sizes: Sequence[int], weights: Sequence[float], total: float, ceiling: float) -> list[float]:
    """Targets in proportion to the weights, none above `ceiling` times its size.

    What a full source cannot take is shared again among the others by weight.
    """
    target, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > ceiling * sizes[i]]
        for i in full or open_:
            target[i] = ceiling * sizes[i] if full else unit * weights[i]
        if not full:
            break
        left -= sum(target[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return target


def _hash(seed: int, *parts) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


def _permuted(index: Column, n: Column, *key: Column) -> Column:
    """A keyed bijection on 0..n-1: swap-or-not rounds.

    A round pairs each index i with (k - i) mod n and lets one keyed bit of the pair's larger
    member decide for both whether they change places; either way it is its own inverse.
    """
    def turn(i: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *key), n) - i, n)
        stays = F.pmod(F.xxhash64(r, F.lit("bit"), F.greatest(i, other), *key), F.lit(2)) == 0
        return F.when(stays, i).otherwise(other)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, turn)


def plan_sources(sized: DataFrame, weights: Sequence[float], total_share: float, ceiling: float, block: int) -> list[dict]:
    """Size, target, blocks and slots of each source, in code point order with null last.

    One row per source reaches the driver: sources are named collections, a bounded list.
    """
    rows = sorted(sized.groupBy("source").agg(F.sum("size").alias("size")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in rows]
    targets = shares(sizes, [weights[i % len(weights)] for i in range(len(rows))], total_share * sum(sizes), ceiling)
    plan = []
    for i, (row, size, target) in enumerate(zip(rows, sizes, targets)):
        blocks = -(-size // block)
        slots = min(math.floor(ceiling * blocks), round(target * blocks / size)) if size else 0
        plan.append({"nr": i, "source": row["source"], "size": size, "target": target, "blocks": blocks, "slots": slots})
    return plan


def draw_shards(plan: Sequence[dict], shard_slots: int, seed: int) -> pd.DataFrame:
    """(shard, source nr, first occurrence, count): multinomial counts of each shard, settled to the targets.

    Each shard draws its counts by the sources' shares of all slots. Summed over shards a draw
    strays from the target, so draws past a source's slots pass, in shard order, to the sources
    that are short. One number per shard and source: the table holds no row of data.
    """
    slots = np.array([p["slots"] for p in plan], dtype=np.int64)
    total = int(slots.sum())
    if not total:
        return pd.DataFrame({name: np.zeros(0, np.int64) for name in ("shard", "nr", "first", "n")})
    rng = np.random.default_rng(seed)
    shards = -(-total // shard_slots)
    each = np.full(shards, shard_slots, dtype=np.int64)
    each[-1] = total - shard_slots * (shards - 1)
    counts = rng.multinomial(each, slots / total)
    run = np.cumsum(counts, axis=0)
    kept = np.minimum(run, slots) - np.minimum(run - counts, slots)
    spare, short = (counts - kept).sum(axis=1), slots - kept.sum(axis=0)
    ends = np.cumsum(short)
    at = 0
    for shard in np.flatnonzero(spare):  # hand the surplus of a shard to the next short sources
        lo, hi = at, at + int(spare[shard])
        kept[shard] += np.clip(np.minimum(ends, hi) - np.maximum(ends - short, lo), 0, None)
        at = hi
    first = np.cumsum(kept, axis=0) - kept
    shard, nr = np.nonzero(kept)
    return pd.DataFrame({"shard": shard, "nr": nr, "first": first[shard, nr], "n": kept[shard, nr]})


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), total_share: float = 1.5, ceiling: float = 2.0,
        block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 7, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(documents, blocks) of a mix of `total_share` times all words, sources weighted in turn.

    documents: key, source, size, source_size, target, taken, and `pieces`: which words of the
    document the mix takes, as structs (start, words, times), in text order.
    blocks: shard, slot source `nr`, block, key, start, words: the content of each output shard.

    The words of a source, its documents in keyed hash order, are cut into blocks of `block`
    words (the last may be shorter). Occurrence j of a source takes block pi(j mod blocks), pi
    being a permutation keyed by source and pass, so a block is taken again only when all were
    taken, and no document is taken more than `ceiling` times whole numbers of passes. Blocks and
    documents meet by an equality join on (source, block). Running offsets come from hash
    buckets whose sums are added up first, so a source that holds most rows is never one group.

    Null text counts 0 words and null source is a source of its own; every row is a document of its own, so rows of one
    key, and rows whose key is null, are mixed each by itself; `text_hash` tells rows of one key apart. Empty tables give
    empty results; other columns are ignored.
    """
    spark = docs.sparkSession
    sized = settle(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key), "source", word_count(F.col("text")).alias("size"),
                               F.xxhash64("text").alias("text_hash")))
    plan = plan_sources(sized, weights, total_share, ceiling, block)
    facts = spark.createDataFrame([tuple(p.values()) for p in plan], "nr long, source string, source_size long, target double, blocks long, slots long")
    known = sized.join(F.broadcast(facts), sized["source"].eqNullSafe(facts["source"])).drop(facts["source"])

    part = F.pmod(_hash(seed, key), F.lit(HASH_BUCKETS)).cast("int")
    known = known.withColumn("_b", part)
    sums = known.groupBy("nr", "_b").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("nr").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("nr", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # HASH_BUCKETS rows a source
    inside = Window.partitionBy("nr", "_b").orderBy(_hash(seed + 1, key), key, "_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = (known.withColumn("_run", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(F.broadcast(base), ["nr", "_b"]).withColumn("offset", F.col("_base") + F.col("_run")))

    draws = spark.createDataFrame(draw_shards(plan, shard_slots, seed), "shard long, nr long, first long, n long")
    runs = draws.select("shard", "nr", F.col("first").alias("lo"), (F.col("first") + F.col("n")).alias("hi"))
    runs = runs.select("shard", "nr", "hi", F.explode(F.expr(f"sequence(lo, hi - 1, {RUN_SLOTS}L)")).alias("lo"))
    slots = (runs.repartition(parallelism(spark), "nr", "lo").join(F.broadcast(facts.select("nr", "blocks")), "nr")
             .select("shard", "nr", "blocks", F.explode(F.expr(f"sequence(lo, least(lo + {RUN_SLOTS}L, hi) - 1)")).alias("j")))
    taken = slots.select("shard", "nr", _permuted_block(seed).alias("block"))

    spans = placed.where("size > 0").select(
        "_row", key, "nr", "offset", "size",
        F.explode(F.expr(f"sequence(offset div {block}, (offset + size - 1) div {block})")).alias("block"))
    lo = F.greatest(F.col("offset"), F.col("block") * block)
    hi = F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block)
    spans = spans.select("_row", key, "nr", "block", (lo - F.col("offset")).alias("start"), (hi - lo).alias("words"))
    times = taken.groupBy("nr", "block").agg(F.count("*").alias("times"))
    per_doc = (spans.join(times, ["nr", "block"])
               .groupBy("_row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"),
                                       F.array_sort(F.collect_list(F.struct("start", "words", "times"))).alias("pieces")))
    documents = placed.join(per_doc, "_row", "left").select(
        key, "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "pieces", "text_hash")
    return documents, taken.join(spans, ["nr", "block"]).select("shard", "nr", "block", key, "start", "words")


def _permuted_block(seed: int) -> Column:
    passes = F.expr("j div blocks")
    return _permuted(F.pmod(F.col("j"), F.col("blocks")), F.col("blocks"), F.lit(seed), F.col("nr"), passes)


def mixed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The mix as documents: all columns of `docs`, one row per document and pass that takes words of it.

    The text holds the words that the pass takes, in order and with the blanks after them; a
    text that is taken whole stays as it is. Documents of which nothing is taken go. Rows of one key, null included, are told apart by their
    text, and rows equal in both are numbered, so each is mixed by itself.
    """
    copy = lambda d, k, h, order: d.withColumn("_copy", F.row_number().over(Window.partitionBy(k, h).orderBy(*order)))
    mixed = mix(docs, key=key, **options)[0].select(F.col(key).alias("_key"), F.col("text_hash").alias("_text_hash"), F.col("size").alias("_size"),
                                                   "taken", F.col("pieces").alias("_pieces"))
    mixed = copy(mixed, "_key", "_text_hash", ["taken", "_pieces"]).where("taken > 0").drop("taken").withColumnRenamed("_copy", "_taken_copy")
    given = copy(docs.withColumn("_h", F.xxhash64(text)), F.col(key), "_h", [F.lit(1)])
    passes = F.explode(F.sequence(F.lit(1), F.array_max(F.transform("_pieces", lambda p: p["times"])).cast("int")))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_h") == F.col("_text_hash")) & (F.col("_copy") == F.col("_taken_copy"))
    found = given.join(mixed, same).withColumn("_pass", passes)
    own = F.filter("_pieces", lambda p: p["times"] >= F.col("_pass"))
    words = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    part = F.array_join(F.flatten(F.transform(own, lambda p: F.slice(words, (p["start"] + 1).cast("int"), p["words"].cast("int")))), "")
    whole = F.aggregate(own, F.lit(0).cast("long"), lambda n, p: n + p["words"]) == F.col("_size")
    return found.withColumn(text, F.when(whole, F.col(text)).otherwise(part)).select(*docs.columns)
