"""Distributed union-find: the smallest id of every connected component of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.session import settle


def _fingerprint(edges: DataFrame) -> tuple:
    """Row count and an order-free hash: equal for equal edge sets."""
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) for each id in the edges `a`, `b`: the smallest id it is connected with.

    Alternates the large-star and the small-star step: each node hands its neighbours to the
    smallest of them, so a hub keeps one row per neighbour and no task holds a component. The
    edges shrink to stars round the smallest ids in a logarithmic number of rounds; each round is
    checkpointed. Self-loops, repeated edges and either direction are fine; an empty table gives
    an empty one; a null id links with nothing.
    """
    pairs = settle(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _fingerprint(pairs)
    while seen[0]:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
                 .select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
        pairs = settle(small)
        now = _fingerprint(pairs)
        if now == seen:
            break
        seen = now
    members = pairs.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    roots = pairs.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return members.unionByName(roots)
