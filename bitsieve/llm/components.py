"""Connected components of an edge table, by alternating star contractions.

No task holds more than its share of the edges: minima are partly aggregated
before the shuffle, and the joins have plain shuffles on both sides, so adaptive
execution splits a node with very many edges. Each half of a round is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitsieve.session import cut


def connected(edges: DataFrame) -> DataFrame:
    """(a BIGINT, b BIGINT) -> (node, root): every node of an edge between two nodes, with its component's least node."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = cut(e.distinct())
    before = _state(e)
    while before[0]:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        stars = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(stars.union(least.select("u", F.col("m").alias("v"))).distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
