"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.storage import discard, materialize


def _to_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) of all neighbours v of u: for each u its least neighbour or itself, joined to every pair."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("of"), F.least("u", "least").alias("least"))
    return pairs.join(least, F.col("u") == F.col("of")).drop("of")


def components(links: DataFrame) -> DataFrame:
    """links: (u, v) of any two types that compare, in either direction, repeated or not; links of a node with itself are ignored.

    Returns (node, component) for every node with a link: component is the least node reachable. Stars with very many
    links are joined, never collected, so Spark can split them. Each round is written to the shared folder; the number of
    rounds grows with the logarithm of the longest chain.
    """
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    known = _fingerprint(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        small = _to_least(large)
        small = small.select("v", "least").unionByName(small.select(F.col("u").alias("v"), "least")).where("v <> least")
        fresh = materialize(small.select(F.col("v").alias("u"), F.col("least").alias("v")).distinct(), "stars")
        found = _fingerprint(fresh)
        discard(edges)
        if found == known:
            return fresh.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(fresh.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        edges, known = fresh, found


def _fingerprint(pairs: DataFrame) -> tuple:
    """What equal sets of pairs have in common: their number and two sums of hashes."""
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
