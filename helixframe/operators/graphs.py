"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.sources.scratch import written


def component_of(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b): component is the least node that links lead to, in either direction.

    Two steps take turns until nothing changes: each node's larger neighbours are linked to its least neighbour, and each
    node's smaller ones likewise with itself. So chains halve, and rounds grow with the logarithm of the longest. Each round
    is a table of the shared folder, no more rows than links.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while before != (mark := edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()):
        before = mark
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        up = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        down = up.join(up.groupBy("a").agg(F.min("b").alias("least")), "a")
        fresh = down.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").unionByName(down.select("a", F.col("least").alias("b")))
        edges = written(fresh.distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
