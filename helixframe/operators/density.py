"""Density clusters of points in three dimensions, by joins of neighbouring cells.

With cells whose diagonal is eps, all points of a cell are neighbours of each other: a cell of min_points points is all core, and
core points of one cell are one cluster. So only points of sparser cells are counted against their neighbourhood, and clusters
are the components of cells with core points, linked where two of their core points are within eps. Nothing gathers a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.graphs import component_of
from helixframe.operators.quantiles import quantile_by_key
from helixframe.sources.scratch import written

AXES, CELL = ("x", "y", "z"), ("cx", "cy", "cz")


def _around(reach: int, half: bool = False) -> Column:
    """Offsets of cells up to reach away; with half, one of each two that are opposite, and not the cell itself."""
    cells = [c for c in product(range(-reach, reach + 1), repeat=3) if not half or c > (0, 0, 0)]
    return F.array(*(F.struct(*(F.lit(v).cast("long").alias(n) for n, v in zip(CELL, c, strict=True))) for c in cells))


def _met(a: DataFrame, b: DataFrame, keys: Sequence[str], reach: int, half: bool = False) -> DataFrame:
    """Rows of a, and those of b (its columns but keys named with _) that are in cells up to reach away."""
    spread = a.withColumn("_o", F.explode(_around(reach, half))).withColumns({f"_{c}": F.col(c) + F.col(f"_o.{c}") for c in CELL}).drop("_o")
    return spread.join(b.withColumnsRenamed({c: f"_{c}" for c in b.columns if c not in keys}), [*keys, *(f"_{c}" for c in CELL)])


def _d2() -> Column:
    return sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in AXES), F.lit(0.0))


def kth_distances(points: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """(keys, position, d) of points (keys, position, x, y, z): the distance to the k-th nearest point of the key, itself counted as the first, or to the farthest if there are fewer.

    Cells grow until the k nearest are within one cell's side: a round counts points that are not done against the 27 cells
    around, with cells four times as wide as in the round before. The first cells are as wide as k points would be if spread
    along the widest axis, so dense places are done with small cells.
    """
    keys = list(keys)
    shape = points.groupBy(*keys).agg(F.count("*").alias("n"), F.greatest(*(F.max(c) - F.min(c) for c in AXES)).alias("span"))
    sized = shape.select(*keys, F.least("n", F.lit(k)).alias("k"), "span", (F.greatest("span", F.lit(1e-12)) * k / F.col("n") / 4).alias("side"))
    all_ = written(points.select(*keys, "position", *AXES).join(sized, keys), "points")
    left, done, grown = all_.select(*keys, "position"), None, 1.0
    while left.limit(1).count():
        side = F.col("side") * grown
        celled = all_.withColumns({c: F.floor(F.col(a) / side) for c, a in zip(CELL, AXES, strict=True)})
        mine = celled.join(left, [*keys, "position"], "left_semi")
        near = _met(mine, celled.select(*keys, "position", *AXES, *CELL), keys, 1).withColumn("d2", _d2())
        # All points within one side are in these cells; a cell wider than everything holds all points.
        near = near.where((F.col("d2") <= side * side) | (side > 2 * F.col("span")))
        place = F.row_number().over(Window.partitionBy(*keys, "position").orderBy("d2"))
        found = near.withColumn("place", place).where(F.col("place") == F.col("k")).select(*keys, "position", F.sqrt("d2").alias("d"))
        found = written(found, "kth-distances")
        done = found if done is None else done.unionByName(found)
        left = written(left.join(found, [*keys, "position"], "left_anti"), "points-left")
        grown *= 4
    return done if done is not None else all_.select(*keys, "position", F.lit(0.0).alias("d"))


def density_clusters(points: DataFrame, keys: Sequence[str], eps: DataFrame, min_points: int) -> DataFrame:
    """(keys, position, cluster) of points (keys, position, x, y, z) for (keys, eps): clusters are numbered from 0 by their first core point along positions, other points within eps of a core go to the earliest, the rest is -1.

    A core point has min_points points within eps, itself included. Positions are distinct within a key. With an eps of 0,
    equal points are neighbours. Where two neighbouring
    cells both hold very many core points and are neither wholly within nor wholly beyond eps of each other, their points are
    compared one by one.
    """
    keys = list(keys)
    by = [*keys, *CELL]
    side = F.col("eps") / F.sqrt(F.lit(3.0)) * (1 - 1e-9)
    celled = {c: F.when(F.col("eps") > 0, F.floor(F.col(a) / side)).otherwise(F.xxhash64(*(F.col(x) + 0.0 for x in AXES)) if c == "cx" else 0).cast("long") for c, a in zip(CELL, AXES, strict=True)}
    p = points.select(*keys, "position", *AXES).join(eps, keys).withColumns(celled)
    p = written(p.join(p.groupBy(*by).agg(F.count("*").alias("held")), by), "cells")
    bare = p.select(*keys, "position", *AXES, *CELL)
    within = _d2() <= F.col("eps") * F.col("eps")
    sparse = p.where(F.col("held") < min_points)
    counted = _met(sparse, bare, keys, 2).where(within).groupBy(*keys, "position").agg(F.count("*").alias("n")).where(F.col("n") >= min_points)
    core = written(p.where(F.col("held") >= min_points).unionByName(sparse.join(counted, [*keys, "position"], "left_semi")).select(*keys, "position", *AXES, *CELL, "eps"), "core")
    boxes = core.groupBy(*by).agg(F.min("position").alias("first"), F.first("eps").alias("eps"), *(f(c).alias(f"{n}{c}") for c in AXES for f, n in ((F.min, "l"), (F.max, "h"))))
    boxes = written(boxes.withColumn("cell", F.monotonically_increasing_id()), "core-cells")
    pairs = _met(boxes, boxes.drop("eps", "first"), keys, 2, half=True)
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"l{c}") - F.col(f"_h{c}"), F.col(f"_l{c}") - F.col(f"h{c}")), 2) for c in AXES), F.lit(0.0))
    width = sum((F.pow(F.greatest(F.col(f"h{c}"), F.col(f"_h{c}")) - F.least(F.col(f"l{c}"), F.col(f"_l{c}")), 2) for c in AXES), F.lit(0.0))
    # A little room, as these are bounds of the sums that decide.
    pairs = written(pairs.withColumns({"gap": gap, "width": width}).where(F.col("gap") <= F.col("eps") * F.col("eps") * (1 + 1e-9)).select(*keys, "cell", F.col("_cell").alias("other"), "eps", "width"), "cell-pairs")
    sure = F.col("width") <= F.col("eps") * F.col("eps") * (1 - 1e-9)
    named = core.join(boxes.select(*by, "cell"), by).select(*keys, "cell", "position", *AXES)
    one = pairs.where(~sure).select("cell", "other", "eps").join(named.drop("position", *keys), "cell")
    two = one.join(named.select(F.col("cell").alias("other"), *(F.col(c).alias(f"_{c}") for c in AXES)), "other")
    links = pairs.where(sure).select("cell", "other").unionByName(two.where(within).select("cell", "other").distinct())
    parts = component_of(links.select(F.col("cell").alias("a"), F.col("other").alias("b")))
    of = boxes.select(*keys, "cell", "first").join(parts.withColumnRenamed("node", "cell"), "cell", "left").withColumn("component", F.coalesce("component", "cell"))
    order = of.groupBy(*keys, "component").agg(F.min("first").alias("first"))
    order = order.withColumn("cluster", F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1)
    cells = of.join(order.select("component", "cluster"), "component").select("cell", "cluster")
    labelled = written(named.join(cells, "cell").select(*keys, "position", "cluster"), "core-labels")
    others = sparse.join(core.select(*keys, "position"), [*keys, "position"], "left_anti")
    border = _met(others, core.drop("eps"), keys, 2).where(within).select(*keys, "position", "_position").join(labelled.withColumnRenamed("position", "_position"), [*keys, "_position"])
    border = border.groupBy(*keys, "position").agg(F.min("cluster").alias("cluster"))
    return points.select(*keys, "position").join(labelled.unionByName(border), [*keys, "position"], "left").select(*keys, "position", F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


def kth_eps(points: DataFrame, keys: Sequence[str], k: int, percentile: float) -> DataFrame:
    """(keys, eps): percentile of kth_distances() by key, with linear interpolation."""
    d = written(kth_distances(points, keys, k), "kth-distances")
    at = d.select(*keys).distinct().withColumn("quantile", F.lit(percentile / 100))
    return quantile_by_key(d, keys, F.col("d"), at).withColumnRenamed("level", "eps")
