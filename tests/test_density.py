"""Density clusters in three dimensions against a plain version: several keys, dense cells, ties, fixed and measured eps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import density
from helixframe.operators.graphs import component_of

from .plain import density_labels

SCHEMA = "gene string, position long, x double, y double, z double"


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(3)
    a = np.concatenate([r.normal(c, 0.15, (60, 3)) for c in ((0, 0, 0), (1, 0, 0), (1, 1, 1))] + [r.uniform(-2, 3, (60, 3))])
    line = np.stack([np.arange(120) * 0.1, np.zeros(120), np.zeros(120)], 1)
    line = np.concatenate([line[:50], line[55:]])
    heap = np.concatenate([np.stack([np.arange(80) * 1e-3, np.zeros(80), np.zeros(80)], 1), [[5.0, 5, 5], [9, 9, 9]]])
    return {"a": a[r.permutation(len(a))], "line": line, "heap": heap, "few": np.array([[0.0, 0, 0], [1, 1, 1]]), "one": np.array([[1.0, 2, 3]]), "same": np.zeros((9, 3))}


@pytest.fixture(scope="module")
def frame(spark, points):
    return spark.createDataFrame([(k, 10 * i + 3, *map(float, row)) for k, x in points.items() for i, row in enumerate(x)], SCHEMA).repartition(3)


def labels(df):
    out = {}
    for r in df.orderBy("gene", "position").collect():
        out.setdefault(r["gene"], []).append(r["cluster"])
    return out


@pytest.mark.parametrize("eps, min_points", [(0.25, 5), (0.1, 2), (1.5, 4), (0.3, 1), (0.0, 5)])
def test_fixed_eps(spark, points, frame, eps, min_points):
    got = labels(density.density_clusters(frame, ["gene"], frame.select("gene").distinct().withColumn("eps", F.lit(eps)), min_points))
    assert got == {k: density_labels(x, eps, min_points).tolist() for k, x in points.items()}


def test_kth_distances_and_eps(spark, points, frame):
    got = {(r.gene, r.position): r.d for r in density.kth_distances(frame, ["gene"], 5).collect()}
    want = {}
    for k, x in points.items():
        d = [np.sort(np.sqrt(((x - row) ** 2).sum(1)))[min(5, len(x)) - 1] for row in x]
        want |= {(k, 10 * i + 3): v for i, v in enumerate(d)}
    assert got == pytest.approx(want)
    eps = {r.gene: r.eps for r in density.kth_eps(frame, ["gene"], 5, 90.0).collect()}
    assert eps == pytest.approx({k: np.percentile([want[k, 10 * i + 3] for i in range(len(x))], 90) for k, x in points.items()})


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 450), (7, 7)]
    got = dict(map(tuple, component_of(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(201)} | {i: 400 for i in (400, 450, 500)}


def test_empty(spark, frame):
    none = frame.limit(0)
    assert density.kth_eps(none, ["gene"], 5, 90.0).count() == 0
    assert density.density_clusters(none, ["gene"], none.select("gene").withColumn("eps", F.lit(1.0)), 5).count() == 0
