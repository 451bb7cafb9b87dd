"""Exact quantiles by key against numpy, in few and in many rounds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import clusters
from helixframe.operators.quantiles import quantile_by_key


@pytest.fixture(scope="module")
def values():
    r = random.Random(2)
    out = {("a", 1): [r.random() for _ in range(3000)], ("a", 2): [7.5] * 500 + [r.gauss(0, 1) for _ in range(700)], ("b", 1): [10.0 ** r.randint(-300, 300) for _ in range(900)] + [0.0] * 40 + [math.inf] * 30, ("b", 2): [3.0], ("c", 1): [1.0] * 2000, ("d", 1): [-(10.0 ** r.uniform(-5, 5)) for _ in range(1000)] + [2.0, 1e-320], ("e", 1): [1.0 + i * 2**-52 for i in range(300)] * 3}
    return out


@pytest.mark.parametrize("held", [1, 20, 5000])
@pytest.mark.parametrize("quantile", [0.0, 0.37, 0.5, 0.999, 1.0])
def test_against_numpy(spark, values, held, quantile):
    rows = [(*k, v) for k, x in values.items() for v in x] + [("a", 1, None), ("z", 1, None)]
    df = spark.createDataFrame(rows, "gene string, pair int, v double").repartition(3)
    at = spark.createDataFrame([(g, quantile) for g in "abcdez"], "gene string, quantile double")
    got = {(r["gene"], r["pair"]): r["level"] for r in quantile_by_key(df, ["gene", "pair"], F.col("v"), at, held).collect()}
    assert set(got) == set(values)
    for k, x in values.items():
        x = np.sort(x)
        place = quantile * (len(x) - 1)
        low = math.floor(place)
        high = min(low + 1, len(x) - 1)
        want = x[low] + (place - low) * (x[high] - x[low]) if x[high] != x[low] and place > low else x[low]
        assert got[k] == pytest.approx(want, rel=1e-12, abs=0) or (math.isnan(want) and math.isnan(got[k])), (k, held, quantile)


def test_quantiles_out_of_range_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "gene string, v double")
    at = spark.createDataFrame([("a", -0.1), ("b", None)], "gene string, quantile double")
    assert quantile_by_key(df, ["gene"], F.col("v"), at).count() == quantile_by_key(df.limit(0), ["gene"], F.col("v"), at).count() == 0


def test_significant_sites_with_a_fixed_quantile(spark):
    rows = [("g", "hap1", 1, 2, p, float(p), 0.01, 1.0) for p in range(11)]
    e = spark.createDataFrame(rows, "gene string, hap string, groupA int, groupB int, position long, log2FC double, padj double, cohen_d double")
    assert sorted(r.position for r in clusters.significant_sites(e, quantile=0.75).collect()) == [8, 9, 10]
