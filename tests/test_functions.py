import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.functions import sequences as s
from helixframe.functions.pvalues import chi2_p, erfc, exact_u_p, fisher_two_sided, u_counts
from helixframe.operators.ranks import u_test


@given(st.integers(1, 4), st.integers(1, 5))
@settings(max_examples=15, deadline=None)
def test_u_counts_enumerate_all_orders(m, n):
    seen = [0] * (m * n + 1)
    for ranks in itertools.combinations(range(m + n), m):
        seen[sum(r - i for i, r in enumerate(ranks))] += 1
    assert tuple(seen) == u_counts(m, n)


def test_exact_p_is_symmetric_and_at_most_one():
    for u in range(13):
        assert exact_u_p(u, 3, 4) == exact_u_p(12 - u, 3, 4) <= 1
    assert exact_u_p(12, 3, 4) == pytest.approx(2 / math.comb(7, 3))


def test_fisher_against_enumeration():
    assert fisher_two_sided(8, 2, 1, 5) == pytest.approx(0.034965034965, abs=1e-9)
    assert fisher_two_sided(3, 3, 3, 3) == pytest.approx(1.0)
    assert fisher_two_sided(0, 5, 0, 7) == pytest.approx(1.0)


def test_regions_and_genotypes(spark):
    df = spark.createDataFrame([("chr1:10-20:+", "0|1"), ("bad", "1/1"), ("chrX:5-6:-", "2|0:35"), (None, ".|."), ("c:1-2:?", "1")], "r string, g string")
    got = [tuple(x) for x in df.select(s.parse_region(F.col("r"))["start"], s.parse_region(F.col("r"))["direction"], s.parse_genotype(F.col("g"))["a1"], s.parse_genotype(F.col("g"))["a2"]).collect()]
    assert got == [(10, "forward", 0, 1), (None, None, None, None), (5, "reverse", 2, 0), (None, None, None, None), (1, "reverse", None, None)]


def test_edits_fold_from_the_last_position(spark):
    # 10 bases after position 100; a deletion that overlaps an insertion inside of what it deletes.
    edits = "array(named_struct('pos', 103L, 'line', 1L, 'ref_len', 4, 'alt', 'T'), named_struct('pos', 105L, 'line', 2L, 'ref_len', 1, 'alt', 'GGG'))"
    x = spark.sql(f"SELECT 'ACGTACGTAC' AS seq, 100L AS a, 110L AS b, {edits} AS e, CAST(NULL AS array<struct<pos:bigint,line:bigint,ref_len:int,alt:string>>) AS none")
    r = x.select(s.apply_edits(F.col("seq"), F.col("a"), F.col("b"), F.col("e")).alias("r"), s.apply_edits(F.col("seq"), F.col("a"), F.col("b"), F.col("none")).alias("n")).first()
    # After the insertion ACGTGGGCGTAC; then 4 bases from the third on become T.
    assert r["r"]["seq"] == "ACTGCGTAC"
    assert r["r"]["positions"] == [101, 102, 103, 105, 106, 107, 108, 109, 110]
    assert r["n"]["seq"] == "ACGTACGTAC" and r["n"]["positions"] == list(range(101, 111))


def test_small_column_functions(spark):
    x = spark.createDataFrame([("acgn", "chr1_reverse_A_forward_B", "pos_7"), ("", "chr_forward_G", "x"), ("ttR", "plain", "12")], "q string, g string, p string")
    got = [tuple(r) for r in x.select(s.reverse_complement(F.col("q")), s.short_gene_name(F.col("g")), s.normalize_position(F.col("p"))).collect()]
    assert got == [("NCGT", "A_forward_B", 7), ("", "G", None), ("NAA", "plain", 12)]


def test_erfc_column_has_fifteen_digits(spark):
    x = [0.0, 1e-9, 0.1, 0.46875, 0.4688, 1.0, 2.5, 3.999, 4.0, 4.001, 6.0, 10.0, 20.0, 26.0] + [i / 37 for i in range(900)]
    got = spark.createDataFrame([(v,) for v in [*x, None, 30.0]], "x double").select("x", erfc(F.col("x")).alias("p"), chi2_p(2 * F.col("x") * F.col("x")).alias("c")).collect()
    for r in got:
        want = None if r["x"] is None else math.erfc(r["x"])
        assert r["p"] == (want if want is None else pytest.approx(want, rel=2e-14, abs=1e-300)), r
        assert r["c"] == (want if want is None else pytest.approx(want, rel=1e-12, abs=1e-300)), r


def test_u_p_of_ties_and_empty_groups(spark):
    rows = [(3.0, 2, 3, 0.0), (4.5, 3, 3, 210.0), (0.0, 0, 5, 0.0), (50.0, 10, 10, 0.0), (0.0, 10, 10, 0.0), (50.0, 10, 10, 7980.0), (0.0, 9, 40, 6.0)]
    stats = spark.createDataFrame(rows, "u_a double, n_a long, n_b long, ties double")
    got = {tuple(r)[:4]: r["pvalue"] for r in u_test(stats, 1).collect()}
    for u, a, b, t in rows:
        if min(a, b) == 0:
            want = None
        elif min(a, b) <= 8 and t == 0:
            want = exact_u_p(u, a, b)
        else:
            n = a + b
            s = math.sqrt(max(0.0, a * b / 12 * ((n + 1) - t / (n * (n - 1)))))
            want = min(1.0, math.erfc((max(u, a * b - u) - a * b / 2 - 0.5) / s / math.sqrt(2))) if s > 0 else 1.0
        assert got[u, a, b, t] == (want if want is None else pytest.approx(want, rel=1e-12))
    plan = u_test(stats, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and u_test(stats, 10).where("pvalue IS NOT NULL").count() == 3
