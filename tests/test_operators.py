import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import attention, base, clusters, evaluate, metrics, ranks, regions

from .plain import density_labels


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_peaks(spark):
    values = [1, 3, 3, 1, 5, 2, None, 4, 1]
    a = table(spark, [("g", "hap1", 1, i, None if v is None else float(v)) for i, v in enumerate(values)], "gene string, hap string, sample long, position long, score double")
    roster = table(spark, [("g", "hap1", 1), ("g", "hap1", 2)], "gene string, hap string, sample long")
    m = {r["sample"]: r for r in metrics.seventeen_metrics(a, roster).collect()}
    # The plateau counts once; 4 has the null's neighbour 2 before it; ends are no peaks.
    assert (m[1]["peak_count"], m[1]["peak_density"], m[1]["peak_mean"], m[1]["mode"]) == (3, 3 / 8, 4.0, 1.0)
    x = np.array([1, 3, 3, 1, 5, 2, 4, 1.0])
    assert m[1]["iqr"] == pytest.approx(np.percentile(x, 75) - np.percentile(x, 25))
    assert m[1]["skewness"] == pytest.approx(((x - x.mean()) ** 3).mean() / x.std() ** 3)
    assert m[1]["shannon_entropy"] == pytest.approx(-sum(p * math.log(p) for p in x / x.sum()))
    assert (m[2]["peak_count"], m[2]["shannon_entropy"], m[2]["mean"]) == (0, 0, None)


def test_u_test_with_ties_and_constants(spark):
    rows = [("t", v, True) for v in [1.0, 1.0, 2.0] * 5] + [("t", v, False) for v in [1.0, 2.0, 2.0] * 5] + [("c", 7.0, i % 2 == 0) for i in range(12)] + [("e", 1.0, True)]
    got = {r["k"]: r for r in ranks.mann_whitney(table(spark, rows, "k string, v double, a boolean"), ["k"], "v", F.col("a")).collect()}
    assert got["c"]["pvalue"] == 1.0 and got["e"]["pvalue"] is None
    ties = 15**3 - 15
    s = math.sqrt(15 * 15 / 12 * (31 - 2 * ties / (30 * 29)))
    u = got["t"]["u_a"]
    assert u == 10 * 2.5 + 5 * 10
    assert got["t"]["pvalue"] == pytest.approx(math.erfc((max(u, 225 - u) - 112.5 - 0.5) / s / math.sqrt(2)))


def test_bh_keeps_nulls(spark):
    got = {r["i"]: r["q"] for r in ranks.bh_adjust(table(spark, list(enumerate([0.01, 0.04, 0.03, None, 0.5])), "i int, p double"), [], "p", "q").collect()}
    assert got[3] is None
    assert [got[i] for i in (0, 1, 2, 4)] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_equal_scores_have_equal_metrics(spark):
    values = np.random.default_rng(1).random(9).tolist()
    a = table(spark, [("g", "hap1", i, j, v) for i in range(700) for j, v in enumerate(values)], "gene string, hap string, sample long, position long, score double")
    assert metrics.seventeen_metrics(a).select(*metrics.METRICS).distinct().count() == 1


def test_a_p_of_zero_is_infinitely_strong(spark):
    tests = table(spark, [("std", "g1", 0.01), ("std", "g0", 0.0), ("std", "g2", None), ("cv", "g0", 1.0)], "metric string, gene string, p_corrected double")
    assert sorted(map(tuple, metrics.significant_genes(tests).collect())) == [("std", "g0", 0.0, math.inf, 1), ("std", "g1", 0.01, 2.0, 2)]


def test_auc_and_effects_have_opposite_signs(spark):
    a = table(spark, [("g", "hap1", i, 5, float(i + 1 if i < 10 else i - 8)) for i in range(20)], "gene string, hap string, sample long, position long, score double")
    samples = table(spark, [(i, 1 if i < 10 else 2) for i in range(20)], "sample long, label int")
    r = base.separability(a, samples, base.pair_table(spark, [(1, 2)])).first()
    assert r["cliffs_delta"] < 0 < r["cohen_d"] and r["wasserstein"] == pytest.approx(1.0)
    few = base.separability(a, samples, base.pair_table(spark, [(1, 2)]), 11).first()
    assert few["n_A"] == 10 and few["auc"] is None


def test_deletions_count_samples_without_scores(spark):
    a = table(spark, [("g", h, i, 5, 1.0) for h in ("hap1",) for i in range(12)], "gene string, hap string, sample long, position long, score double")
    roster = table(spark, [("g", "hap1", i) for i in range(24)], "gene string, hap string, sample long")
    samples = table(spark, [(i, 1 if i < 12 else 2) for i in range(24)], "sample long, label int")
    r = base.deletion_enrichment(a, samples, base.pair_table(spark, [(1, 2)]), roster).collect()
    assert len(r) == 1 and r[0]["pvalue"] == pytest.approx(2 / math.comb(24, 12))
    assert base.deletion_enrichment(a, samples, base.pair_table(spark, [(1, 3)]), roster).count() == 0


def test_parsers():
    assert base.parse_pairs("1-2, 1vs3") == [(1, 2), (1, 3)] and len(base.parse_pairs(None)) == 3
    assert base.parse_ignored("5:8,11") == [(5, 8), (11, 12)] and base.parse_ignored("5:x") == []


def test_dbscan_along_a_line(spark):
    at = [1, 5, 9, 13, 17, 37, 100, 200, 210, 220, 230, 240]
    df = table(spark, [("g", "hap1", 1, 2, p) for p in at], "gene string, hap string, groupA int, groupB int, position long")
    got = {r["position"]: r["cluster"] for r in clusters.dbscan_1d(df).collect()}
    # 37 is exactly 20 from 17, a core site; 240 is a border site of the second cluster.
    want = density_labels(np.array([[p] for p in at], float), 20, 5)
    assert [got[p] for p in at] == list(want) == [0] * 6 + [-1] + [1] * 5


def test_cluster_scores_of_one_point_and_padj_zero(spark):
    df = table(spark, [("g", "hap1", 1, 2, 10, 1.0, 0.0, 0)], "gene string, hap string, groupA int, groupB int, position long, log2FC double, padj double, cluster int")
    r = clusters.cluster_scores(df).first()
    assert r["mean_spacing"] == 1.0 and r["mean_p_strength_top10"] == math.inf and r["direction"] == "up"


def test_chunks_are_moved_back_at_the_end(spark):
    df = table(spark, [(1, "A" * 21), (2, ""), (3, "ACG")], "sample long, seq string")
    got = [tuple(r) for r in attention.chunk_spans(df, 8, 4).where("sample = 1").orderBy("chunk").select("chunk_start", "valid_start", "valid_end").collect()]
    assert got == [(0, 0, 6), (4, 6, 10), (8, 10, 14), (12, 14, 18), (13, 15, 21)]
    assert attention.chunk_spans(df, 8, 4).where("sample = 3").count() == 1
    with pytest.raises(ValueError):
        attention.chunk_spans(df, 4, 4)


@pytest.mark.parametrize("tile", [5, 16, 4096])
def test_attention_tiles_give_the_sums_of_the_whole_matrix(spark, tile):
    r = np.random.default_rng(0)
    rows, want = [], {}
    for sample, n in ((1, 37), (2, 1), (3, 16)):
        whole = np.zeros(n)
        for head in range(2):
            q, k = r.normal(size=(2, n, 4)) * 5
            s = np.where(np.tri(n, dtype=bool), q @ k.T / 2, -np.inf)
            e = np.exp(s - s.max(1, keepdims=True))
            whole += (e / (e.sum(1, keepdims=True) + 1e-12)).sum(0) / 2
            rows += [(sample, "hap1", head, t, q[t].tolist(), k[t].tolist()) for t in range(n)]
        want |= {(sample, t): x for t, x in enumerate(whole)}
    df = table(spark, rows, "sample long, hap string, head int, token int, q array<double>, k array<double>").repartition(4)
    got = {(x["sample"], x["col"]): x["score"] for x in attention.attention_column_sums_qk(df, tile=tile).collect()}
    assert got == pytest.approx(want)
    blocks = attention._tiles(df, ["sample", "hap"], tile)
    cut = -(-37 // tile)
    assert blocks.where("sample = 1 AND head = 0").count() == cut * (cut + 1) // 2
    assert attention.attention_column_sums_qk(df.limit(0)).count() == 0


def test_variants_at_region_ends(spark):
    v = table(spark, [("c", p) for p in (10, 11, 20, 21)], "chrom string, pos long")
    r = table(spark, [("r1", "c", 10, 20), ("r2", "c", 19, 30), ("r3", "c", 5, 5)], "region string, chrom string, start long, end long")
    assert sorted((x["region"], x["pos"]) for x in regions.variants_in_regions(v, r, 7).collect()) == [("r1", 11), ("r1", 20), ("r2", 20), ("r2", 21)]


def test_windows_of_a_megabase_list_no_positions(spark):
    r = np.random.default_rng(4)
    known = [("g", int(p)) for p in r.integers(0, 5_000_000, 30)] + [("h", 7)]
    at = [("g", int(p)) for p in r.integers(0, 5_000_000, 200)] + [("h", 7), ("h", 8), ("i", 1), ("g", known[0][1])]
    wide = [(0, 0), (0, 3), (5, 0), (1_000, 1_000_000), (250_000, 10)]
    positions, truth = table(spark, [(g, p, "x") for g, p in at], "gene string, position long, more string"), table(spark, known, "gene string, pos long")
    scored = evaluate.truth_windows(positions, truth, table(spark, wide, "left_bp int, right_bp int"))
    got = sorted((x["gene"], x["position"], x["left_bp"], x["right_bp"], x["is_true"]) for x in scored.collect())
    assert got == sorted((g, p, a, b, any(k == g and t - a <= p <= t + b for k, t in known)) for g, p in at for a, b in wide)
    assert 20 < sum(x[-1] for x in got) < len(got)
    with pytest.raises(ValueError):
        evaluate.truth_windows(positions, truth, table(spark, [(-1, 3)], "left_bp int, right_bp int"))


def test_evaluation_of_perfect_scores(spark):
    trace = table(spark, [("g", "hap1", 1, 2, p, 2.0 if 10 <= p <= 13 else 0.5) for p in range(30)], "gene string, hap string, groupA int, groupB int, position long, log2FC double")
    truth = table(spark, [("g", 10, "v")], "gene string, pos long, ID string")
    r = evaluate.evaluation_sweep(trace, truth, evaluate.windows_table(spark, [3])).first()
    assert (r["AUC"], r["AUPRC"], r["Precision_at_K"], r["SNR"], r["Positive_Base_Count"]) == (1.0, 1.0, 1.0, 4.0, 4)


def test_empty_tables(spark):
    a = table(spark, [], "gene string, hap string, sample long, position long, score double")
    s = table(spark, [], "sample long, label int")
    p = base.pair_table(spark, [(1, 2)])
    assert metrics.seventeen_metrics(a).count() == base.differential(a, s, p).count() == base.separability(a, s, p).count() == 0
