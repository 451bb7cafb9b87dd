"""Driver queries: each operator applied to the tables of adapters.py, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.sequences import reverse_complement, short_gene_name
from helixframe.operators import attention, base, clusters, evaluate, metrics, ranks
from helixframe.operators import regions as reg
from helixframe.plans import adapters as ad
from helixframe.plans import oracle as sql
from helixframe.sources.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, as the order of sums differs between engines; minus zero as zero."""
    return df.select(*((F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema))


def query(parts: list[str] | None = None, columns: dict[str, str] | str = "", source: str = "", digits: int = 9):
    """Register a query and its SQL: common table expressions, then columns (those named in doubles are rounded) of source."""

    def register(f):
        QUERIES[f.__name__] = f
        if parts is not None:
            ORACLES[f.__name__] = ("WITH " + ", ".join(parts) + " " if parts else "") + f"SELECT {columns} FROM {source}"
        return f

    return register


def r(names: str, digits: int = 9) -> str:
    """Rounded columns in SQL."""
    return ", ".join(f'round("{n}", {digits}) + 0.0 AS "{n}"' for n in names.split())


def q(names: str) -> str:
    return ", ".join(f'"{n}"' for n in names.split())


# Gene level


def _gene_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.with_group(metrics.seventeen_metrics(ad.gene_attention(spark, sf_dir)), ad.supplier_samples(spark, sf_dir))
    return metrics.gene_tests(m)


@query([sql.EMBEDDING, sql.METRIC_PARTS, sql.ROSTER_METRICS], "gene, hap, sample, " + r(" ".join(metrics.METRICS)), "met")
def q_seventeen_metrics(spark, sf_dir):
    return rounded(metrics.seventeen_metrics(ad.embedding_attention(spark, sf_dir), ad.embedding_roster(spark, sf_dir)))


@query([sql.GENES, sql.METRIC_PARTS], "gene, sample, " + r("mean max std cv median mode iqr peak_count peak_density peak_mean top5_percent_mean low5_percent_mean shannon_entropy"), "met0")
def q_gene_metrics(spark, sf_dir):
    m = metrics.seventeen_metrics(ad.gene_attention(spark, sf_dir))
    return rounded(m.select("gene", "sample", "mean", "max", "std", "cv", "median", "mode", "iqr", "peak_count", "peak_density", "peak_mean", "top5_percent_mean", "low5_percent_mean", "shannon_entropy"))


@query([sql.GENES, sql.GENE_TESTS], "gene, metric, " + r("p p_corrected", 8) + ", significant", "tst")
def q_gene_utest(spark, sf_dir):
    return rounded(_gene_tests(spark, sf_dir).select("gene", "metric", "p", "p_corrected", "significant"), 8)


@query(
    [sql.GENES, sql.GENE_TESTS],
    "gene, " + ", ".join(f"round(max(p) FILTER (metric = '{m}'), 8) + 0.0 AS {m}_p, round(max(p_corrected) FILTER (metric = '{m}'), 8) + 0.0 AS {m}_p_corrected, bool_or(significant) FILTER (metric = '{m}') AS {m}_significant" for m in metrics.METRICS),
    "tst GROUP BY gene",
)
def q_gene_pvalues_bh(spark, sf_dir):
    return rounded(metrics.pvalue_table(_gene_tests(spark, sf_dir)), 8)


@query([sql.GENES, sql.GENE_TESTS], "metric, count(*) FILTER (p < 0.05) AS raw, count(*) FILTER (significant) AS corrected, count(*) FILTER (p_corrected < 0.05) AS below", "tst GROUP BY metric")
def q_significant_counts(spark, sf_dir):
    return metrics.significant_counts(_gene_tests(spark, sf_dir))


@query([sql.GENES, sql.GENE_TESTS], "CASE WHEN contains(gene, 'forward_') THEN split_part(gene, 'forward_', 2) ELSE gene END AS gene, " + r("p p_corrected", 8), "(SELECT * FROM tst WHERE metric = 'std' AND p IS NOT NULL ORDER BY p, gene LIMIT 10)")
def q_top_genes(spark, sf_dir):
    return rounded(metrics.top_genes(_gene_tests(spark, sf_dir)).select(short_gene_name(F.col("gene")).alias("gene"), "p", "p_corrected"), 8)


@query([sql.GENES, sql.GENE_TESTS], "metric, gene, round(p_corrected, 8) + 0.0 AS p_corrected, round(-log10(p_corrected), 6) + 0.0 AS strength, row_number() OVER (PARTITION BY metric ORDER BY p_corrected, gene) AS place", "tst WHERE p_corrected < 0.5")
def q_significant_genes(spark, sf_dir):
    return metrics.significant_genes(_gene_tests(spark, sf_dir), 0.5).withColumns({"p_corrected": F.round("p_corrected", 8) + F.lit(0.0), "strength": F.round("strength", 6) + F.lit(0.0)})


@query(
    [sql.GENES, sql.GENE_TESTS],
    """metric, grp AS "group", count(value) AS n, round(min(value), 9) + 0.0 AS low, round(quantile_cont(value, 0.25), 9) + 0.0 AS q1, round(quantile_cont(value, 0.5), 9) + 0.0 AS mid, round(quantile_cont(value, 0.75), 9) + 0.0 AS q3, round(max(value), 9) + 0.0 AS high,
    round(any_value(p), 8) + 0.0 AS p, CASE WHEN any_value(p) < 0.001 THEN '***' WHEN any_value(p) < 0.01 THEN '**' WHEN any_value(p) < 0.05 THEN '*' ELSE 'ns' END AS stars""",
    "lng JOIN tst USING (gene, metric) WHERE gene = 'chr_forward_g1' GROUP BY metric, grp",
)
def q_gene_metric_table(spark, sf_dir):
    m = metrics.with_group(metrics.seventeen_metrics(ad.gene_attention(spark, sf_dir)), ad.supplier_samples(spark, sf_dir))
    return rounded(metrics.group_metric_table(m, metrics.gene_tests(m), "chr_forward_g1")).withColumn("p", F.round("p", 8) + F.lit(0.0))


EXACT = """
ru AS (SELECT gene, position, score AS value, sample_type = 2 AS is_a FROM att JOIN smp USING (sample) WHERE sample_type IN (0, 2)),"""
ORDERS = """
RECURSIVE ways AS (SELECT 0 AS n, 0 AS m, 0 AS s, 1::HUGEINT AS c UNION ALL
  SELECT n + 1, m, s, CAST(sum(c) AS HUGEINT) FROM (SELECT n, m, s, c FROM ways UNION ALL SELECT n, m + 1, s + n + 1, c FROM ways WHERE m < 8) WHERE n < 60 GROUP BY n, m, s),
us AS (SELECT n, m, s - m * (m + 1) // 2 AS u, CAST(c AS DOUBLE) AS c FROM ways)"""


@query(
    [ORDERS, sql.GENES, EXACT + sql.ladder("ru", "gene, position", "ex")],
    """gene, position, n_a, n_b, u_a, round(CASE WHEN n_a > 0 AND n_b > 0 AND ties = 0 AND least(n_a, n_b) <= 8 THEN least(1.0::DOUBLE, 2 * (SELECT sum(c) FILTER (u >= greatest(u_a, n_a * n_b - u_a)) / sum(c) FROM us WHERE us.n = n_a + n_b AND us.m = least(n_a, n_b))) ELSE pvalue END, 9) + 0.0 AS pvalue""",
    "ex",
)
def q_utest_exact_small(spark, sf_dir):
    """Positions of genes have few samples of a label, so that most tests are exact."""
    rows = ad.gene_attention(spark, sf_dir).join(ad.supplier_samples(spark, sf_dir), "sample").where("sample_type IN (0, 2)")
    tested = ranks.mann_whitney(rows, ["gene", "position"], "score", F.col("sample_type") == 2)
    return rounded(tested.select("gene", "position", F.col("n_a").cast("double").alias("n_a"), F.col("n_b").cast("double").alias("n_b"), F.col("u_a").cast("double").alias("u_a"), "pvalue"))


# Base level


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    samples = ad.supplier_samples(spark, sf_dir).select("sample", base.base_label(F.col("sample_type")).alias("label"))
    return base.known_positions(ad.site_attention(spark, sf_dir)), samples, base.pair_table(spark, ad.PAIRS)


def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once, as all that follows reads it several times."""
    return written(base.effects(*_base(spark, sf_dir)), "effects")


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.dbscan_1d(clusters.significant_sites(_effects(spark, sf_dir)))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.truth(ad.site_attention(spark, sf_dir))


KEY = 'gene, hap, "groupA", "groupB", position'


@query([sql.SITES, sql.BASE], "gene, hap, position, label, n, " + r("mean std baseMean"), "gs")
def q_group_stats(spark, sf_dir):
    a, s, _ = _base(spark, sf_dir)
    return rounded(base.group_stats(a, s))


@query([sql.SITES, sql.BASE], KEY + ", " + r("log2FC delta"), "fo")
def q_log2fc(spark, sf_dir):
    return rounded(base.log2_fold_change(base.pair_stats(*_base(spark, sf_dir))).select("gene", "hap", "groupA", "groupB", "position", "log2FC", "delta"))


@query([sql.SITES, sql.BASE], KEY + ', "n_A" AS "nA_nonNA", "n_B" AS "nB_nonNA", ' + r("baseMean mean_A mean_B log2FC delta pvalue padj"), "dfr")
def q_differential(spark, sf_dir):
    return rounded(base.differential(*_base(spark, sf_dir)))


@query([sql.SITES, sql.BASE], KEY + ', "n_A", "n_B", ' + r("mean_A mean_B std_A std_B auc cliffs_delta wasserstein cohen_d hedges_g"), "sep")
def q_separability(spark, sf_dir):
    return rounded(base.separability(*_base(spark, sf_dir)))


@query([sql.EMBEDDING, sql.DELETION], KEY + ', "nA", "nB", ' + r("OR_deleted pvalue padj"), "del")
def q_deletion_enrichment(spark, sf_dir):
    samples = ad.embedding_samples(spark, sf_dir).select("sample", base.base_label(F.col("sample_type")).alias("label"))
    return rounded(base.deletion_enrichment(ad.embedding_attention(spark, sf_dir), samples, base.pair_table(spark, ad.PAIRS), ad.embedding_roster(spark, sf_dir)))


@query([sql.SITES, sql.PAIRS, "lab AS (SELECT (sample_type + 1) % 4 AS label, count(*) AS n FROM smp GROUP BY ALL)"], "min(n) AS smallest, min(n) > 10 AS ok", "lab")
def q_class_balance(spark, sf_dir):
    return base.balanced(_base(spark, sf_dir)[1])


@query([sql.SITES, sql.BASE], KEY + ", " + r("log2FC padj cohen_d"), "tr")
def q_dense_trace(spark, sf_dir):
    return rounded(base.dense_trace(_effects(spark, sf_dir)))


@query([sql.SITES, sql.BASE], KEY + ", " + r("log2FC padj cohen_d"), "hi WHERE highlighted")
def q_highlight_sites(spark, sf_dir):
    return rounded(base.highlight_sites(base.dense_trace(_effects(spark, sf_dir)), cohen=0.5).where("highlighted").drop("highlighted", "level"))


@query([sql.SITES, sql.BASE], KEY + ", " + r("log2FC padj"), "dfr WHERE NOT ((position >= 10 AND position < 60) OR position = 101)")
def q_ignore_positions(spark, sf_dir):
    kept = base.exclude_positions(base.differential(*_base(spark, sf_dir)), "10:60,101")
    return rounded(kept.select("gene", "hap", "groupA", "groupB", "position", "log2FC", "padj"))


@query([sql.SITES, sql.BASE], KEY + ", " + r("log2FC padj cohen_d hedges_g"), "sig")
def q_significant_sites(spark, sf_dir):
    s = clusters.significant_sites(_effects(spark, sf_dir))
    return rounded(s.select("gene", "hap", "groupA", "groupB", "position", "log2FC", "padj", "cohen_d", "hedges_g"))


@query([sql.SITES, sql.BASE], KEY + ", cluster", "clu")
def q_clusters_1d(spark, sf_dir):
    return _clustered(spark, sf_dir).select("gene", "hap", "groupA", "groupB", "position", "cluster")


SCORES = 'gene, hap, "groupA", "groupB", CAST(cluster_id AS INT) AS cluster_id, n_points, center_position, start_position, end_position, direction, ' + r("mean_abs_log2FC_top10 mean_p_strength_top10 mean_spacing total_score", 7)


@query([sql.SITES, sql.BASE], SCORES, "sco")
def q_cluster_scores(spark, sf_dir):
    return rounded(clusters.cluster_scores(_clustered(spark, sf_dir)), 7)


@query([sql.SITES, sql.BASE], SCORES + ", place", "(SELECT *, row_number() OVER (PARTITION BY gene, hap, groupA, groupB ORDER BY total_score DESC, cluster_id) AS place FROM sco) WHERE place <= 5")
def q_top_clusters(spark, sf_dir):
    return rounded(clusters.top_clusters(clusters.cluster_scores(_clustered(spark, sf_dir))), 7)


@query(
    [sql.SITES, sql.BASE],
    """e.gene, e.hap, e."groupA", e."groupB", CASE WHEN d.n IS NULL OR s.n IS NULL THEN 'skipped_no_data' WHEN c.n IS NULL THEN 'skipped_no_clusters' ELSE 'success' END AS status, coalesce(s.n, 0) AS n_significant, coalesce(c.n, 0) AS n_clusters, round(c.top, 7) + 0.0 AS top_score""",
    """(SELECT DISTINCT gene, hap, p.a AS "groupA", p.b AS "groupB" FROM eff, (VALUES (1, 2), (1, 3), (2, 3)) p(a, b)) e
    LEFT JOIN (SELECT gene, hap, "groupA", "groupB", count(*) AS n FROM eff GROUP BY ALL) d USING (gene, hap, groupA, groupB)
    LEFT JOIN (SELECT gene, hap, "groupA", "groupB", count(*) AS n FROM sig GROUP BY ALL) s USING (gene, hap, groupA, groupB)
    LEFT JOIN (SELECT gene, hap, "groupA", "groupB", count(*) AS n, max(total_score) AS top FROM sco GROUP BY ALL) c USING (gene, hap, groupA, groupB)""",
)
def q_cluster_summary(spark, sf_dir):
    effects = _effects(spark, sf_dir)
    sites = clusters.significant_sites(effects)
    scores = clusters.cluster_scores(clusters.dbscan_1d(sites))
    return rounded(clusters.run_summary(effects, sites, scores, base.pair_table(spark, base.parse_pairs(None))), 7)


TRACE = """SELECT t.*, coalesce(cluster, -1) AS cluster FROM hi t LEFT JOIN clu USING (gene, hap, groupA, groupB, position)"""


@query(
    [sql.SITES, sql.BASE, f"tc AS ({TRACE})"],
    """coalesce(a.gene, b.gene) AS gene, coalesce(a."groupA", b."groupA") AS "groupA", coalesce(a."groupB", b."groupB") AS "groupB", coalesce(a.position, b.position) AS position, round(a."log2FC", 9) + 0.0 AS "hap1_log2FC", a.highlighted AS hap1_highlighted, a.cluster AS hap1_cluster, round(b."log2FC", 9) + 0.0 AS "hap2_log2FC", b.highlighted AS hap2_highlighted, b.cluster AS hap2_cluster""",
    """(SELECT * FROM tc WHERE hap = 'hap1') a FULL JOIN (SELECT * FROM tc WHERE hap = 'hap2') b ON a.gene = b.gene AND a."groupA" = b."groupA" AND a."groupB" = b."groupB" AND a.position = b.position""",
)
def q_haplotype_traces(spark, sf_dir):
    effects = _effects(spark, sf_dir)
    traces = base.highlight_sites(base.dense_trace(effects), cohen=0.5)
    return rounded(clusters.haplotype_traces(traces, clusters.dbscan_1d(clusters.significant_sites(effects))))


FEATURES = """
ft0 AS (SELECT gene, hap, "groupA", "groupB", position, CAST(position AS DOUBLE) AS a, -log10(padj + 1e-100::DOUBLE) AS b, abs("log2FC") AS c FROM sig),
ft AS (SELECT gene, hap, "groupA", "groupB", position,
  1.0::DOUBLE * (a - avg(a) OVER w) / CASE WHEN stddev_pop(a) OVER w > 0 THEN stddev_pop(a) OVER w ELSE 1.0::DOUBLE END AS x,
  0.5::DOUBLE * (b - avg(b) OVER w) / CASE WHEN stddev_pop(b) OVER w > 0 THEN stddev_pop(b) OVER w ELSE 1.0::DOUBLE END AS y,
  0.3::DOUBLE * (c - avg(c) OVER w) / CASE WHEN stddev_pop(c) OVER w > 0 THEN stddev_pop(c) OVER w ELSE 1.0::DOUBLE END AS z
  FROM ft0 WINDOW w AS (PARTITION BY gene, hap, "groupA", "groupB"))"""
K4 = 'gene, hap, "groupA", "groupB"'
DENSITY = f"""
dd AS MATERIALIZED (SELECT {K4}, s.position, t.position AS other, (s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2 AS d2 FROM ft s JOIN ft t USING ({K4})),
ke AS (SELECT {K4}, quantile_cont(d, 0.9) AS eps FROM (SELECT {K4}, position, list_sort(list(sqrt(d2)))[least(5, count(*))] AS d FROM dd GROUP BY ALL) GROUP BY ALL),
nb AS MATERIALIZED (SELECT {K4}, position, other FROM dd JOIN ke USING ({K4}) WHERE d2 <= eps * eps),
cr AS MATERIALIZED (SELECT {K4}, position FROM nb GROUP BY ALL HAVING count(*) >= 5),
cl AS MATERIALIZED (SELECT nb.* FROM nb JOIN cr USING ({K4}, position) JOIN (SELECT {K4}, position AS other FROM cr) USING ({K4}, other)),
rc AS (SELECT {K4}, position, position AS seed FROM cr UNION SELECT cl.gene, cl.hap, cl."groupA", cl."groupB", cl.other, rc.seed FROM rc JOIN cl ON cl.gene = rc.gene AND cl.hap = rc.hap AND cl."groupA" = rc."groupA" AND cl."groupB" = rc."groupB" AND cl.position = rc.position),
sd AS (SELECT {K4}, position, min(seed) AS seed FROM rc GROUP BY ALL),
nm AS (SELECT *, dense_rank() OVER (PARTITION BY {K4} ORDER BY seed) - 1 AS id FROM sd),
wc AS (SELECT ft.gene, ft.hap, ft."groupA", ft."groupB", ft.position, CAST(coalesce((SELECT id FROM nm WHERE nm.gene = ft.gene AND nm.hap = ft.hap AND nm."groupA" = ft."groupA" AND nm."groupB" = ft."groupB" AND nm.position = ft.position),
  (SELECT min(id) FROM nb JOIN nm ON nm.gene = nb.gene AND nm.hap = nb.hap AND nm."groupA" = nb."groupA" AND nm."groupB" = nb."groupB" AND nm.position = nb.other WHERE nb.gene = ft.gene AND nb.hap = ft.hap AND nb."groupA" = ft."groupA" AND nb."groupB" = ft."groupB" AND nb.position = ft.position), -1) AS INT) AS cluster FROM ft)"""


@query([sql.SITES, sql.BASE, FEATURES], KEY + ", " + r("x y z"), "ft")
def q_scaled_features(spark, sf_dir):
    return rounded(clusters.scaled_features(clusters.significant_sites(_effects(spark, sf_dir))).select("gene", "hap", "groupA", "groupB", "position", "x", "y", "z"))


@query(["RECURSIVE " + sql.SITES.lstrip(), sql.BASE, FEATURES, DENSITY], KEY + ", cluster", "wc")
def q_clusters_weighted(spark, sf_dir):
    return clusters.dbscan_weighted(clusters.significant_sites(_effects(spark, sf_dir)))


@query([sql.SITES, sql.BASE, """th AS (SELECT unnest([0.0, 0.5, 0.8]::DOUBLE[]) AS cohen), hl AS (SELECT tr.*, lv FROM tr JOIN (SELECT gene, hap, "groupA", "groupB", quantile_cont(abs("log2FC"), 0.95) AS lv FROM tr GROUP BY ALL) USING (gene, hap, groupA, groupB))"""], KEY + ', cohen, padj < 0.05 AND abs("log2FC") >= lv AND abs(cohen_d) > cohen AS highlighted', "hl, th")
def q_highlight_sweep(spark, sf_dir):
    swept = base.highlight_sweep(base.dense_trace(_effects(spark, sf_dir)), [0.0, 0.5, 0.8])
    return swept.select("gene", "hap", "groupA", "groupB", "position", "cohen", "highlighted")


@query(
    [sql.SITES, sql.BASE, 'kd AS (SELECT s.gene, s.hap, s."groupA", s."groupB", s.position, list_sort(list(abs(t.position - s.position)))[5] AS d FROM sig s JOIN sig t USING (gene, hap, groupA, groupB) GROUP BY ALL)'],
    'gene, hap, "groupA", "groupB", round(quantile_cont(d, 0.9), 9) + 0.0 AS eps',
    'kd GROUP BY gene, hap, "groupA", "groupB"',
)
def q_kth_eps(spark, sf_dir):
    return rounded(clusters.kth_neighbor_eps(clusters.significant_sites(_effects(spark, sf_dir))))


# Evaluation

WINDOW = 'gene, hap, "groupA", "groupB", left_bp, right_bp'


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = base.dense_trace(_effects(spark, sf_dir))
    return evaluate.signal_scores(trace, _truth(spark, sf_dir), evaluate.windows_table(spark))


@query([sql.SITES, sql.BASE], WINDOW + ", position, is_true, distance, round(signal, 9) + 0.0 AS signal", "sc0")
def q_truth_windows(spark, sf_dir):
    return rounded(_scored(spark, sf_dir).select("gene", "hap", "groupA", "groupB", "left_bp", "right_bp", "position", "is_true", "distance", "signal"))


@query([sql.SITES, sql.TRUTH], "gene, position, min(CAST(abs(position - pos) AS DOUBLE)) AS distance", "(SELECT DISTINCT gene, position FROM att) JOIN truth USING (gene) GROUP BY gene, position")
def q_nearest_truth(spark, sf_dir):
    a = ad.site_attention(spark, sf_dir)
    return evaluate.nearest_truth(a.select("gene", "position").distinct(), ad.truth(a))


@query([sql.SITES, sql.BASE], WINDOW + ", " + r("AUC AUPRC"), "ev")
def q_auc_ap(spark, sf_dir):
    return rounded(evaluate.auc_ap(_scored(spark, sf_dir), [*evaluate.KEYS, "left_bp", "right_bp"]))


EVAL = "Mean_Signal_True Mean_Signal_Background SNR FRiW Weighted_Dist Expected_FRiW FRiW_Enrichment Normalized_Weighted_Dist Cohens_d Precision_at_K Mean_Rank_True AUC AUPRC"


@query([sql.SITES, sql.BASE], WINDOW + ', "Positive_Base_Count", "Seq_Length", "N_Variants", ' + r(EVAL, 8), "ev")
def q_eval_sweep(spark, sf_dir):
    trace = base.dense_trace(_effects(spark, sf_dir))
    return rounded(evaluate.evaluation_sweep(trace, _truth(spark, sf_dir), evaluate.windows_table(spark)), 8)


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = evaluate.kept_clusters(clusters.cluster_scores(_clustered(spark, sf_dir)))
    return evaluate.match_clusters(scores, _truth(spark, sf_dir))


@query(
    [sql.SITES, sql.BASE],
    """gene, hap, "groupA", "groupB", CAST(cluster_id AS INT) AS cluster_id, n_points, round(n_points / greatest(end_position - start_position, 1), 9) + 0.0 AS density, match_start, match_end, truth_position, truth_id, CASE WHEN truth_id IS NULL THEN 'False Positive' ELSE 'True Positive' END AS match_status, truth_position - center_position AS dist_truth_to_cluster_center""",
    "mt",
)
def q_cluster_truth_match(spark, sf_dir):
    return rounded(_matches(spark, sf_dir).select("gene", "hap", "groupA", "groupB", "cluster_id", "n_points", "density", "match_start", "match_end", "truth_position", "truth_id", "match_status", "dist_truth_to_cluster_center"))


KEPT = """
dn AS (SELECT *, n_points / greatest(end_position - start_position, 1) AS density FROM sco), kl AS (SELECT gene, hap, "groupA", "groupB", quantile_cont(total_score, 0.4) AS lv FROM dn GROUP BY ALL),
kc AS (SELECT dn.* FROM dn JOIN kl USING (gene, hap, groupA, groupB) WHERE total_score >= lv AND n_points >= 6 AND density >= 0.1)"""


@query([sql.SITES, sql.BASE, KEPT], 'gene, hap, "groupA", "groupB", CAST(cluster_id AS INT) AS cluster_id, n_points, round(density, 9) + 0.0 AS density', "kc")
def q_kept_clusters(spark, sf_dir):
    kept = evaluate.kept_clusters(clusters.cluster_scores(_clustered(spark, sf_dir)), 6, 0.1, 0.6)
    return rounded(kept.select("gene", "hap", "groupA", "groupB", "cluster_id", "n_points", "density"))


@query([sql.SITES, sql.BASE], 'sco.gene, hap, "groupA", "groupB", CAST(cluster_id AS INT) AS cluster_id, start_position AS match_start, end_position + 10 AS match_end, t.pos AS truth_position, t.ID AS truth_id', "sco LEFT JOIN truth t ON t.gene = sco.gene AND t.pos BETWEEN start_position AND end_position + 10")
def q_cluster_truth_match_minus(spark, sf_dir):
    m = evaluate.match_clusters(clusters.cluster_scores(_clustered(spark, sf_dir)), _truth(spark, sf_dir), "-")
    return m.select("gene", "hap", "groupA", "groupB", "cluster_id", "match_start", "match_end", "truth_position", "truth_id")


@query([sql.SITES, sql.BASE], 'k.gene, k.hap, k."groupA", k."groupB", ID AS "ID", pos', '(SELECT DISTINCT gene, hap, "groupA", "groupB" FROM mt) k JOIN truth USING (gene) WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.gene = k.gene AND mt.hap = k.hap AND mt."groupA" = k."groupA" AND mt."groupB" = k."groupB" AND mt.truth_id = ID)')
def q_missed_truth(spark, sf_dir):
    return evaluate.missed_truth(_matches(spark, sf_dir), _truth(spark, sf_dir))


@query(
    [sql.SITES, sql.BASE, 'cm AS (SELECT gene, hap, "groupA", "groupB", count(DISTINCT cluster_id) AS nc, count(DISTINCT cluster_id) FILTER (truth_id IS NOT NULL) AS tp, count(DISTINCT truth_id) AS fv, any_value(nv) AS nv FROM mt JOIN (SELECT gene, count(DISTINCT ID) AS nv FROM truth GROUP BY gene) USING (gene) GROUP BY ALL)'],
    """gene, hap, "groupA", "groupB", nc AS "Total_Clusters", tp AS "TP_Clusters", fv AS "Found_Variants", nv AS "Total_Variants", nc - tp AS "FP_Clusters", nv - fv AS "Missed_Variants", round(tp / nc, 9) + 0.0 AS "Precision", round(fv / nv, 9) + 0.0 AS "Recall", round(coalesce(2 * (tp / nc) * (fv / nv) / nullif(tp / nc + fv / nv, 0), 0), 9) + 0.0 AS "F1_Score" """,
    "cm",
)
def q_cluster_truth_metrics(spark, sf_dir):
    return rounded(evaluate.cluster_truth_metrics(_matches(spark, sf_dir), _truth(spark, sf_dir)))


@query([sql.SITES, sql.TRUTH], 'gene, pos, ID AS "ID"', "truth WHERE pos BETWEEN (SELECT min(position) FROM att WHERE hap = 'hap2') AND (SELECT max(position) FROM att WHERE hap = 'hap2')")
def q_sites_in_range(spark, sf_dir):
    a = ad.site_attention(spark, sf_dir)
    return evaluate.sites_in_range(a.where("hap = 'hap2'"), ad.truth(a)).select("gene", "pos", "ID")


# Regions and haplotypes

REGIONS = f"""rg AS (SELECT p_partkey, 'chr' || (p_partkey % 22 + 1) AS chrom, (p_partkey * 7) % {ad.SPAN} AS s, (p_partkey * 7) % {ad.SPAN} + p_size * 10 AS e, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, p_name AS gene FROM part),
reg AS (SELECT chrom || ':' || s || '-' || e || ':' || strand || ':' || p_partkey AS region, * FROM rg),
va AS (SELECT *, ['A', 'C', 'GTA', 'T'][pos % 4 + 1] AS rf, string_split(['G', 'CAT', 'G', 'A,TT'][pos % 4 + 1], ',') AS alts FROM (SELECT DISTINCT 'chr' || (l_suppkey % 22 + 1) AS chrom, l_orderkey % 2500 + 1 AS pos FROM lineitem)),
g0 AS (SELECT 'chr' || (l_suppkey % 22 + 1) AS chrom, l_orderkey % 2500 + 1 AS pos, l_suppkey AS sample, max(l_linenumber % 3) AS a, max(CAST(trunc(l_quantity) AS INT) % 2) AS b, min(l_partkey) AS k FROM lineitem GROUP BY ALL),
gt AS (SELECT chrom, pos, sample, CASE WHEN pos % 4 = 3 THEN a ELSE least(a, 1) END AS a1, b AS a2 FROM g0 WHERE k % 10 <> 0)"""
HAPLOTYPES = f"""{REGIONS},
al AS (SELECT chrom, pos, sample, 'hap1' AS hap, a1 AS allele FROM gt UNION ALL SELECT chrom, pos, sample, 'hap2', a2 FROM gt),
ed AS (SELECT region, sample, hap, pos, len(rf) AS rl, alts[allele] AS alt FROM al JOIN va USING (chrom, pos) JOIN reg ON reg.chrom = al.chrom AND pos > s AND pos <= e WHERE allele >= 1 AND alts[allele] IS NOT NULL),
el AS (SELECT region, sample, hap, list(struct_pack(pos := pos, rl := rl, alt := alt, seq := '', ps := []::BIGINT[]) ORDER BY pos DESC) AS ed FROM ed GROUP BY ALL),
ctg AS (SELECT 'chr' || c AS chrom, list_aggregate(list_transform(generate_series(1, {ad.CONTIG}), lambda i: substr('ACGTTGCA', CAST((i * 7 + i // 11 + c) % 8 + 1 AS BIGINT), 1)), 'string_agg', '') AS seq FROM (SELECT DISTINCT p_partkey % 22 + 1 AS c FROM part)),
coh AS (SELECT DISTINCT 'chr' || (l_suppkey % 22 + 1) AS chrom, l_suppkey AS sample FROM lineitem),
fl AS (SELECT reg.region, reg.gene, coh.sample, h.hap, strand, s, list_reduce(coalesce(ed, []), lambda x, y: struct_pack(pos := y.pos, rl := y.rl, alt := y.alt, seq := substr(x.seq, 1, y.pos - s - 1) || y.alt || substr(x.seq, y.pos - s + y.rl), ps := list_concat(list_concat(x.ps[1:y.pos - s - 1], list_transform(generate_series(1, len(y.alt)), lambda i: y.pos)), x.ps[y.pos - s + y.rl:])),
    struct_pack(pos := 0::BIGINT, rl := 0::BIGINT, alt := '', seq := substr(ctg.seq, s + 1, e - s), ps := CASE WHEN e > s THEN generate_series(s + 1, e) ELSE [] END)) AS x
  FROM reg JOIN coh USING (chrom) CROSS JOIN (SELECT unnest(['hap1', 'hap2']) AS hap) h JOIN ctg USING (chrom) LEFT JOIN el USING (region, sample, hap)),
hp AS (SELECT region, gene, sample, hap, CASE WHEN strand = '-' THEN reverse(translate(regexp_replace(upper(x.seq), '[^ATGC]', 'N', 'g'), 'ATGC', 'TACG')) ELSE x.seq END AS seq, CASE WHEN strand = '-' THEN list_reverse(x.ps) ELSE x.ps END AS ps FROM fl)"""


def _cohort(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    return ad.variants(spark, sf_dir), ad.genotypes(spark, sf_dir), ad.regions(spark, sf_dir), ad.contigs(spark, sf_dir), ad.cohort(spark, sf_dir)


@query([REGIONS], "region, reg.chrom, pos", "va JOIN reg ON reg.chrom = va.chrom AND pos > s AND pos <= e")
def q_variants_in_regions(spark, sf_dir):
    return reg.variants_in_regions(ad.variants(spark, sf_dir), ad.regions(spark, sf_dir), 500).select("region", "chrom", "pos")


@query([HAPLOTYPES], "region, gene, sample, hap, CAST(len(seq) AS BIGINT) AS bases, md5(seq) AS seq_md5, md5(array_to_string(ps, ';')) AS pos_md5", "hp")
def q_haplotypes(spark, sf_dir):
    return reg.haplotypes(*_cohort(spark, sf_dir)).select("region", "gene", "sample", "hap", F.length("seq").cast("long").alias("bases"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"), F.md5(F.array_join(F.col("positions").cast("array<string>"), ";").cast("binary")).alias("pos_md5"))


@query(
    [HAPLOTYPES, "pr AS (SELECT region, sample, max(seq) FILTER (hap = 'hap1') AS a, max(seq) FILTER (hap = 'hap2') AS b, max(array_to_string(ps, ';')) FILTER (hap = 'hap1') AS pa, max(array_to_string(ps, ';')) FILTER (hap = 'hap2') AS pb FROM hp GROUP BY ALL), ok AS (SELECT *, regexp_full_match(a, '[ACGTNacgtn]+') AND regexp_full_match(b, '[ACGTNacgtn]+') AS ok FROM pr)"],
    "region, sample, CAST(sample % 4 AS VARCHAR) AS sample_type, md5(CASE WHEN ok THEN a ELSE '' END) AS h1, md5(CASE WHEN ok THEN pa ELSE '' END) AS p1, md5(CASE WHEN ok THEN b ELSE '' END) AS h2, md5(CASE WHEN ok THEN pb ELSE '' END) AS p2",
    "ok",
)
def q_labeled_haplotypes(spark, sf_dir):
    p = reg.labeled_haplotypes(*_cohort(spark, sf_dir), ad.supplier_samples(spark, sf_dir))
    md5 = lambda c, n: F.md5(F.col(c).cast("binary")).alias(n)
    return p.select("region", "sample", "sample_type", md5("hap1_seq", "h1"), md5("hap1_pos", "p1"), md5("hap2_seq", "h2"), md5("hap2_pos", "p2"))


@query([REGIONS, "a1 AS (SELECT chrom, pos, rf, unnest(alts) AS alt FROM va)"], "chrom, pos, CAST(max(greatest(len(alt) - len(rf), 0)) AS INT) AS insertion, CAST(max(greatest(len(rf) - len(alt), 0)) AS INT) AS deletion", "a1 GROUP BY chrom, pos")
def q_indel_lengths(spark, sf_dir):
    return reg.indel_lengths(ad.variants(spark, sf_dir))


@query([REGIONS, "a1 AS (SELECT chrom, pos, rf, unnest(alts) AS alt FROM va)"], "DISTINCT chrom, position", "(SELECT chrom, unnest(generate_series(pos, pos + greatest(len(rf) - len(alt), 0))) AS position FROM a1 UNION ALL SELECT 'chr' || (l_suppkey % 22 + 1), l_orderkey % 500 FROM lineitem)")
def q_position_universe(spark, sf_dir):
    seen = ad.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("chr"), (F.col("l_suppkey") % 22 + 1).cast("string")).alias("chrom"), (F.col("l_orderkey") % 500).alias("position"))
    return reg.position_universe(ad.variants(spark, sf_dir), seen)


SEQ = "sq AS (SELECT doc_id AS sample, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') AS seq FROM documents)"
CODE = "CASE substr({0}, CAST({1} AS BIGINT), 1) WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 3 ELSE 4 END"


@query([SEQ], "sample, md5(reverse(translate(seq, 'ATGC', 'TACG'))) AS rc", "sq")
def q_revcomp(spark, sf_dir):
    return ad.sequences(spark, sf_dir).select("sample", F.md5(reverse_complement(F.col("seq")).cast("binary")).alias("rc"))


@query([SEQ], "max(len(seq)) AS max_length, CAST(floor(avg(len(seq))) AS BIGINT) AS avg_length, count(*) AS n_sequences, CASE WHEN max(len(seq)) <= 4096 THEN 'short' WHEN max(len(seq)) <= 131072 THEN 'medium' ELSE 'long' END AS plan", "sq WHERE len(seq) > 0")
def q_length_stats(spark, sf_dir):
    return attention.length_stats(ad.sequences(spark, sf_dir))


CHUNKS = f"""{SEQ}, n0 AS (SELECT *, len(seq) AS n, CASE WHEN len(seq) <= 256 THEN 1 ELSE CAST(ceil((len(seq) - 64) / 192) AS INT) END AS k FROM sq WHERE len(seq) > 0),
n1 AS (SELECT *, unnest(generate_series(0, k - 1)) AS chunk FROM n0),
n2 AS (SELECT *, CASE WHEN chunk = k - 1 THEN greatest(n - 256, 0) ELSE chunk * 192 END AS cs FROM n1),
ch AS (SELECT *, least(cs + 256, n) AS ce, CASE WHEN chunk = 0 THEN cs ELSE cs + 32 END AS vs, CASE WHEN chunk = k - 1 THEN least(cs + 256, n) ELSE least(cs + 256, n) - 32 END AS ve FROM n2)"""


@query([CHUNKS], "sample, CAST(chunk AS INT) AS chunk, CAST(cs AS INT) AS chunk_start, CAST(ce AS INT) AS chunk_end, CAST(vs AS INT) AS valid_start, CAST(ve AS INT) AS valid_end, md5(substr(seq, cs + 1, ce - cs)) AS chunk_md5", "ch")
def q_chunk_spans(spark, sf_dir):
    c = attention.chunk_spans(ad.sequences(spark, sf_dir), 256, 64)
    return c.select("sample", "chunk", *(F.col(x).cast("int").alias(x) for x in ("chunk_start", "chunk_end", "valid_start", "valid_end")), F.md5(F.col("chunk_seq").cast("binary")).alias("chunk_md5"))


def toy_scorer() -> Callable[[list[str]], list[np.ndarray]]:
    """Scores of a base: 1 to 4 for A, C, G and T, times its place from 1."""
    code = np.full(256, 4.0)
    code[[65, 67, 71]] = 1.0, 2.0, 3.0
    return lambda texts: [code[np.frombuffer(t.encode(), np.uint8)] * np.arange(1, len(t) + 1) for t in texts]


@query([SEQ], "sample, CAST(coalesce(list_sum(list_transform(generate_series(1, len(seq)), lambda i: " + CODE.format("seq", "i") + " * i)), 0) AS DOUBLE) AS total, len(seq) AS n", "sq")
def q_toy_scorer(spark, sf_dir):
    s = attention.score_sequences(ad.sequences(spark, sf_dir).select("sample", "seq"), toy_scorer)
    return s.select("sample", F.aggregate("scores", F.lit(0.0), lambda x, y: x + y).alias("total"), F.size("scores").cast("long").alias("n"))


@query([SEQ, "tk AS (SELECT sample, seq, unnest(generate_series(1, len(seq))) AS i FROM sq WHERE len(seq) > 0)"], "sample, i * 2 // 3 AS position, CAST(arg_max(" + CODE.format("seq", "i") + " * i, i) AS DOUBLE) AS score", "tk GROUP BY sample, i * 2 // 3")
def q_collapse_last(spark, sf_dir):
    s = attention.score_sequences(ad.sequences(spark, sf_dir), toy_scorer)
    return attention.collapse_last(s, ["sample"])


@query([CHUNKS, "ck AS (SELECT sample, chunk, cs, seq, unnest(generate_series(vs + 1, ve)) AS i FROM ch), cm AS (SELECT sample, chunk, i * 2 // 3 AS position, avg(" + CODE.format("seq", "i") + " * (i - cs)) AS m FROM ck GROUP BY ALL)"], "sample, position, round(avg(m), 9) + 0.0 AS score", "cm GROUP BY sample, position")
def q_collapse_chunk_mean(spark, sf_dir):
    c = attention.score_sequences(attention.chunk_spans(ad.sequences(spark, sf_dir), 256, 64), toy_scorer, "chunk_seq")
    return rounded(attention.collapse_chunks(c, ["sample"]))


@query([], "vec_id AS sample, CAST(j AS INT) AS col, round(sum(abs(embedding[i * 8 + j + 1]::DOUBLE)) / 2, 9) + 0.0 AS score", "embeddings, (SELECT unnest(generate_series(0, 7)) AS i), (SELECT unnest(generate_series(0, 7)) AS j) GROUP BY vec_id, j")
def q_attn_column_sums(spark, sf_dir):
    e = ad.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), F.posexplode("embedding").alias("i", "e"))
    w = e.select("sample", (F.floor(F.col("i") / 8) % 2).alias("head"), F.floor(F.col("i") / 16).alias("row"), (F.col("i") % 8).alias("col"), F.abs(F.col("e").cast("double")).alias("weight"))
    return rounded(attention.attention_column_sums(w, ("sample",)))


TOKENS = "SELECT unnest(generate_series(0, 7)) AS t"


@query(
    [
        f"hd AS (SELECT vec_id AS sample, t AS token, embedding[t * 8 + 1:t * 8 + 4]::DOUBLE[] AS q, embedding[t * 8 + 5:t * 8 + 8]::DOUBLE[] AS k FROM embeddings, ({TOKENS}) x)",
        "sm AS (SELECT a.sample, a.token AS row, b.token AS col, list_dot_product(a.q, b.k) / 2 AS s FROM hd a JOIN hd b ON a.sample = b.sample AND b.token <= a.token)",
        "se AS (SELECT *, exp(s - max(s) OVER (PARTITION BY sample, row)) AS e FROM sm)",
        "sn AS (SELECT *, e / (sum(e) OVER (PARTITION BY sample, row) + 1e-12::DOUBLE) AS w FROM se)",
    ],
    "sample, CAST(col AS INT) AS col, round(sum(w), 9) + 0.0 AS score",
    "sn GROUP BY sample, col",
)
def q_attn_column_sums_qk(spark, sf_dir):
    e = ad.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("token"))
    cut = lambda i: F.slice("embedding", F.col("token") * 8 + i, F.lit(4)).cast("array<double>")
    return rounded(attention.attention_column_sums_qk(e.select("sample", F.lit(0).alias("head"), "token", cut(1).alias("q"), cut(5).alias("k")), ("sample",)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which genes differ between case and control: metrics, U tests and false discovery rates, sorted by the p of std."""
    m = metrics.with_group(metrics.seventeen_metrics(ad.embedding_attention(spark, sf_dir), ad.embedding_roster(spark, sf_dir)), ad.embedding_samples(spark, sf_dir))
    return metrics.pvalue_table(metrics.gene_tests(m))
