"""The same queries in SQL. Parts are joined as common table expressions."""

from __future__ import annotations

from helixframe.operators.metrics import METRICS


def erfc(x: str) -> str:
    """erfc for x > 0, as a series and as a continued fraction; 1 else."""
    series = f"1 - list_sum(list_transform(generate_series(0, 90), lambda n: exp((2 * n + 1) * ln({x}) - {x} * {x} - lgamma(n + 1.5::DOUBLE))))"
    fraction = f"exp(-({x}) * ({x})) / sqrt(pi()) / list_reduce(list_concat([{x}], list_transform(generate_series(0, 119), lambda i: (120 - i) / 2.0::DOUBLE)), lambda acc, k: {x} + k / acc)"
    return f"CASE WHEN {x} <= 0 THEN 1.0::DOUBLE WHEN {x} < 2.5 THEN {series} ELSE {fraction} END"


EMBEDDING = """
em AS (SELECT vec_id AS sample, label, embedding, CAST(unnest(generate_series(0, 63)) AS INT) AS i FROM embeddings),
em1 AS (SELECT * FROM em WHERE NOT ((sample * 31 + i * 17) % 23 = 0 OR (label % 4 = 2 AND (sample * 7 + i * 3) % 5 = 0))),
att AS (
  SELECT 'gene' || (i // 16) AS gene, 'hap1' AS hap, sample, CAST(1000 + i AS BIGINT) AS position, abs(CAST(embedding[i + 1] AS DOUBLE)) AS score FROM em1
  UNION ALL SELECT 'gene' || (i // 16), 'hap2', sample, CAST(1000 + i AS BIGINT), abs(CAST(embedding[64 - i] AS DOUBLE)) FROM em1),
roster AS (SELECT DISTINCT 'gene' || g AS gene, hap, vec_id AS sample FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS g), (SELECT unnest(['hap1', 'hap2']) AS hap)),
smp AS (SELECT vec_id AS sample, CAST(label % 4 AS INT) AS sample_type FROM embeddings)"""


def _cells(gene: str, haps: dict[str, str], wide: int) -> str:
    rows = " UNION ALL ".join(f"SELECT {gene.format(c)} AS gene, '{h}' AS hap, l_suppkey AS sample, {c} % {wide} AS position, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem" for h, c in haps.items())
    return f"""
li AS ({rows}),
att AS (SELECT gene, hap, sample, position, CAST(sum(cents) AS DOUBLE) / count(*) / 9999991.0::DOUBLE * CASE WHEN sample % 4 = 2 AND position % 100 < 30 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM li GROUP BY gene, hap, sample, position),
smp AS (SELECT DISTINCT l_suppkey AS sample, CAST(l_suppkey % 4 AS INT) AS sample_type FROM lineitem)"""


SITES = _cells("'gene' || ({} // 125 % 4)", {"hap1": "l_orderkey", "hap2": "l_partkey"}, 125)
GENES = _cells("'chr_forward_g' || (l_partkey % 20)", {"hap1": "l_orderkey"}, 500)
TRUTH = "truth AS (SELECT DISTINCT gene, position AS pos, 'v' || position AS ID FROM att WHERE hap = 'hap1' AND position % 100 < 50 AND (position + position // 100) % 9 = 0)"


def ladder(rows: str, keys: str, out: str) -> str:
    """Rank statistics of rows (keys, value, is_a) as out (keys, n_a, n_b, u_a, ties, auc, wasserstein, pvalue)."""
    z = "(greatest(u_a, n_a * n_b - u_a) - n_a * n_b / 2 - 0.5::DOUBLE) / s / sqrt(2.0::DOUBLE)"
    return f"""
{out}_0 AS (SELECT {keys}, value, CAST(count(*) FILTER (is_a) AS DOUBLE) AS a, CAST(count(*) FILTER (NOT is_a) AS DOUBLE) AS b FROM {rows} WHERE value IS NOT NULL AND is_a IS NOT NULL GROUP BY ALL),
{out}_1 AS (SELECT *, sum(a) OVER w AS cum_a, sum(b) OVER w AS cum_b, sum(a) OVER (PARTITION BY {keys}) AS n_a, sum(b) OVER (PARTITION BY {keys}) AS n_b, lead(value) OVER w AS next_value FROM {out}_0 WINDOW w AS (PARTITION BY {keys} ORDER BY value)),
{out}_2 AS (SELECT {keys}, max(n_a) AS n_a, max(n_b) AS n_b, sum(a * (cum_b - b / 2)) AS u_a, sum((a + b) * (a + b) * (a + b) - (a + b)) AS ties,
  sum(CASE WHEN n_a > 0 AND n_b > 0 THEN abs(cum_a / n_a - cum_b / n_b) * (next_value - value) END) AS w FROM {out}_1 GROUP BY {keys}),
{out}_3 AS (SELECT *, sqrt(n_a * n_b / 12 * ((n_a + n_b + 1) - ties / nullif((n_a + n_b) * (n_a + n_b - 1), 0))) AS s FROM {out}_2),
{out}_4 AS (SELECT *, CASE WHEN s > 0 THEN {z} END AS z FROM {out}_3),
{out} AS (SELECT {keys}, n_a, n_b, u_a, ties, CASE WHEN n_a > 0 AND n_b > 0 THEN u_a / (n_a * n_b) END AS auc, CASE WHEN n_a > 0 AND n_b > 0 THEN coalesce(w, 0) END AS wasserstein,
  CASE WHEN n_a = 0 OR n_b = 0 THEN NULL WHEN s > 0 THEN least(1.0::DOUBLE, {erfc('z')}) ELSE 1.0::DOUBLE END AS pvalue FROM {out}_4)"""


def bh(rows: str, keys: str, out: str, p: str = "pvalue", q: str = "padj") -> str:
    return f"""
{out}_r AS (SELECT *, row_number() OVER (PARTITION BY {keys}, {p} IS NULL ORDER BY {p}) AS _r, count({p}) OVER (PARTITION BY {keys}) AS _m FROM {rows}),
{out} AS (SELECT * EXCLUDE (_r, _m), CASE WHEN {p} IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, min({p} * _m / _r) OVER (PARTITION BY {keys}, {p} IS NULL ORDER BY _r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) END AS {q} FROM {out}_r)"""


METRIC_PARTS = """
w0 AS (SELECT *, avg(score) OVER k AS mu, count(*) OVER k AS n, row_number() OVER (k ORDER BY score, position) AS up, lag(score) OVER (k ORDER BY position) AS prv FROM att WHERE score IS NOT NULL WINDOW k AS (PARTITION BY gene, hap, sample)),
w1 AS (SELECT *, sum(CASE WHEN prv IS NULL OR prv <> score THEN 1 ELSE 0 END) OVER (PARTITION BY gene, hap, sample ORDER BY position) AS run FROM w0),
r0 AS (SELECT gene, hap, sample, run, max(score) AS v, max(mu) AS mu FROM w1 GROUP BY ALL),
r1 AS (SELECT *, lag(v) OVER (PARTITION BY gene, hap, sample ORDER BY run) AS a, lead(v) OVER (PARTITION BY gene, hap, sample ORDER BY run) AS b FROM r0),
pk AS (SELECT gene, hap, sample, count(*) AS c, avg(v) AS m FROM r1 WHERE a < v AND b < v AND v >= mu GROUP BY ALL),
md AS (SELECT gene, hap, sample, arg_min(score, (-c, score)) AS mode FROM (SELECT gene, hap, sample, score, count(*) AS c FROM w0 GROUP BY ALL) GROUP BY ALL),
ag AS (
  SELECT gene, hap, sample, avg(score) AS mean, max(score) AS max, stddev_samp(score) AS std, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS iqr,
    avg((score - mu) ** 3) / nullif(avg((score - mu) ** 2), 0) ** 1.5 AS skewness, avg((score - mu) ** 4) / nullif(avg((score - mu) ** 2), 0) ** 2 - 3 AS kurtosis,
    avg(score) FILTER (up > n - greatest(1, floor(0.05::DOUBLE * n))) AS top5_percent_mean, avg(score) FILTER (up <= greatest(1, floor(0.05::DOUBLE * n))) AS low5_percent_mean,
    quantile_cont(score, 0.9) AS percentile_90, quantile_cont(score, 0.1) AS percentile_10, count(*) AS n,
    ln(sum(score) FILTER (score > 0)) - sum(score * ln(score)) FILTER (score > 0) / sum(score) FILTER (score > 0) AS shannon_entropy
  FROM w0 GROUP BY ALL),
met0 AS (
  SELECT ag.*, std / nullif(mean, 0) AS cv, mode, CAST(coalesce(c, 0) AS DOUBLE) AS peak_count, coalesce(c, 0) / n AS peak_density, pk.m AS peak_mean
  FROM ag JOIN md USING (gene, hap, sample) LEFT JOIN pk USING (gene, hap, sample))"""
ROSTER_METRICS = "met AS (SELECT gene, hap, sample, " + ", ".join(f"coalesce(met0.{m}, 0) AS {m}" if m in ("peak_count", "peak_density", "shannon_entropy") else f"met0.{m}" for m in METRICS) + " FROM roster LEFT JOIN met0 USING (gene, hap, sample))"
GENE_TESTS = (
    METRIC_PARTS
    + ", grp AS (SELECT m.*, CASE sample_type WHEN 0 THEN 'control' WHEN 2 THEN 'case' END AS grp FROM met0 m LEFT JOIN smp USING (sample)), lng AS ("
    + " UNION ALL ".join(f"SELECT gene, hap, sample, grp, '{m}' AS metric, {m} AS value FROM grp WHERE grp IS NOT NULL" for m in METRICS)
    + "), gr AS (SELECT gene, metric, value, grp = 'case' AS is_a FROM lng WHERE hap = 'hap1'),"
    + ladder("gr", "gene, metric", "gu")
    + ", evr AS (SELECT DISTINCT gene, metric FROM met0, (SELECT unnest(["
    + ", ".join(f"'{m}'" for m in METRICS)
    + "]) AS metric) WHERE hap = 'hap1'), gp AS (SELECT evr.gene, evr.metric, gu.pvalue AS p FROM evr LEFT JOIN gu USING (gene, metric)),"
    + bh("gp", "metric", "gq", "p", "p_corrected")
    + ", tst AS (SELECT *, coalesce(p_corrected <= 0.05, false) AS significant FROM gq)"
)

PAIRS = "prs AS (SELECT * FROM (VALUES (1, 2), (1, 3)) t(groupA, groupB))"
BASE = (
    f"""{PAIRS}, lab AS (SELECT sample, CAST((sample_type + 1) % 4 AS INT) AS label FROM smp),
kn AS (SELECT * REPLACE (abs(score) AS score) FROM att WHERE (gene, position) IN (SELECT (gene, position) FROM att WHERE hap = 'hap1' AND score IS NOT NULL)),
gs0 AS (SELECT gene, hap, position, label, count(score) AS n, avg(score) AS mean, stddev_samp(score) AS std, sum(score) AS total FROM kn JOIN lab USING (sample) GROUP BY ALL),
gs AS (SELECT *, sum(total) OVER (PARTITION BY gene, hap, position) / sum(n) OVER (PARTITION BY gene, hap, position) AS "baseMean" FROM gs0),
ps AS (
  SELECT s.gene, s.hap, s.position, "groupA", "groupB", s."baseMean", coalesce(a.n, 0) AS "n_A", coalesce(b.n, 0) AS "n_B", a.mean AS "mean_A", b.mean AS "mean_B", a.std AS "std_A", b.std AS "std_B"
  FROM (SELECT gene, hap, position, min("baseMean") AS "baseMean" FROM gs GROUP BY ALL) s CROSS JOIN prs
  LEFT JOIN gs a ON a.gene = s.gene AND a.hap = s.hap AND a.position = s.position AND a.label = "groupA" LEFT JOIN gs b ON b.gene = s.gene AND b.hap = s.hap AND b.position = s.position AND b.label = "groupB"),
fo0 AS (SELECT *, least(min("mean_A") OVER w, min("mean_B") OVER w) AS lo FROM ps WINDOW w AS (PARTITION BY gene, hap, "groupA", "groupB")),
fo1 AS (SELECT *, CASE WHEN lo <= 0 THEN -lo + 1e-8 ELSE 0.0::DOUBLE END AS sh FROM fo0),
fo AS (SELECT *, log2(("mean_B" + sh) / ("mean_A" + sh + 1e-8::DOUBLE)) AS "log2FC", "mean_B" - "mean_A" AS delta FROM fo1),
pr AS (SELECT gene, hap, position, "groupA", "groupB", score AS value, label = "groupA" AS is_a FROM kn JOIN lab USING (sample) JOIN prs ON label IN ("groupA", "groupB") WHERE score IS NOT NULL),"""
    + ladder("pr", "gene, hap, position, groupA, groupB", "rk")
    + """, df0 AS (SELECT fo.*, CASE WHEN rk.n_a >= 10 AND rk.n_b >= 10 THEN rk.pvalue END AS pvalue FROM fo LEFT JOIN rk USING (gene, hap, position, groupA, groupB)),"""
    + bh("df0", "gene, hap, groupA, groupB", "dfr")
    + """, sp0 AS (SELECT ps.*, rk.auc, rk.wasserstein, sqrt(((ps."n_A" - 1) * "std_A" ** 2 + (ps."n_B" - 1) * "std_B" ** 2) / CASE WHEN ps."n_A" + ps."n_B" > 2 THEN ps."n_A" + ps."n_B" - 2 END) AS pooled FROM ps LEFT JOIN rk USING (gene, hap, position, groupA, groupB)),
sp1 AS (SELECT *, "n_A" >= 10 AND "n_B" >= 10 AS ok, CASE WHEN pooled > 0 THEN ("mean_B" - "mean_A") / pooled END AS d FROM sp0),
sep AS (SELECT gene, hap, position, "groupA", "groupB", "n_A", "n_B", CASE WHEN ok THEN "mean_A" END AS "mean_A", CASE WHEN ok THEN "mean_B" END AS "mean_B", CASE WHEN ok THEN "std_A" END AS "std_A", CASE WHEN ok THEN "std_B" END AS "std_B",
  CASE WHEN ok THEN auc END AS auc, CASE WHEN ok THEN 2 * auc - 1 END AS cliffs_delta, CASE WHEN ok THEN wasserstein END AS wasserstein, CASE WHEN ok THEN d END AS cohen_d, CASE WHEN ok AND "n_A" + "n_B" > 3 THEN d * (1 - 3 / (4 * ("n_A" + "n_B") - 9)) END AS hedges_g FROM sp1),
eff AS (SELECT dfr.*, sep.cohen_d, sep.hedges_g FROM dfr JOIN sep USING (gene, hap, position, groupA, groupB)),
tr0 AS (SELECT gene, hap, "groupA", "groupB", unnest(generate_series(min(position), max(position))) AS position FROM eff GROUP BY gene, hap, "groupA", "groupB"),
tr AS (SELECT t.*, coalesce("log2FC", 0) AS "log2FC", coalesce(padj, 1) AS padj, coalesce(cohen_d, 0) AS cohen_d FROM tr0 t LEFT JOIN eff USING (gene, hap, groupA, groupB, position)),
hi AS (SELECT tr.*, padj < 0.05 AND abs("log2FC") >= lv AND abs(cohen_d) > 0.5 AS highlighted FROM tr JOIN (SELECT gene, hap, "groupA", "groupB", quantile_cont(abs("log2FC"), 0.95) AS lv FROM tr GROUP BY ALL) USING (gene, hap, groupA, groupB)),
aq AS (SELECT gene, 1 - (0.2::DOUBLE / (count(*) / 1000)) * log10(count(*) / 1000 / 4 + 9) AS q FROM eff WHERE hap = 'hap1' GROUP BY gene),
al AS (SELECT gene, hap, "groupA", "groupB", list_sort(list(abs("log2FC")) FILTER ("log2FC" IS NOT NULL)) AS v, any_value(q) AS q FROM eff JOIN aq USING (gene) GROUP BY gene, hap, "groupA", "groupB"),
lv AS (SELECT gene, hap, "groupA", "groupB", v[CAST(floor(q * (len(v) - 1)) AS INT) + 1] + (q * (len(v) - 1) - floor(q * (len(v) - 1))) * (coalesce(v[CAST(floor(q * (len(v) - 1)) AS INT) + 2], v[CAST(floor(q * (len(v) - 1)) AS INT) + 1]) - v[CAST(floor(q * (len(v) - 1)) AS INT) + 1]) AS lv FROM al WHERE q >= 0),
sig AS (SELECT eff.* FROM eff JOIN lv USING (gene, hap, groupA, groupB) WHERE padj < 0.05 AND abs("log2FC") >= lv AND abs(cohen_d) >= 0.2),
c0 AS (SELECT *, count(*) OVER (PARTITION BY gene, hap, "groupA", "groupB" ORDER BY position RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) >= 5 AS core FROM sig),
c1 AS (SELECT *, lag(position) OVER (PARTITION BY gene, hap, "groupA", "groupB" ORDER BY position) AS pp FROM c0 WHERE core),
c2 AS (SELECT *, sum(CASE WHEN pp IS NULL OR position - pp > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY gene, hap, "groupA", "groupB" ORDER BY position) - 1 AS id FROM c1),
clu AS (SELECT s.*, CAST(coalesce((SELECT min(c.id) FROM c2 c WHERE c.gene = s.gene AND c.hap = s.hap AND c."groupA" = s."groupA" AND c."groupB" = s."groupB" AND abs(c.position - s.position) <= 20 AND (NOT s.core OR c.position = s.position)), -1) AS INT) AS cluster FROM c0 s),
k0 AS (SELECT *, abs("log2FC") AS f, CASE WHEN padj = 0 THEN 'infinity'::DOUBLE ELSE -log10(padj) END AS p, position - lag(position) OVER (PARTITION BY gene, hap, "groupA", "groupB", cluster ORDER BY position) AS gap FROM clu WHERE cluster >= 0),
k1 AS (SELECT *, row_number() OVER (PARTITION BY gene, hap, "groupA", "groupB", cluster ORDER BY f DESC, position) AS rf, row_number() OVER (PARTITION BY gene, hap, "groupA", "groupB", cluster ORDER BY p DESC, position) AS rp FROM k0),
k2 AS (SELECT gene, hap, "groupA", "groupB", cluster AS cluster_id, count(*) AS n_points, CAST(floor(median(position)) AS BIGINT) AS center_position, min(position) AS start_position, max(position) AS end_position, avg(f) FILTER (rf <= 10) AS "mean_abs_log2FC_top10", avg(p) FILTER (rp <= 10) AS mean_p_strength_top10,
  CASE WHEN count(*) = 1 THEN 1.0::DOUBLE ELSE coalesce(avg(gap) FILTER (gap > 0), 0.1::DOUBLE) END AS mean_spacing, CASE WHEN avg("log2FC") > 0 THEN 'up' ELSE 'down' END AS direction FROM k1 GROUP BY ALL),
sco AS (SELECT *, ln(n_points) + ln(100 / (mean_spacing + 1e-9::DOUBLE)) + 30 * "mean_abs_log2FC_top10" + 0.5::DOUBLE * mean_p_strength_top10 AS total_score FROM k2),"""
    + TRUTH
    + """, mt AS (SELECT sco.*, start_position - 10 AS match_start, end_position AS match_end, t.pos AS truth_position, t.ID AS truth_id FROM sco LEFT JOIN truth t ON t.gene = sco.gene AND t.pos BETWEEN start_position - 10 AND end_position),
win AS (SELECT 0 AS left_bp, unnest([3, 5, 10, 20]) AS right_bp),
sc0 AS (SELECT tr.*, left_bp, right_bp, abs("log2FC") AS signal, EXISTS (SELECT 1 FROM truth t WHERE t.gene = tr.gene AND tr.position BETWEEN t.pos - left_bp AND t.pos + right_bp) AS is_true, coalesce((SELECT min(abs(t.pos - tr.position)) FROM truth t WHERE t.gene = tr.gene), 'infinity'::DOUBLE)::DOUBLE AS distance FROM tr, win),
ar AS (SELECT gene, hap, "groupA", "groupB", left_bp, right_bp, signal AS value, is_true AS is_a FROM sc0),"""
    + ladder("ar", "gene, hap, groupA, groupB, left_bp, right_bp", "au")
    + """, ap AS (SELECT gene, hap, "groupA", "groupB", left_bp, right_bp, CASE WHEN max(n_a) > 0 AND max(n_b) > 0 THEN sum(a * (n_a - cum_a + a) / (n_a - cum_a + a + n_b - cum_b + b)) / max(n_a) END AS "AUPRC" FROM au_1 GROUP BY ALL),
ev0 AS (SELECT *, row_number() OVER (PARTITION BY gene, hap, "groupA", "groupB", right_bp ORDER BY signal DESC, position DESC) AS dn, count(*) OVER (PARTITION BY gene, hap, "groupA", "groupB", right_bp) AS n, count(*) FILTER (is_true) OVER (PARTITION BY gene, hap, "groupA", "groupB", right_bp) AS k FROM sc0),
ev1 AS (SELECT gene, hap, "groupA", "groupB", left_bp, right_bp, count(*) FILTER (is_true) AS np, count(*) FILTER (NOT is_true) AS nn, coalesce(avg(signal) FILTER (is_true), 0) AS m1, coalesce(avg(signal) FILTER (NOT is_true), 0) AS m0, stddev_pop(signal) FILTER (is_true) AS d1, stddev_pop(signal) FILTER (NOT is_true) AS d0, sum(signal) AS total, coalesce(sum(signal) FILTER (is_true), 0) AS ins, sum(signal * distance) AS mom,
  max(position) - min(position) + 1 AS len, avg(CAST(is_true AS INT)) FILTER (dn <= k) AS pk, avg((n - dn) / (n - 1)) FILTER (is_true) AS mr FROM ev0 GROUP BY ALL),
ev AS (SELECT gene, hap, "groupA", "groupB", left_bp, right_bp, np AS "Positive_Base_Count", m1 AS "Mean_Signal_True", m0 AS "Mean_Signal_Background", CASE WHEN m0 > 0 THEN m1 / m0 END AS "SNR", CASE WHEN total > 0 THEN ins / total ELSE 0 END AS "FRiW", CASE WHEN total > 0 THEN mom / total END AS "Weighted_Dist", np / (np + nn) AS "Expected_FRiW",
  CASE WHEN np > 0 THEN (CASE WHEN total > 0 THEN ins / total ELSE 0 END) / (np / (np + nn)) END AS "FRiW_Enrichment", (CASE WHEN total > 0 THEN mom / total END) / (len / (2 * nv)) AS "Normalized_Weighted_Dist",
  (m1 - m0) / nullif(sqrt(((np - 1) * coalesce(d1, 0) ** 2 + (nn - 1) * coalesce(d0, 0) ** 2) / (np + nn - 2)), 0) AS "Cohens_d", pk AS "Precision_at_K", mr AS "Mean_Rank_True", len AS "Seq_Length", nv AS "N_Variants", auc AS "AUC", "AUPRC"
  FROM ev1 JOIN (SELECT gene, count(*) AS nv FROM truth GROUP BY gene) USING (gene) JOIN au USING (gene, hap, groupA, groupB, left_bp, right_bp) JOIN ap USING (gene, hap, groupA, groupB, left_bp, right_bp))"""
)
DELETION = f"""{PAIRS}, lab AS (SELECT sample, CAST((sample_type + 1) % 4 AS INT) AS label FROM smp),
sz AS (SELECT gene, hap, label, count(*) AS size FROM roster JOIN lab USING (sample) GROUP BY ALL),
pres AS (SELECT gene, hap, position, label, count(score) AS here FROM att JOIN lab USING (sample) GROUP BY ALL),
spine AS (SELECT p.gene, h.hap, p.position FROM (SELECT DISTINCT gene, position FROM att WHERE hap = 'hap1') p JOIN (SELECT DISTINCT gene, hap FROM att) h USING (gene)),
tb AS (SELECT s.gene, s.hap, s.position, "groupA", "groupB", a.size AS "nA", b.size AS "nB", coalesce(pa.here, 0) AS ap, coalesce(pb.here, 0) AS bp FROM spine s CROSS JOIN prs
  JOIN sz a ON a.gene = s.gene AND a.hap = s.hap AND a.label = "groupA" JOIN sz b ON b.gene = s.gene AND b.hap = s.hap AND b.label = "groupB"
  LEFT JOIN pres pa ON pa.gene = s.gene AND pa.hap = s.hap AND pa.position = s.position AND pa.label = "groupA" LEFT JOIN pres pb ON pb.gene = s.gene AND pb.hap = s.hap AND pb.position = s.position AND pb.label = "groupB" WHERE a.size >= 10 AND b.size >= 10),
t1 AS (SELECT *, "nA" - ap AS ad, "nB" - bp AS bd FROM tb),
t2 AS (SELECT DISTINCT ad, ap, bd, bp, ad + bd AS col, ad + ap AS ra, bd + bp AS rb FROM t1),
t3 AS (SELECT *, unnest(generate_series(greatest(0, col - rb), least(ra, col))) AS x FROM t2 WHERE least(ad, ap, bd, bp) < 5),
t4 AS (SELECT *, exp(lgamma(ra + 1::DOUBLE) - lgamma(x + 1::DOUBLE) - lgamma(ra - x + 1::DOUBLE) + lgamma(rb + 1::DOUBLE) - lgamma(col - x + 1::DOUBLE) - lgamma(rb - col + x + 1::DOUBLE) - (lgamma(ra + rb + 1::DOUBLE) - lgamma(col + 1::DOUBLE) - lgamma(ra + rb - col + 1::DOUBLE))) AS pm FROM t3),
t5 AS (SELECT ad, ap, bd, bp, least(1.0::DOUBLE, sum(pm) FILTER (pm <= p0 * (1 + 1e-7::DOUBLE))) AS pvalue FROM (SELECT *, max(CASE WHEN x = ad THEN pm END) OVER (PARTITION BY ad, ap, bd, bp) AS p0 FROM t4) GROUP BY ad, ap, bd, bp),
t6 AS (SELECT ad, ap, bd, bp, sqrt((pow(greatest(abs(ad - ra * col / (ra + rb)) - 0.5::DOUBLE, 0), 2) * (1 / (ra * col / (ra + rb)) + 1 / (ra * (ra + rb - col) / (ra + rb)) + 1 / (rb * col / (ra + rb)) + 1 / (rb * (ra + rb - col) / (ra + rb)))) / 2) AS rx FROM t2 WHERE least(ad, ap, bd, bp) >= 5),
t7 AS (SELECT * FROM t5 UNION ALL SELECT ad, ap, bd, bp, {erfc('rx')} FROM t6),
t8 AS (SELECT gene, hap, "groupA", "groupB", position, ((ad + 0.5::DOUBLE) / (ap + 0.5::DOUBLE)) / ((bd + 0.5::DOUBLE) / (bp + 0.5::DOUBLE)) AS "OR_deleted", pvalue, "nA", "nB" FROM t1 JOIN t7 USING (ad, ap, bd, bp)),""" + bh("t8", "gene, hap, groupA, groupB", "del")
