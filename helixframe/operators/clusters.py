"""Clusters of significant sites along positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.base import listed
from helixframe.operators.density import density_clusters, kth_eps
from helixframe.operators.quantiles import quantile_by_key
from helixframe.sources.scratch import written

KEYS = ("gene", "hap", "groupA", "groupB")


def adaptive_quantile(n_rows: Column) -> Column:
    """1 - 0.2 / L * log10(L / 4 + 9) for L thousands of rows; negative for few rows."""
    big = n_rows / 1000
    return 1 - (0.2 / big) * F.log10(big / 4 + 9)


def significant_sites(effects: DataFrame, padj: float = 0.05, quantile: float | None = None, cohen: float | None = 0.2) -> DataFrame:
    """Sites with padj below its bound, |log2FC| at or above the quantile over the pair's sites and |cohen_d| at or above its bound (if any).

    Without quantile it is the adaptive one of all hap1 rows of the gene, for both haplotypes; a negative one selects
    nothing. The quantile is exact (see quantile_by_key()); effects is read several times for it, so write it first.
    """
    size = F.abs("log2FC")
    if quantile is None:
        at = effects.where(F.col("hap") == "hap1").groupBy("gene").agg(adaptive_quantile(F.count("*")).alias("quantile"))
    else:
        at = effects.select(*KEYS).distinct().withColumn("quantile", F.lit(float(quantile)))
    levels = quantile_by_key(effects, KEYS, size, at)
    hit = (F.col("padj") < padj) & (size >= F.col("level"))
    if cohen is not None:
        hit = hit & (F.abs("cohen_d") >= cohen)
    return effects.join(levels, list(KEYS)).where(hit).drop("level")


def dbscan_1d(sites: DataFrame, keys: Sequence[str] = KEYS, eps: float = 20, min_points: int = 5, position: str = "position") -> DataFrame:
    """sites with cluster: density clusters along a line, numbered from 0 by position, -1 for noise.

    A core site has min_points sites within eps, itself included; core sites within eps of each other are one cluster;
    other sites within eps of a core go to the earlier cluster. All windows share the partitioning by keys.
    """
    by = Window.partitionBy(*keys)
    x = F.col(position)
    near = by.orderBy(position).rangeBetween(-int(eps), int(eps))
    along = by.orderBy(position)
    s = sites.withColumn("_core", F.count("*").over(near) >= min_points)
    core_at = F.when(F.col("_core"), x)
    s = s.withColumn("_before", F.last(core_at, True).over(along.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_after", F.first(core_at, True).over(along.rowsBetween(1, Window.unboundedFollowing)))
    opens = F.col("_core") & (F.col("_before").isNull() | (x - F.col("_before") > eps))
    s = s.withColumn("_id", F.sum(opens.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    cluster = F.when(F.col("_core"), F.col("_id")).when(x - F.col("_before") <= eps, F.col("_id")).when(F.col("_after") - x <= eps, F.col("_id") + 1).otherwise(-1)
    return s.withColumn("cluster", cluster.cast("int")).drop("_core", "_before", "_after", "_id")


def cluster_scores(clustered: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row for each cluster: its extent, mean of the ten largest |log2FC| and p strengths, mean spacing, total score and direction.

    A padj of 0 has infinite strength.
    """
    by = Window.partitionBy(*keys, "cluster")
    strength = F.when(F.col("padj") == 0, F.lit(float("inf"))).otherwise(-F.log10("padj"))
    gap = F.col("position") - F.lag("position").over(by.orderBy("position"))
    s = clustered.where("cluster >= 0").withColumns({"_f": F.abs("log2FC"), "_p": strength, "_gap": F.when(gap > 0, gap)})
    s = s.withColumns({"_rf": F.row_number().over(by.orderBy(F.col("_f").desc(), "position")), "_rp": F.row_number().over(by.orderBy(F.col("_p").desc(), "position"))})
    out = s.groupBy(*keys, F.col("cluster").alias("cluster_id")).agg(
        F.count("*").alias("n_points"),
        F.median("position").cast("long").alias("center_position"),
        F.min("position").alias("start_position"),
        F.max("position").alias("end_position"),
        F.avg(F.when(F.col("_rf") <= 10, F.col("_f"))).alias("mean_abs_log2FC_top10"),
        F.avg(F.when(F.col("_rp") <= 10, F.col("_p"))).alias("mean_p_strength_top10"),
        F.avg("_gap").alias("_spacing"),
        F.when(F.avg("log2FC") > 0, "up").otherwise("down").alias("direction"),
    )
    spacing = F.when(F.col("n_points") == 1, 1.0).otherwise(F.coalesce("_spacing", F.lit(0.1)))
    out = out.withColumn("mean_spacing", spacing).drop("_spacing")
    score = F.ln("n_points") + F.ln(100 / (F.col("mean_spacing") + 1e-9)) + 30 * F.col("mean_abs_log2FC_top10") + 0.5 * F.col("mean_p_strength_top10")
    return out.withColumn("total_score", score)


def top_clusters(scores: DataFrame, n: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """The n clusters with the highest score of each key, with place; ties by id."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("total_score").desc(), "cluster_id"))
    return scores.withColumn("place", place).where(F.col("place") <= n)


def run_summary(effects: DataFrame, sites: DataFrame, scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each gene, haplotype and pair: status, significant sites, clusters and top score; pairs without data are listed too."""
    every = effects.select("gene", "hap").distinct().select("*", F.explode(listed(pairs, "groupA", "groupB")).alias("p")).select("gene", "hap", "p.groupA", "p.groupB")
    count = lambda df, name, *more: df.groupBy(*KEYS).agg(F.count("*").alias(name), *more)
    out = every.join(count(effects, "rows"), list(KEYS), "left").join(count(sites, "n_significant"), list(KEYS), "left").join(count(scores, "n_clusters", F.max("total_score").alias("top_score")), list(KEYS), "left")
    status = F.when(F.col("rows").isNull() | F.col("n_significant").isNull(), "skipped_no_data").when(F.col("n_clusters").isNull(), "skipped_no_clusters").otherwise("success")
    return out.withColumn("status", status).fillna(0, ["n_significant", "n_clusters"]).select(*KEYS, "status", "n_significant", "n_clusters", "top_score")


def sites_without_cluster(clustered: DataFrame) -> DataFrame:
    """Significant sites that are noise."""
    return clustered.where("cluster = -1")


def haplotype_traces(traces: DataFrame, clustered: DataFrame) -> DataFrame:
    """Both haplotypes side by side at each position of either: (gene, groupA, groupB, position, log2FC, highlighted and cluster of each)."""
    t = traces.join(clustered.select(*KEYS, "position", "cluster"), [*KEYS, "position"], "left").fillna(-1, ["cluster"])
    side = lambda h: t.where(F.col("hap") == h).select("gene", "groupA", "groupB", "position", *(F.col(c).alias(f"{h}_{c}") for c in ("log2FC", "highlighted", "cluster")))
    return side("hap1").join(side("hap2"), ["gene", "groupA", "groupB", "position"], "full_outer")


def scaled_features(sites: DataFrame, keys: Sequence[str] = KEYS, weights: Sequence[float] = (1.0, 0.5, 0.3)) -> DataFrame:
    """sites with x, y, z: position, p strength and |log2FC| standardised within keys (population deviation, 1 where it is 0) and weighted."""
    by = Window.partitionBy(*keys)
    raw = (F.col("position").cast("double"), -F.log10(F.col("padj") + 1e-100), F.abs("log2FC"))

    def scaled(x: Column, w: float) -> Column:
        spread = F.stddev_pop(x).over(by)
        return w * (x - F.avg(x).over(by)) / F.when(spread > 0, spread).otherwise(1.0)

    return sites.withColumns({n: scaled(x, w) for n, x, w in zip("xyz", raw, weights, strict=True)})


def kth_neighbor_eps(sites: DataFrame, keys: Sequence[str] = KEYS, k: int = 5, percentile: float = 90.0, position: str = "position") -> DataFrame:
    """(keys, eps): percentile of the distances of sites to the k-th nearest on the line, itself counted as the first; null for fewer than k sites."""
    along = Window.partitionBy(*keys).orderBy(position)
    # The k nearest are neighbours in order: of the windows of k sites around one, the nearest farther end counts.
    reach = [F.greatest(F.lead(position, hi).over(along) - F.col(position), F.col(position) - F.lag(position, k - 1 - hi).over(along)) if 0 < hi < k - 1 else None for hi in range(k)]
    ends = [F.col(position) - F.lag(position, k - 1).over(along), F.lead(position, k - 1).over(along) - F.col(position)]
    complete = [F.when(F.lag(position, k - 1 - hi).over(along).isNotNull() & F.lead(position, hi).over(along).isNotNull(), r) for hi, r in enumerate(reach) if r is not None]
    d = F.least(*ends, *complete) if k > 1 else F.lit(0)
    return sites.select(*keys, d.alias("d")).groupBy(*keys).agg(F.percentile("d", F.lit(percentile / 100)).alias("eps"))


def dbscan_weighted(sites: DataFrame, keys: Sequence[str] = KEYS, eps: float | None = None, eps_percentile: float = 90.0, min_points: int = 5) -> DataFrame:
    """(keys, position, cluster) of density clusters over scaled_features(); without eps it is the percentile of the distances to the min_points-th neighbour. See density_clusters()."""
    keys = list(keys)
    featured = written(scaled_features(sites, keys).select(*keys, "position", "x", "y", "z"), "features")
    if eps is None:
        within = kth_eps(featured, keys, min_points, eps_percentile)
    else:
        within = featured.select(*keys).distinct().withColumn("eps", F.lit(float(eps)))
    return density_clusters(featured, keys, within, min_points)
