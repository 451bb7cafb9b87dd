"""Scores and clusters held against known variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.operators.base import listed
from helixframe.operators.ranks import rank_ladder
from helixframe.sources.scratch import written

KEYS = ("gene", "hap", "groupA", "groupB")


def truth_neighbours(positions: DataFrame, truth: DataFrame, keys: Sequence[str] = ("gene",)) -> DataFrame:
    """(keys, position, before, after): for each position once the nearest known variants (keys, pos) up to it and from it on, null without any.

    An as-of join both ways, as windows over the union of positions and variants, so rows are as many as these.
    """
    sites = positions.select(*keys, "position").distinct()
    both = sites.select(*keys, "position", F.lit(None).cast("long").alias("t")).unionByName(truth.select(*keys, F.col("pos").alias("position"), F.col("pos").cast("long").alias("t")))
    along = Window.partitionBy(*keys).orderBy("position")
    before = F.last("t", True).over(along.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("t", True).over(along.rangeBetween(0, Window.unboundedFollowing))
    return both.select(*keys, "position", "t", before.alias("before"), after.alias("after")).where("t IS NULL").drop("t")


def _within(left: str = "left_bp", right: str = "right_bp") -> Column:
    """Whether a position with its truth_neighbours() is in the window of any variant: overlapping windows merge by themselves, as the nearest variants decide."""
    return F.coalesce(F.col("position") - F.col("before") <= F.col(right), F.lit(False)) | F.coalesce(F.col("after") - F.col("position") <= F.col(left), F.lit(False))


def _distance() -> Column:
    return F.coalesce(F.least(F.col("position") - F.col("before"), F.col("after") - F.col("position")).cast("double"), F.lit(float("inf")))


def _each_window(windows: DataFrame) -> Column:
    if windows.where("left_bp < 0 OR right_bp < 0").limit(1).count():
        raise ValueError("windows hold their variant: left_bp and right_bp must not be negative")
    return F.explode(listed(windows, "left_bp", "right_bp")).alias("w")


def truth_windows(positions: DataFrame, truth: DataFrame, windows: DataFrame) -> DataFrame:
    """positions (any keys with gene and position) for each window (left_bp, right_bp), with is_true: within [t - left_bp, t + right_bp] of a known variant t (gene, pos) of the gene.

    However wide windows are, a position is looked up once; null positions are in none.
    """
    met = positions.join(truth_neighbours(positions, truth), ["gene", "position"], "left").select("*", _each_window(windows))
    return met.select(*positions.columns, "before", "after", "w.left_bp", "w.right_bp").withColumn("is_true", _within()).drop("before", "after")


def nearest_truth(positions: DataFrame, truth: DataFrame, keys: Sequence[str] = ("gene",)) -> DataFrame:
    """positions with distance to the nearest known variant of the gene, infinite without any."""
    return positions.join(truth_neighbours(positions, truth, keys).select(*keys, "position", _distance().alias("distance")), [*keys, "position"])


def signal_scores(trace: DataFrame, truth: DataFrame, windows: DataFrame) -> DataFrame:
    """trace (keys, position, log2FC) for each window, with is_true, distance and signal (|log2FC|, 0 where null): one join for all windows."""
    near = trace.join(truth_neighbours(trace, truth), ["gene", "position"]).withColumns({"distance": _distance(), "signal": F.coalesce(F.abs("log2FC"), F.lit(0.0))})
    kept = [*trace.columns, "distance", "signal"]
    return near.select(*kept, "before", "after", _each_window(windows)).select(*kept, "before", "after", "w.left_bp", "w.right_bp").withColumn("is_true", _within()).drop("before", "after")


def evaluation(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """One row for each key and window: concentration of the signal, plain and normalised by length, ROC AUC, average precision, precision at k and mean rank.

    Ratios over nothing are null; FRiW is 0 without signal. Ties of the signal in ranks and the top k are broken by
    position, the later first. Cohen's d pools population deviations.
    """
    keys = [*KEYS, "left_bp", "right_bp"]
    t, s = F.col("is_true"), F.col("signal")
    by = Window.partitionBy(*keys)
    down = F.row_number().over(by.orderBy(F.col("signal").desc(), F.col("position").desc()))
    ranked = scored.withColumns({"_down": down, "_n": F.count("*").over(by), "_k": F.count_if("is_true").over(by)})
    rank = (F.col("_n") - F.col("_down")) / F.nullif(F.col("_n") - 1, F.lit(0))
    sums = ranked.groupBy(*keys).agg(
        F.count_if(t).alias("pos_n"),
        F.count_if(~t).alias("neg_n"),
        F.avg(F.when(t, s)).alias("m1"),
        F.avg(F.when(~t, s)).alias("m0"),
        F.stddev_pop(F.when(t, s)).alias("d1"),
        F.stddev_pop(F.when(~t, s)).alias("d0"),
        F.sum(s).alias("total"),
        F.sum(F.when(t, s)).alias("inside"),
        F.sum(s * F.col("distance")).alias("moment"),
        (F.max("position") - F.min("position") + 1).alias("Seq_Length"),
        F.avg(F.when(F.col("_down") <= F.col("_k"), t.cast("double"))).alias("Precision_at_K"),
        F.avg(F.when(t, F.coalesce(rank, F.lit(0.0)))).alias("Mean_Rank_True"),
    )
    n_var = truth.groupBy("gene").agg(F.count("*").alias("N_Variants"))
    c = F.col
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    n = c("pos_n") + c("neg_n")
    friw = F.when(c("total") > 0, zero(c("inside")) / c("total")).otherwise(0.0)
    share = c("pos_n") / n
    away = F.when(c("total") > 0, c("moment") / c("total"))
    usual = F.when(c("N_Variants") > 0, c("Seq_Length") / (2 * c("N_Variants"))).otherwise(c("Seq_Length"))
    d1, d0 = F.when(c("pos_n") > 1, c("d1")).otherwise(0.0), F.when(c("neg_n") > 1, c("d0")).otherwise(0.0)
    pooled = F.sqrt(((c("pos_n") - 1) * d1**2 + (c("neg_n") - 1) * d0**2) / F.when(n > 2, n - 2))
    m1, m0 = zero(c("m1")), zero(c("m0"))
    out = sums.join(n_var, "gene", "left").fillna(0, ["N_Variants"]).select(
        *keys,
        c("pos_n").alias("Positive_Base_Count"),
        m1.alias("Mean_Signal_True"),
        m0.alias("Mean_Signal_Background"),
        F.when(m0 > 0, m1 / m0).alias("SNR"),
        friw.alias("FRiW"),
        away.alias("Weighted_Dist"),
        share.alias("Expected_FRiW"),
        F.when(share > 0, friw / share).alias("FRiW_Enrichment"),
        (away / usual).alias("Normalized_Weighted_Dist"),
        F.when(pooled > 0, (m1 - m0) / pooled).alias("Cohens_d"),
        "Precision_at_K",
        "Mean_Rank_True",
        "Seq_Length",
        "N_Variants",
    )
    return out.join(auc_ap(scored, keys), keys, "left")


def auc_ap(scored: DataFrame, keys: Sequence[str], value: str = "signal") -> DataFrame:
    """(keys, AUC, AUPRC): ROC AUC with ties halved, and step-wise average precision over distinct values; null with one class only."""
    keys = list(keys)
    ladder = rank_ladder(scored, keys, value, F.col("is_true"))
    # From the highest value down, true and false ones so far.
    tp = F.col("n_a") - F.col("cum_a") + F.col("a")
    fp = F.col("n_b") - F.col("cum_b") + F.col("b")
    out = ladder.groupBy(*keys).agg(F.sum(F.col("a") * (F.col("cum_b") - F.col("b") / 2)).alias("u"), F.sum(F.col("a") * tp / (tp + fp)).alias("steps"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    both = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    return out.select(*keys, F.when(both, F.col("u") / (F.col("n_a") * F.col("n_b"))).alias("AUC"), F.when(both, F.col("steps") / F.col("n_a")).alias("AUPRC"))


def windows_table(spark: SparkSession, rights: Sequence[int] = (3, 5, 10, 20), left: int = 0) -> DataFrame:
    return spark.createDataFrame([(left, r) for r in rights], "left_bp int, right_bp int")


def evaluation_sweep(trace: DataFrame, truth: DataFrame, windows: DataFrame) -> DataFrame:
    """evaluation() of both haplotypes, all pairs and all windows; scores are made once, and written."""
    return evaluation(written(signal_scores(trace, truth, windows), "signal-scores"), truth)


def sites_in_range(trace: DataFrame, sites: DataFrame) -> DataFrame:
    """Known sites (gene, pos, ...) within the first and last position of the gene's trace."""
    ends = trace.groupBy("gene").agg(F.min("position").alias("lo"), F.max("position").alias("hi"))
    return sites.join(ends, "gene").where(F.col("pos").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def kept_clusters(scores: DataFrame, min_points: int | None = None, min_density: float | None = None, score_fraction: float | None = None) -> DataFrame:
    """scores with density (points over span, a span of 0 as 1), filtered by points, density and the top fraction of scores of each key."""
    span = F.greatest(F.col("end_position") - F.col("start_position"), F.lit(1))
    out = scores.withColumn("density", F.col("n_points") / span)
    if score_fraction is not None:
        if not 0 < score_fraction < 1:
            raise ValueError("score_fraction must be between 0 and 1")
        level = out.groupBy(*KEYS).agg(F.percentile("total_score", F.lit(1 - score_fraction)).alias("_level"))
        out = out.join(level, list(KEYS)).where(F.col("total_score") >= F.col("_level")).drop("_level")
    if min_points is not None:
        out = out.where(F.col("n_points") >= min_points)
    return out.where(F.col("density") >= min_density) if min_density is not None else out


def match_clusters(clusters: DataFrame, truth: DataFrame, strand: str = "+", extension: int = 10) -> DataFrame:
    """Clusters and the known variants (gene, pos, ID) in them, extended on the strand's side: one row each, True Positive with the signed distance to the center, or False Positive without any.

    The extended interval is cut in bins of 1000 positions, which meet those of the variants in an equi-join.
    """
    width = 1000
    lo = F.col("start_position") - extension if strand == "+" else F.col("start_position")
    hi = F.col("end_position") if strand == "+" else F.col("end_position") + extension
    c = clusters.withColumns({"match_start": lo, "match_end": hi})
    binned = c.select("gene", *KEYS[1:], "cluster_id", "match_start", "match_end", F.explode(F.sequence(F.floor(F.col("match_start") / width), F.floor(F.col("match_end") / width))).alias("bin"))
    t = truth.select("gene", F.col("pos").alias("truth_position"), F.col("ID").alias("truth_id"), F.floor(F.col("pos") / width).alias("bin"))
    met = binned.join(t, ["gene", "bin"]).where(F.col("truth_position").between(F.col("match_start"), F.col("match_end"))).select(*KEYS, "cluster_id", "truth_position", "truth_id")
    out = c.join(met, [*KEYS, "cluster_id"], "left")
    status = F.when(F.col("truth_id").isNotNull(), "True Positive").otherwise("False Positive")
    return out.withColumns({"match_status": status, "dist_truth_to_cluster_center": F.col("truth_position") - F.col("center_position")})


def missed_truth(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """False Negative rows: (keys, ID, pos) of known variants that no cluster of the key matched, for keys that have clusters."""
    keys = matches.select(*KEYS).distinct()
    found = matches.where("truth_id IS NOT NULL").select(*KEYS, F.col("truth_id").alias("ID")).distinct()
    return keys.join(truth, "gene").join(found, [*KEYS, "ID"], "left_anti").select(*KEYS, "ID", "pos")


def cluster_truth_metrics(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 of clusters for each key that has some."""
    n_ids = truth.groupBy("gene").agg(F.count_distinct("ID").alias("Total_Variants"))
    hit = F.when(F.col("truth_id").isNotNull(), F.col("cluster_id"))
    out = matches.groupBy(*KEYS).agg(F.count_distinct("cluster_id").alias("Total_Clusters"), F.count_distinct(hit).alias("TP_Clusters"), F.count_distinct("truth_id").alias("Found_Variants")).join(n_ids, "gene", "left").fillna(0, ["Total_Variants"])
    precision, recall = F.coalesce(F.try_divide("TP_Clusters", "Total_Clusters"), F.lit(0.0)), F.coalesce(F.try_divide("Found_Variants", "Total_Variants"), F.lit(0.0))
    out = out.withColumns({"Precision": precision, "Recall": recall, "FP_Clusters": F.col("Total_Clusters") - F.col("TP_Clusters"), "Missed_Variants": F.col("Total_Variants") - F.col("Found_Variants")})
    return out.withColumn("F1_Score", F.coalesce(F.try_divide(2 * F.col("Precision") * F.col("Recall"), F.col("Precision") + F.col("Recall")), F.lit(0.0)))
