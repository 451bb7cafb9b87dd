"""Seventeen distribution metrics of each haplotype's scores, and their tests between cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.ranks import bh_adjust, mann_whitney

#: Fixed names and order of the metrics.
METRICS = ("mean", "max", "std", "cv", "median", "mode", "iqr", "skewness", "kurtosis", "top5_percent_mean", "low5_percent_mean", "percentile_90", "percentile_10", "peak_count", "peak_density", "peak_mean", "shannon_entropy")
KEYS = ("gene", "hap", "sample")


def seventeen_metrics(attention: DataFrame, roster: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row of 17 metrics for each key of attention (keys, position, score); null scores don't count.

    roster: (keys) of all haplotypes; those without any score get 0 peaks, density and entropy and nulls else. All windows
    and aggregates share the partitioning by keys, so the scores are shuffled once. Sums run along the positions: keys with
    equal scores get equal metrics to the last digit, so that they tie in tests.
    """
    by_key = Window.partitionBy(*keys)
    along, by_score = by_key.orderBy("position"), by_key.orderBy("score", "position")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x, tail = F.col("score"), F.greatest(F.lit(1), F.floor(0.05 * F.count("*").over(by_key)))
    begins = F.lag("score").over(along).isNull() | (F.lag("score").over(along) != x)
    marked = attention.where(x.isNotNull()).select(
        *keys,
        "position",
        "score",
        F.avg("score").over(whole).alias("mean"),
        F.row_number().over(by_score).alias("up"),
        F.count("*").over(by_key).alias("n"),
        tail.alias("tail"),
        F.when(begins, F.struct(F.lag("score").over(along).alias("before"))).alias("opened"),
        F.lead("score").over(along).alias("after"),
    )
    # A run of equal scores ends where the next is another; the score before the run was noted where it began.
    before = F.last("opened", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))["before"]
    peak = (F.col("after") < x) & (before < x) & (x >= F.col("mean"))
    marked = marked.withColumn("peak", F.coalesce(peak, F.lit(False)))
    positive = F.when(x > 0, x)
    sums = {
        "std": F.stddev_samp("score"),
        "skewness": F.skewness("score"),
        "kurtosis": F.kurtosis("score"),
        "top5_percent_mean": F.avg(F.when(F.col("up") > F.col("n") - F.col("tail"), x)),
        "low5_percent_mean": F.avg(F.when(F.col("up") <= F.col("tail"), x)),
        "peak_mean": F.avg(F.when(F.col("peak"), x)),
        "_s": F.sum(positive),
        "_sl": F.sum(positive * F.ln(positive)),
    }
    marked = marked.select(*keys, "score", "peak", "mean", *(s.over(whole).alias(name) for name, s in sums.items()))
    q = F.percentile("score", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9))))
    out = marked.groupBy(*keys).agg(
        *(F.first(name).alias(name) for name in ("mean", *sums)),
        F.max("score").alias("max"),
        q.alias("_q"),
        F.mode("score", True).alias("mode"),
        F.count_if("peak").alias("peak_count"),
        F.count("*").alias("_n"),
    )
    c = F.col
    at = lambda i: c("_q")[i]
    made = {
        "cv": F.try_divide("std", "mean"),
        "median": at(2),
        "iqr": at(3) - at(1),
        "percentile_90": at(4),
        "percentile_10": at(0),
        "peak_density": c("peak_count") / c("_n"),
        "shannon_entropy": F.coalesce(F.ln("_s") - c("_sl") / c("_s"), F.lit(0.0)),
        "peak_count": c("peak_count").cast("double"),
    }
    out = out.select(*keys, *(made.get(m, c(m)).alias(m) for m in METRICS))
    if roster is not None:
        out = roster.select(*keys).distinct().join(out, list(keys), "left").fillna(0.0, ["peak_count", "peak_density", "shannon_entropy"])
    return out


def with_group(metrics: DataFrame, samples: DataFrame) -> DataFrame:
    """metrics with group: control for sample_type 0, case for 2, null for other or missing types; samples (sample, sample_type)."""
    group = F.when(F.col("sample_type") == 0, "control").when(F.col("sample_type") == 2, "case")
    return metrics.join(samples.select("sample", group.alias("group")), "sample", "left")


def unpivot_metrics(metrics: DataFrame, keys: Sequence[str] = ("gene", "hap", "sample", "group")) -> DataFrame:
    """(keys, metric, value)."""
    return metrics.unpivot(list(keys), list(METRICS), "metric", "value")


def gene_tests(metrics: DataFrame, hap: str = "hap1", alpha: float = 0.05) -> DataFrame:
    """(gene, metric, p, p_corrected, significant) of case against control for each gene and metric, corrected over genes.

    A gene without values in a group has a null p; it stays null and is not significant.
    """
    long = unpivot_metrics(metrics.where(F.col("hap") == hap)).where("group IS NOT NULL")
    tested = mann_whitney(long, ["gene", "metric"], "value", F.col("group") == "case")
    every = metrics.where(F.col("hap") == hap).select("gene").distinct().select("gene", F.explode(F.array(*map(F.lit, METRICS))).alias("metric"))
    p = every.join(tested.select("gene", "metric", F.col("pvalue").alias("p")), ["gene", "metric"], "left")
    return bh_adjust(p, ["metric"], "p", "p_corrected").withColumn("significant", F.coalesce(F.col("p_corrected") <= alpha, F.lit(False)))


def pvalue_table(tests: DataFrame) -> DataFrame:
    """One row of 52 columns a gene, sorted by std_p: gene, then p, corrected p and significance of each metric."""
    wide = tests.groupBy("gene").pivot("metric", list(METRICS)).agg(F.first("p").alias("p"), F.first("p_corrected").alias("p_corrected"), F.first("significant").alias("significant"))
    return wide.select("gene", *(f"{m}_p" for m in METRICS), *(c for m in METRICS for c in (f"{m}_p_corrected", f"{m}_significant"))).orderBy(F.col("std_p").asc_nulls_last(), "gene")


def significant_counts(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """By metric: genes with p below alpha, rejected genes, and genes with a corrected p below alpha."""
    return tests.groupBy("metric").agg(F.count_if(F.col("p") < alpha).alias("raw"), F.count_if("significant").alias("corrected"), F.count_if(F.col("p_corrected") < alpha).alias("below"))


def top_genes(tests: DataFrame, n: int = 10, metric: str = "std") -> DataFrame:
    """The n genes with the least p of a metric; ties by name."""
    return tests.where((F.col("metric") == metric) & F.col("p").isNotNull()).orderBy("p", "gene").limit(n)


def significant_genes(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """By metric, genes with a corrected p below alpha: (metric, gene, p_corrected, strength, place), strongest first; a p of 0 is infinitely strong."""
    place = F.row_number().over(Window.partitionBy("metric").orderBy("p_corrected", "gene"))
    strength = F.when(F.col("p_corrected") == 0, F.lit(float("inf"))).otherwise(-F.log10("p_corrected"))
    return tests.where(F.col("p_corrected") < alpha).select("metric", "gene", "p_corrected", strength.alias("strength"), place.alias("place"))


def group_metric_table(metrics: DataFrame, tests: DataFrame, gene: str, hap: str = "hap1") -> DataFrame:
    """Box-plot table of one gene: (metric, group, n, low, q1, mid, q3, high, p, stars)."""
    long = unpivot_metrics(metrics.where((F.col("hap") == hap) & (F.col("gene") == gene))).where("group IS NOT NULL")
    q = F.percentile("value", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    box = long.groupBy("metric", "group").agg(F.count("value").alias("n"), q.alias("q"))
    stars = F.when(F.col("p") < 0.001, "***").when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise("ns")
    p = tests.where(F.col("gene") == gene).select("metric", "p", stars.alias("stars"))
    return box.join(p, "metric").select("metric", "group", "n", *(F.col("q")[i].alias(c) for i, c in enumerate(("low", "q1", "mid", "q3", "high"))), "p", "stars")
