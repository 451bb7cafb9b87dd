"""Rank statistics of two sides by key: the ladder of distinct values, the U test and false discovery rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.pvalues import EXACT, erfc, exact_u_test, u_erfc_argument
from helixframe.sources.scratch import written


def rank_ladder(df: DataFrame, keys: Sequence[str], value: str, is_a: Column) -> DataFrame:
    """For each key and distinct value the counts a and b of both sides, with running sums, totals and the next value.

    Rows are counted before they meet in a window, so a key's window holds its distinct values. Null values and rows whose
    side is null are left out.
    """
    return counts_ladder(df.where(F.col(value).isNotNull() & is_a.isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count_if(is_a).alias("a"), F.count_if(~is_a).alias("b")), keys)


def counts_ladder(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rank_ladder() from counts (keys, value, a, b, ...), one row a value; rows of none on either side change nothing."""
    up = Window.partitionBy(*keys).orderBy("value")
    whole = Window.partitionBy(*keys)
    return counts.select("*", F.sum("a").over(up).alias("cum_a"), F.sum("b").over(up).alias("cum_b"), F.sum("a").over(whole).alias("n_a"), F.sum("b").over(whole).alias("n_b"), F.lead("value").over(up).alias("next_value"))


def rank_statistics(ladder: DataFrame, keys: Sequence[str], more: Sequence[Column] = ()) -> DataFrame:
    """(keys, n_a, n_b, u_a, ties, auc, wasserstein) of a ladder, and more aggregates; auc and wasserstein are null if a side is empty."""
    t = F.col("a") + F.col("b")
    gap = F.abs(F.try_divide("cum_a", "n_a") - F.try_divide("cum_b", "n_b")) * (F.col("next_value") - F.col("value"))
    out = ladder.groupBy(*keys).agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.sum(F.col("a") * (F.col("cum_b") - F.col("b") / 2)).alias("u_a"), F.sum((t * t * t - t).cast("double")).alias("ties"), F.sum(gap).alias("w"), *more)
    both = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    rest = out.columns[len(keys) + 5 :]
    return out.select(*keys, *rest, "n_a", "n_b", "u_a", "ties", F.when(both, F.col("u_a") / (F.col("n_a") * F.col("n_b"))).alias("auc"), F.when(both, F.coalesce("w", F.lit(0.0))).alias("wasserstein"))


def u_test(stats: DataFrame, min_n: int, u: str = "u_a", n_a: str = "n_a", n_b: str = "n_b", ties: str = "ties") -> DataFrame:
    """stats with pvalue, the two-sided Mann-Whitney p; null where a side has fewer than min_n values.

    Exact if a group has at most EXACT values and nothing ties, else normal. Where min_n leaves no small groups all is column
    arithmetic; else stats are written, and only rows with small groups go to an exact test.
    """
    enough = (F.col(n_a) >= min_n) & (F.col(n_b) >= min_n)
    normal = lambda df: df.withColumn("_x", F.when(enough, u_erfc_argument(F.col(u), F.col(n_a), F.col(n_b), F.col(ties)))).withColumn("pvalue", erfc(F.col("_x"))).drop("_x")
    if min_n > EXACT:
        return normal(stats)
    s = written(stats, "rank-statistics")
    small = F.coalesce(enough & (F.least(n_a, n_b) <= EXACT) & (F.least(n_a, n_b) > 0) & (F.col(ties) == 0), F.lit(False))
    out = normal(s.where(~small))
    if s.where(small).limit(1).count():
        out = out.unionByName(s.where(small).withColumn("pvalue", exact_u_test(u, n_a, n_b)))
    return out


def mann_whitney(df: DataFrame, keys: Sequence[str], value: str, is_a: Column, min_n: int = 1) -> DataFrame:
    """Two-sided U test of a side against the other by key: rank_statistics() with pvalue, see u_test()."""
    return u_test(rank_statistics(rank_ladder(df, keys, value, is_a), keys), min_n)


def bh_adjust(df: DataFrame, keys: Sequence[str], p: str = "pvalue", out: str = "padj") -> DataFrame:
    """Benjamini-Hochberg values of p within keys, in a new column; null p values stay null and don't count."""
    tested = F.col(p).isNotNull()
    within = Window.partitionBy(*keys, tested)
    rank = F.row_number().over(within.orderBy(p))
    raw = df.withColumn("_q", F.when(tested, F.col(p) * F.count(p).over(within) / rank)).withColumn("_rank", rank)
    down = within.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn(out, F.when(tested, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.min("_q").over(down))))).drop("_q", "_rank")
