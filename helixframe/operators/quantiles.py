"""Exact quantiles by key, for a quantile that is a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.sources.scratch import written

#: Buckets of a histogram, and values of one key that are put in order in one row.
BUCKETS, HELD = 4096, 1024


def _bucket(x: Column, low: Column, high: Column) -> Column:
    """A bucket number that never falls as x rises: equal parts of low to high, or, where these are far apart, of the logarithm."""
    size = F.greatest(F.abs("low"), F.abs("high"))
    # A range of both signs or of several magnitudes is cut by sign and exponent, else by value.
    wide = (low * high <= 0) | (F.least(F.abs(low), F.abs(high)) * 4 < size) | F.isnan(high) | (size == float("inf"))
    scale = F.log2(F.greatest(F.abs(x), F.lit(2.0**-1074))) + 1074
    by_size = F.when(F.isnan(x), BUCKETS - 1).when(F.abs(x) == float("inf"), F.signum(x) * (BUCKETS // 2 - 2)).otherwise(F.signum(x) * F.floor(scale * ((BUCKETS // 2 - 4) / 2100.0)))
    by_value = F.floor((x - low) / (high - low) * (BUCKETS - 1))
    return F.when(wide, by_size).otherwise(by_value).cast("int")


def quantile_by_key(df: DataFrame, keys: Sequence[str], value: Column, at: DataFrame, held: int = HELD) -> DataFrame:
    """(keys, level): of each key the value at its quantile, with linear interpolation between the two next to it.

    at: (some of keys, quantile); keys with a null quantile or one beyond 0 to 1, or without values, have no row. Null values
    don't count; NaN is above all others. Where a key has more than held values, histograms over all rows narrow the range of the
    lower of the two values, until it holds no more than that, or a single value; so rows of one key are summed in many
    tasks, and no row grows with them. Each round writes a row a key to the shared folder.
    """
    keys = list(keys)
    x = df.select(*keys, value.cast("double").alias("x")).where(F.col("x").isNotNull())
    place = F.col("quantile") * (F.col("n") - 1)
    state = x.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).join(at, [c for c in keys if c in at.columns])
    state = state.where("quantile BETWEEN 0 AND 1").select(*keys, place.alias("place"), F.floor(place).alias("rank"), "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    state = written(state, "quantile-ranges")
    open_ = (F.col("low") < F.col("high")) & (F.col("inside") > held)
    while state.where(open_).limit(1).count():
        hist = x.join(state.where(open_), keys).where(F.col("x").between(F.col("low"), F.col("high"))).groupBy(*keys, "rank", "below", "place", _bucket(F.col("x"), F.col("low"), F.col("high")).alias("bucket")).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket"))  # at most BUCKETS rows a key
        found = hist.withColumn("upto", F.col("below") + upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        fresh = found.select(*keys, "place", "rank", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("upto") - F.col("n")).alias("below"), F.col("n").alias("inside"))
        state = written(fresh.unionByName(state.where(~open_)), "quantile-ranges")
    inside = F.when((F.col("low") < F.col("high")) & F.col("x").between(F.col("low"), F.col("high")), F.col("x"))
    last = x.join(state, keys).groupBy(*keys, "place", "rank", "low", "below", "inside").agg(F.array_sort(F.collect_list(inside)).alias("all"), F.min(F.when(F.col("x") > F.col("high"), F.col("x"))).alias("next"))
    i = (F.col("rank") - F.col("below")).cast("int")
    lower = F.coalesce(F.try_element_at("all", i + 1), F.col("low"))
    upper = F.coalesce(F.when(F.size("all") > 0, F.try_element_at("all", i + 2)).when(i + 1 < F.col("inside"), F.col("low")), F.col("next"), lower)
    beyond = F.col("place") - F.col("rank")
    return last.select(*keys, F.when((beyond == 0) | (lower == upper), lower).otherwise(lower + beyond * (upper - lower)).alias("level"))
