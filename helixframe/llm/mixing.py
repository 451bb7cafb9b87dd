"""Mixing sources to target weights by hash-threshold histograms.

Each source is cut at a hash threshold, so that the rows below it hold the words that the source owes. The threshold is
found without sorting rows: sizes are summed by (source, hash bucket), the bucket in which the running sum passes the
budget is opened and summed by the next bits of the hash, and so on; only histograms meet in a window.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.storage import documents, materialize

#: A word: a run of anything but space and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of one histogram level, and the levels.
DIGITS, LEVELS = 3, 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def hash_bits(key: Column) -> Column:
    """DIGITS * LEVELS * 4 bits of the key's MD5 as a long; a null key counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS * LEVELS), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets of sources by water filling.

    sizes: one row (source, source_size) per source. Sources in order of code points, null last, take the weights in
    turn. share times the sum of all sizes is dealt by weight; a source stops at cap times its own size, and its excess
    is dealt to the others by weight, until none is above. Returns (source, source_size, target). An empty table gives
    none; sources without words get 0. The windows run over one row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, map(float, weights))), (rank % len(weights) + 1).cast("int")).alias("w"))
    by_room = Window.orderBy((cap * F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, onward = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    everything = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = weighed.select(
        "source",
        "source_size",
        "w",
        F.row_number().over(by_room).alias("place"),
        ((share * F.sum("source_size").over(everything) - F.coalesce(cap * F.sum("source_size").over(before), F.lit(0.0))) / F.sum("w").over(onward)).alias("level"),
    )
    # From the first source with room for its part on, nobody is above the cap at that level.
    roomy = F.when(F.col("level") * F.col("w") <= cap * F.col("source_size"), F.struct("place", "level"))
    return filled.select("source", "source_size", F.least(cap * F.col("source_size"), F.min(roomy).over(everything)["level"] * F.col("w")).alias("target"))


def hash_thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """The hash below which a source's rows sum up to its budget at most.

    sized: (source, size, h); budgets: (source, budget), 0 <= budget < the source's sum. Returns (source, cut): rows with
    h < cut are within the budget; what is missing is less than the rows of one hash value. Rows with one hash value stay
    together. Each level keeps at most 16 ** DIGITS sums a source.
    """
    width = 16**DIGITS
    found = budgets.select("source", F.lit(0).cast("long").alias("prefix"), F.col("budget").cast("double").alias("left"))
    for level in range(1, LEVELS + 1):
        here = F.shiftright("h", 4 * DIGITS * (LEVELS - level))
        sums = (
            sized.select(F.col("source").alias("s"), F.shiftright("h", 4 * DIGITS * (LEVELS - level + 1)).alias("p"), here.alias("bucket"), "size")
            .groupBy("s", "p", "bucket")
            .agg(F.sum("size").alias("held"))
            .join(found, F.col("s").eqNullSafe(F.col("source")) & (F.col("p") == F.col("prefix")))
        )
        upto = F.sum("held").over(Window.partitionBy("source").orderBy("bucket"))
        passed = sums.select("source", "bucket", "left", "prefix", "held", upto.alias("upto")).where(F.col("upto") > F.col("left"))
        first = F.min(F.struct("bucket", (F.col("left") - F.col("upto") + F.col("held")).alias("left")))
        found = passed.groupBy("source").agg(first.alias("x")).select("source", F.col("x.bucket").alias("prefix"), F.col("x.left").alias("left"))
    assert width ** LEVELS < 2**62
    return found.select("source", F.col("prefix").alias("cut"))


#: Up to so many sources, the plan of a mix is sent to all executors instead of moving the rows to it.
FEW_SOURCES = 50_000


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, added: tuple[str, str, str, str] = ("mix_size", "source_size", "target", "times")) -> DataFrame:
    """docs with what each row gives to a mix of all sources.

    Adds four columns, named added: mix_size (the row's number of words), source_size, target (its source's, see
    source_targets) and times: how often the mix takes the row, that is the number of whole passes over the source, and once more for rows below the source's
    hash threshold. Null texts have no words; null sources are a source; repeated ids are taken or left together; columns
    of these names are replaced, all others are kept, whatever their names. The same rows give the same mix in any order and partitioning.
    """
    rows = docs.drop(*added)
    size, h = word_count(F.col(text_col)), hash_bits(F.col(id_col))
    sized = materialize(rows.select(F.col(source_col).alias("source"), size.alias("size"), h.alias("h")), "mix-sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = materialize(targets.withColumn("passes", passes.cast("long")), "mix-targets")
    open_ones = targets.where(F.col("target") > F.col("passes") * F.col("source_size"))
    cuts = hash_thresholds(sized, open_ones.select("source", (F.col("target") - F.col("passes") * F.col("source_size")).alias("budget")))
    own = {c: f"{c}_{uuid.uuid4().hex}" for c in ("source", "source_size", "target", "passes", "cut")}
    plan = targets.join(cuts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "passes", "cut").withColumnsRenamed(own)
    plan = materialize(plan, "mix-plan")
    if plan.count() <= FEW_SOURCES:
        plan = F.broadcast(plan)
    times = (F.col(own["passes"]) + F.when(h < F.col(own["cut"]), 1).otherwise(0)).cast("int")
    joined = rows.join(plan, F.col(source_col).eqNullSafe(F.col(own["source"])))
    return joined.select(*rows.columns, size.alias(added[0]), F.col(own["source_size"]).alias(added[1]), F.col(own["target"]).alias(added[2]), times.alias(added[3]))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; see mix_sources() for nulls, ties and repeated rows."""
    mixed = mix_sources(documents(spark, sf_dir))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", (F.col("mix_size") * F.col("times")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS BIGINT) AS h
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM s
), f AS (
  SELECT *, row_number() OVER o AS place,
    (1.5 * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(2.0 * CAST(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0.0))
      / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w ASC, source ASC NULLS LAST)
), l AS (SELECT min_by(level, place) AS level FROM f WHERE level * w <= 2.0::DOUBLE * source_size
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, l.level * w) AS target FROM f, l
), p AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS passes FROM t
), r AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.passes,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS upto
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (passes + CASE WHEN upto <= target - passes * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
