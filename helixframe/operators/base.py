"""Base-level analysis: effect sizes, differential scores and missing-base enrichment at each position.

Input is the long attention table (gene, hap, sample, position, score) and samples (sample, label) with labels 0 to 3.
Pairs of labels are a small table (groupA, groupB); all genes, haplotypes, positions and pairs go through one job.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions.pvalues import chi2_p, fisher_p
from helixframe.operators.ranks import bh_adjust, counts_ladder, rank_statistics, u_test

SITE = ("gene", "hap", "position")
PAIR = ("groupA", "groupB")


def base_label(sample_type: Column) -> Column:
    """3, 0, 1, 2 become 0, 1, 2, 3; any other type is an error."""
    known = F.create_map(*(F.lit(x) for x in (3, 0, 0, 1, 1, 2, 2, 3)))
    return F.coalesce(F.try_element_at(known, sample_type.cast("int")), F.raise_error(F.concat(F.lit("unknown sample type "), F.coalesce(sample_type.cast("string"), F.lit("null")))))


def parse_pairs(text: str | None) -> list[tuple[int, int]]:
    """'1-2,1vs3' as pairs of labels; nothing gives 1-2, 1-3 and 2-3."""
    if not text:
        return [(1, 2), (1, 3), (2, 3)]
    return [(int(a), int(b)) for a, b in re.findall(r"(\d+)\s*(?:-|vs)\s*(\d+)", text)]


def pair_table(spark: SparkSession, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame(list(pairs), "groupA int, groupB int")


def parse_ignored(text: str | None) -> list[tuple[int, int]]:
    """'s:e,p' as half-open ranges; text that doesn't parse ignores nothing."""
    out = []
    for part in filter(None, (x.strip() for x in (text or "").split(","))):
        if not (m := re.fullmatch(r"(\d+)(?::(\d+))?", part)):
            return []
        out.append((int(m[1]), int(m[2]) if m[2] else int(m[1]) + 1))
    return out


def exclude_positions(df: DataFrame, text: str | None) -> DataFrame:
    """Rows outside of the ranges of parse_ignored()."""
    keep = F.lit(True)
    for a, b in parse_ignored(text):
        keep = keep & ~((F.col("position") >= a) & (F.col("position") < b))
    return df.where(keep)


def known_positions(attention: DataFrame) -> DataFrame:
    """Scores as absolute values, without positions that no hap1 row of the gene has."""
    have = attention.where((F.col("hap") == "hap1") & F.col("score").isNotNull()).select("gene", "position").distinct()
    return attention.join(have, ["gene", "position"], "left_semi").withColumn("score", F.abs("score"))


def site_spine(attention: DataFrame) -> DataFrame:
    """(gene, hap, position): each hap1 position of a gene for each haplotype of the gene, with or without scores."""
    have = attention.where(F.col("hap") == "hap1").select("gene", "position").distinct()
    return have.join(attention.select("gene", "hap").distinct(), "gene").select(*SITE)


def group_stats(attention: DataFrame, samples: DataFrame) -> DataFrame:
    """By position and label: n, mean, std (n - 1), with baseMean over all samples of any label."""
    by_label = attention.join(samples, "sample").where(F.col("score").isNotNull()).groupBy(*SITE, "label").agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.sum("score").alias("total"))
    site = Window.partitionBy(*SITE)
    return by_label.select(*SITE, "label", "n", "mean", "std", (F.sum("total").over(site) / F.sum("n").over(site)).alias("baseMean"))


#: Parameter tables (pairs of labels, windows) have so many rows at most; they become literals of the plan.
MOST_ROWS = 1000


def listed(table: DataFrame, *columns: str) -> Column:
    """The rows of a small parameter table as an array of structs, to be exploded; more than MOST_ROWS raise ValueError."""
    rows = table.select(*columns).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a parameter table has more than {MOST_ROWS} rows")
    kinds = {c: table.schema[c].dataType for c in columns}
    one = F.struct(*(F.lit(None).cast(kinds[c]).alias(c) for c in columns))
    return F.array(*(F.struct(*(F.lit(r[c]).cast(kinds[c]).alias(c) for c in columns)) for r in rows)) if rows else F.slice(F.array(one), 1, 0)


def pair_effects(attention: DataFrame, samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """All numbers of each pair at each position that has any score: (gene, hap, position, groupA, groupB, baseMean, n_A, n_B, mean_A, mean_B, std_A, std_B, u_a, ties, auc, wasserstein).

    Scores are shuffled once, by position. There, equal scores of a label are counted, and the pairs get their sides from
    these counts; ranks, means and deviations follow without another shuffle. A label without scores has n 0.
    """
    rows = attention.where(F.col("score").isNotNull()).join(samples, "sample").select(*SITE, "label", F.col("score").alias("value")).repartition(*SITE)
    site = Window.partitionBy(*SITE)
    counts = rows.groupBy(*SITE, "label", "value").agg(F.count("*").alias("c"))
    counts = counts.select("*", (F.sum(F.col("c") * F.col("value")).over(site) / F.sum("c").over(site)).alias("baseMean"), F.row_number().over(site.orderBy("label", "value")).alias("first"))
    # One row of a position stands for all pairs that have no score there.
    mine = F.filter(listed(pairs, *PAIR), lambda p: (F.col("first") == 1) | (p["groupA"] == F.col("label")) | (p["groupB"] == F.col("label")))
    sided = counts.select("*", F.explode(mine).alias("p")).select(*SITE, "p.groupA", "p.groupB", "label", "value", "c", "baseMean")
    keys = [*SITE, *PAIR]
    side = lambda g: F.sum(F.when(F.col("label") == F.col(g), F.col("c")).otherwise(0))
    ladder = counts_ladder(sided.groupBy(*keys, "value").agg(side("groupA").alias("a"), side("groupB").alias("b"), F.first("baseMean").alias("baseMean")), keys)
    whole = Window.partitionBy(*keys)
    mean = lambda n: F.try_divide(F.sum(F.col(n) * F.col("value")).over(whole), F.col(f"n_{n}"))
    ladder = ladder.withColumns({"mean_a": mean("a"), "mean_b": mean("b")})
    spread = lambda n: F.sqrt(F.sum(F.col(n) * F.pow(F.col("value") - F.col(f"mean_{n}"), F.lit(2))) / F.nullif(F.max(f"n_{n}") - 1, F.lit(0)))
    more = [F.max("baseMean").alias("baseMean"), F.max("mean_a").alias("mean_A"), F.max("mean_b").alias("mean_B"), spread("a").alias("std_A"), spread("b").alias("std_B")]
    out = rank_statistics(ladder, keys, more)
    return out.select(*keys, "baseMean", F.col("n_a").alias("n_A"), F.col("n_b").alias("n_B"), "mean_A", "mean_B", F.when(F.col("n_a") > 1, F.col("std_A")).alias("std_A"), F.when(F.col("n_b") > 1, F.col("std_B")).alias("std_B"), "u_a", "ties", "auc", "wasserstein")


def pair_stats(attention: DataFrame, samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """n, mean and std of both labels of each pair side by side, of pair_effects()."""
    return pair_effects(attention, samples, pairs).drop("u_a", "ties", "auc", "wasserstein")


def log2_fold_change(stats: DataFrame) -> DataFrame:
    """stats with log2FC and delta (B against A). The least mean of a pair over all its positions is shifted above zero if it is not."""
    whole = Window.partitionBy("gene", "hap", *PAIR)
    least = F.least(F.min("mean_A").over(whole), F.min("mean_B").over(whole))
    shift = F.when(least <= 0, -least + 1e-8).otherwise(0.0)
    ratio = (F.col("mean_B") + shift) / (F.col("mean_A") + shift + 1e-8)
    return stats.withColumns({"log2FC": F.log2(ratio), "delta": F.col("mean_B") - F.col("mean_A")})


def _tested(pair: DataFrame, min_n: int) -> DataFrame:
    """pair_effects() with log2FC, delta, pvalue and padj."""
    return bh_adjust(u_test(log2_fold_change(pair), min_n, "u_a", "n_A", "n_B", "ties"), ["gene", "hap", *PAIR])


def _separated(pair: DataFrame, min_n: int) -> DataFrame:
    """pair_effects() with Cliff's delta, Cohen's d and Hedges' g; all its numbers are null where a side has fewer than min_n values."""
    a, b = F.col("n_A"), F.col("n_B")
    pooled = F.sqrt(((a - 1) * F.col("std_A") ** 2 + (b - 1) * F.col("std_B") ** 2) / F.when(a + b > 2, a + b - 2))
    d = F.when(pooled > 0, (F.col("mean_B") - F.col("mean_A")) / pooled)
    out = pair.withColumns({"cliffs_delta": 2 * F.col("auc") - 1, "cohen_d": d}).withColumn("hedges_g", F.when(a + b > 3, F.col("cohen_d") * (1 - 3 / (4 * (a + b) - 9))))
    return out.withColumns({c: F.when((a >= min_n) & (b >= min_n), F.col(c)) for c in SEPARATION})


#: Fixed names and order of the columns of result tables.
SEPARATION = ("mean_A", "mean_B", "std_A", "std_B", "auc", "cliffs_delta", "wasserstein", "cohen_d", "hedges_g")
DIFFERENTIAL = ("gene", "hap", *PAIR, "position", "baseMean", "mean_A", "mean_B", "log2FC", "delta", "nA_nonNA", "nB_nonNA", "pvalue", "padj")


def differential(attention: DataFrame, samples: DataFrame, pairs: DataFrame, min_n: int = 10) -> DataFrame:
    """Differential scores: (gene, hap, groupA, groupB, position, baseMean, mean_A, mean_B, log2FC, delta, nA_nonNA, nB_nonNA, pvalue, padj).

    A pair with fewer than min_n values on a side has no p at that position; padj is over the tested positions of a
    gene, haplotype and pair.
    """
    return _tested(pair_effects(attention, samples, pairs), min_n).withColumnsRenamed({"n_A": "nA_nonNA", "n_B": "nB_nonNA"}).select(*DIFFERENTIAL)


def separability(attention: DataFrame, samples: DataFrame, pairs: DataFrame, min_n: int = 10) -> DataFrame:
    """Effect sizes at each position: AUC (A above B), Cliff's delta, Wasserstein-1, Cohen's d (B less A) and Hedges' g; nulls where a side has fewer than min_n values."""
    return _separated(pair_effects(attention, samples, pairs), min_n).select("gene", "hap", "position", *PAIR, "n_A", "n_B", *SEPARATION)


def effects(attention: DataFrame, samples: DataFrame, pairs: DataFrame, min_n: int = 10) -> DataFrame:
    """What join_effect_sizes() gives for differential() and separability(), from one pair_effects()."""
    tested = _tested(pair_effects(attention, samples, pairs), min_n)
    kept = tested.withColumns({"kept_A": F.col("mean_A"), "kept_B": F.col("mean_B")})
    out = _separated(kept, min_n).withColumns({"mean_A": F.col("kept_A"), "mean_B": F.col("kept_B")})
    return out.withColumnsRenamed({"n_A": "nA_nonNA", "n_B": "nB_nonNA"}).select(*DIFFERENTIAL, "cohen_d", "hedges_g")


def balanced(samples: DataFrame, min_n: int = 10) -> DataFrame:
    """One row (smallest, ok): whether every label has more than min_n samples."""
    return samples.groupBy("label").count().agg(F.min("count").alias("smallest"), (F.min("count") > min_n).alias("ok"))


def deletion_enrichment(attention: DataFrame, samples: DataFrame, pairs: DataFrame, roster: DataFrame, min_n: int = 10) -> DataFrame:
    """Missing bases of label A against B at each position of site_spine(): (..., OR_deleted, pvalue, padj, nA, nB).

    roster: (gene, hap, sample) of all haplotypes, so that samples without any score count as missing. Fisher's test
    where a cell is below 5, else chi-square with continuity correction; 0.5 is added to the cells of the odds ratio. A
    pair with fewer than min_n samples on a side is left out; without any pair the table is empty.
    """
    sizes = roster.join(samples, "sample").groupBy("gene", "hap", "label").agg(F.count("*").alias("size"))
    present = attention.where(F.col("score").isNotNull()).join(samples, "sample").groupBy(*SITE, "label").agg(F.count("*").alias("here"))
    side = lambda s: sizes.select("gene", "hap", F.col("label").alias(f"group{s}"), F.col("size").alias(f"n{s}"))
    here = lambda s: present.select(*SITE, F.col("label").alias(f"group{s}"), F.col("here").alias(f"{s}_pres"))
    rows = site_spine(attention).select("*", F.explode(listed(pairs, *PAIR)).alias("p")).select(*SITE, "p.groupA", "p.groupB").join(side("A"), ["gene", "hap", "groupA"]).join(side("B"), ["gene", "hap", "groupB"]).where((F.col("nA") >= min_n) & (F.col("nB") >= min_n))
    rows = rows.join(here("A"), [*SITE, "groupA"], "left").join(here("B"), [*SITE, "groupB"], "left").fillna(0, ["A_pres", "B_pres"])
    rows = rows.withColumns({"A_del": F.col("nA") - F.col("A_pres"), "B_del": F.col("nB") - F.col("B_pres")})
    # Each distinct table is tested once.
    a, b, c, d = cells = [F.col(x) for x in ("A_del", "A_pres", "B_del", "B_pres")]
    n = a + b + c + d
    expected = lambda r, k: (r * k) / n
    gap = [(o, expected(r, k)) for o, r, k in ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d))]
    chi = sum((F.pow(F.greatest(F.abs(o - e) - 0.5, F.lit(0.0)), F.lit(2)) / F.nullif(e, F.lit(0.0)) for o, e in gap), F.lit(0.0))
    small = F.least(*cells) < 5
    tables = rows.select("A_del", "A_pres", "B_del", "B_pres").distinct().withColumns({"small": small, "chi": chi})
    tested = tables.where("small").withColumn("pvalue", fisher_p("A_del", "A_pres", "B_del", "B_pres")).unionByName(tables.where("NOT small").withColumn("pvalue", chi2_p(F.col("chi")))).drop("small", "chi")
    odds = ((a + 0.5) / (b + 0.5)) / ((c + 0.5) / (d + 0.5))
    out = bh_adjust(rows.join(tested, ["A_del", "A_pres", "B_del", "B_pres"]).withColumn("OR_deleted", odds), ["gene", "hap", *PAIR])
    return out.select("gene", "hap", *PAIR, "position", "OR_deleted", "pvalue", "padj", "nA", "nB")


def join_effect_sizes(diff: DataFrame, sep: DataFrame, how: str = "inner") -> DataFrame:
    """differential() with cohen_d and hedges_g of separability()."""
    return diff.join(sep.select(*SITE, *PAIR, "cohen_d", "hedges_g"), [*SITE, *PAIR], how)


#: Positions that one row of dense_trace() lists.
SPAN_BLOCK = 100_000


def dense_trace(effects: DataFrame) -> DataFrame:
    """Every integer position from the first to the last of a gene, haplotype and pair; where there is none, log2FC and cohen_d 0 and padj 1."""
    keys = ["gene", "hap", *PAIR]
    ends = effects.groupBy(*keys).agg(F.min("position").alias("lo"), F.max("position").alias("hi"))
    # A span is listed in blocks, so that no array grows with it.
    blocks = ends.select(*keys, "hi", F.explode(F.sequence("lo", "hi", F.lit(SPAN_BLOCK))).alias("lo"))
    spine = blocks.select(*keys, F.explode(F.sequence("lo", F.least(F.col("lo") + SPAN_BLOCK - 1, "hi"))).alias("position"))
    filled = spine.join(effects.select(*keys, "position", "log2FC", "padj", "cohen_d"), [*keys, "position"], "left")
    return filled.fillna({"log2FC": 0.0, "padj": 1.0, "cohen_d": 0.0})


def highlight_sites(trace: DataFrame, padj: float = 0.05, quantile: float = 0.95, cohen: float | None = None) -> DataFrame:
    """trace with highlighted: padj below its bound, |log2FC| at or above the quantile over the pair's positions, |cohen_d| above its bound (if any)."""
    keys = ["gene", "hap", *PAIR]
    level = trace.groupBy(*keys).agg(F.percentile(F.abs("log2FC"), F.lit(quantile)).alias("level"))
    flag = (F.col("padj") < padj) & (F.abs("log2FC") >= F.col("level"))
    if cohen is not None:
        flag = flag & (F.abs("cohen_d") > cohen)
    return trace.join(level, keys).withColumn("highlighted", F.coalesce(flag, F.lit(False)))


def highlight_sweep(trace: DataFrame, cohens: Sequence[float], padj: float = 0.05, quantile: float = 0.95) -> DataFrame:
    """highlight_sites() for several bounds of |cohen_d| at once: trace with cohen and highlighted, a row for each bound."""
    plain = highlight_sites(trace, padj, quantile)
    swept = plain.select("*", F.explode(F.array(*map(F.lit, map(float, cohens)))).alias("cohen"))
    return swept.withColumn("highlighted", F.coalesce(F.col("highlighted") & (F.abs("cohen_d") > F.col("cohen")), F.lit(False)))
