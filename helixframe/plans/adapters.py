"""The library's tables made from the driver's tables, as DataFrames; oracle.py has the same rules in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS = [(1, 2), (1, 3)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 positions in four genes for each vector: |e[i]| for hap1, |e[63 - i]| for hap2; some are missing, more of them where label % 4 = 2."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    missing = ((F.col("sample") * 31 + F.col("i") * 17) % 23 == 0) | ((F.col("label") % 4 == 2) & ((F.col("sample") * 7 + F.col("i") * 3) % 5 == 0))
    hap = F.explode(F.array(F.struct(F.lit("hap1").alias("hap"), F.col("i").alias("at")), F.struct(F.lit("hap2").alias("hap"), (63 - F.col("i")).alias("at")))).alias("h")
    rows = e.where(~missing).select("sample", "i", "embedding", hap)
    return rows.select(F.concat(F.lit("gene"), F.floor(F.col("i") / 16).cast("string")).alias("gene"), "h.hap", "sample", (1000 + F.col("i")).cast("long").alias("position"), F.abs(F.get("embedding", F.col("h.at")).cast("double")).alias("score"))


def embedding_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"))
    genes = F.explode(F.array(*(F.lit(f"gene{i}") for i in range(4)))).alias("gene")
    return e.select("sample", genes).select("gene", F.explode(F.array(F.lit("hap1"), F.lit("hap2"))).alias("hap"), "sample")


def embedding_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), (F.col("label") % 4).cast("int").alias("sample_type"))


def _lineitem_cells(spark: SparkSession, sf_dir: str, gene: Callable[[Column], Column], keys: dict[str, str], wide: int) -> DataFrame:
    """Mean price of each gene, supplier and position, in units that leave no short decimals; times 3 for suppliers of type 2 at planted positions."""
    li = table(spark, sf_dir, "lineitem")
    hap = F.explode(F.array(*(F.struct(F.lit(h).alias("hap"), gene(F.col(c)).alias("gene"), (F.col(c) % wide).alias("position")) for h, c in keys.items()))).alias("h")
    rows = li.select(hap, F.col("l_suppkey").alias("sample"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    cells = rows.groupBy("h.gene", "h.hap", "sample", "h.position").agg((F.sum("cents") / F.count("*") / 9999991.0).alias("score"))
    planted = (F.col("sample") % 4 == 2) & (F.col("position") % 100 < 30)
    return cells.select("gene", "hap", "sample", "position", (F.col("score") * F.when(planted, 3.0).otherwise(1.0)).alias("score"))


def site_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four genes with the same 125 positions, by order for hap1 and by part for hap2."""
    return _lineitem_cells(spark, sf_dir, lambda c: F.concat(F.lit("gene"), (F.floor(c / 125) % 4).cast("string")), {"hap1": "l_orderkey", "hap2": "l_partkey"}, 125)


def gene_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty genes, hap1."""
    return _lineitem_cells(spark, sf_dir, lambda _: F.concat(F.lit("chr_forward_g"), (F.col("l_partkey") % 20).cast("string")), {"hap1": "l_orderkey"}, 500)


def supplier_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample")).distinct()
    return li.withColumn("sample_type", (F.col("sample") % 4).cast("int"))


def truth(attention: DataFrame) -> DataFrame:
    """Every ninth position of a gene as a known variant, shifted by its number of hundreds."""
    sites = attention.where("hap = 'hap1'").select("gene", "position").distinct().where((F.col("position") % 100 < 50) & ((F.col("position") + F.floor(F.col("position") / 100)) % 9 == 0))
    return sites.select("gene", F.col("position").alias("pos"), F.concat(F.lit("v"), F.col("position").cast("string")).alias("ID"))


SPAN, CONTIG = 2000, 2600


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    start = (F.col("p_partkey") * 7) % SPAN
    rows = p.select(F.col("p_partkey"), F.concat(F.lit("chr"), (F.col("p_partkey") % 22 + 1).cast("string")).alias("chrom"), start.alias("start"), (start + F.col("p_size") * 10).alias("end"), F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.col("p_name").alias("gene"))
    return rows.select(F.concat_ws(":", "chrom", F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")), "strand", F.col("p_partkey").cast("string")).alias("region"), "chrom", "start", "end", "strand", "gene")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variant for each supplier chromosome and order position; REF and ALT by position."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.concat(F.lit("chr"), (F.col("l_suppkey") % 22 + 1).cast("string")).alias("chrom"), (F.col("l_orderkey") % 2500 + 1).alias("pos")).distinct()
    kind = (F.col("pos") % 4).cast("int")
    pick = lambda *x: F.array(*map(F.lit, x))[kind]
    return rows.select("chrom", "pos", F.col("pos").alias("line_no"), pick("A", "C", "GTA", "T").alias("ref"), F.split(pick("G", "CAT", "G", "A,TT"), ",").alias("alts"))


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    pos = F.col("l_orderkey") % 2500 + 1
    rows = li.groupBy(F.concat(F.lit("chr"), (F.col("l_suppkey") % 22 + 1).cast("string")).alias("chrom"), pos.alias("pos"), F.col("l_suppkey").alias("sample")).agg(F.max(F.col("l_linenumber") % 3).alias("a"), F.max((F.col("l_quantity").cast("int")) % 2).alias("b"), F.min("l_partkey").alias("k"))
    mark = F.when(F.col("k") % 10 == 0, "/").otherwise("|")
    a = F.when(F.col("pos") % 4 == 3, F.col("a")).otherwise(F.least("a", F.lit(1)))
    return rows.select("chrom", "pos", F.col("pos").alias("line_no"), "sample", F.concat(a.cast("string"), mark, F.col("b").cast("string")).alias("gt"))


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_samples(spark, sf_dir).select(F.concat(F.lit("chr"), (F.col("sample") % 22 + 1).cast("string")).alias("chrom"), "sample")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contig for each chromosome that the regions name, its bases by a rule."""
    c = table(spark, sf_dir, "part").select((F.col("p_partkey") % 22 + 1).alias("c")).distinct()
    base = F.transform(F.sequence(F.lit(1), F.lit(CONTIG)), lambda i: F.substring(F.lit("ACGTTGCA"), ((i * 7 + F.floor(i / 11) + F.col("c")) % 8 + 1).cast("int"), F.lit(1)))
    return c.select(F.concat(F.lit("chr"), F.col("c").cast("string")).alias("chrom"), F.array_join(base, "").alias("seq"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, seq, positions): the letters ACGT of each document; every third base repeats a position."""
    seq = F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGT]", "")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample"), seq.alias("seq"))
    n = F.length("seq")
    return d.withColumn("positions", F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.floor(i * 2 / 3).cast("long"))).otherwise(F.array().cast("array<bigint>")))
