"""Readers of variant, region, sequence, label and matrix files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions.sequences import normalize_position, parse_region
from helixframe.sources.matrices import knows_store, plan_matrices, read_planned, read_whole


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value); line_no increases along each file, and is no count."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), F.regexp_replace("value", "\r$", "").alias("value"))


def read_vcf(spark: SparkSession, path: str, carriers: bool = False, lines: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """variants (file, chrom, pos, id, ref, alts, line_no) and genotypes (file, chrom, pos, line_no, sample, gt) of plain or gzipped files.

    The #CHROM line of each file names its samples. Lines with fewer than five fields or without a position are skipped. With
    carriers, calls without any allele above 0 are dropped before a line is taken apart. The names of samples, one row a file,
    are joined by file; Spark sends them to all executors where they are small. lines: those of the files, if they have been read
    otherwise, such as by read_bgzf_lines(), which reads a compressed file in many tasks and leaves out what regions don't need.
    """
    lines = _lines(spark, path) if lines is None else lines
    f = F.split("value", "\t")
    names = lines.where(F.col("value").startswith("#CHROM")).select("file", F.slice(f, 10, F.greatest(F.size(f) - 9, F.lit(0))).alias("samples"))
    rows = lines.where(~F.col("value").startswith("#")).withColumn("f", f).where((F.size("f") >= 5) & F.col("f")[1].try_cast("long").isNotNull())
    base = rows.select("file", F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("pos"), F.col("f")[2].alias("id"), F.col("f")[3].alias("ref"), F.split(F.col("f")[4], ",").alias("alts"), "line_no", "f")
    each = F.arrays_zip("samples", F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0))).alias("gt"))
    each = F.filter(each, lambda x: x["gt"].rlike(r"^[^:]*[1-9]")) if carriers else each
    calls = base.join(names, "file").select("file", "chrom", "pos", "line_no", F.explode(each).alias("x"))
    return base.drop("f"), calls.select("file", "chrom", "pos", "line_no", F.col("x.samples").alias("sample"), F.col("x.gt").alias("gt")).where("sample IS NOT NULL AND gt IS NOT NULL")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """(region, chrom, start, end, strand, gene): the first word of a line, and the second or 'unknown'; blank lines are skipped."""
    words = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = spark.read.text(path).where(F.trim("value") != "").select(words.alias("w"))
    r = rows.select(F.col("w")[0].alias("region"), parse_region(F.col("w")[0]).alias("r"), F.coalesce(F.try_element_at("w", F.lit(2)), F.lit("unknown")).alias("gene"))
    return r.select("region", "r.chrom", "r.start", "r.end", "r.strand", "gene")


def read_genome(spark: SparkSession, path: str, size: int = 1 << 16) -> DataFrame:
    """(chrom, offset, bases) of FASTA files: slices of at most size bases in upper case, offset from 0 in their contig, named by the first word of its header.

    A file is read in splits like any text. Tasks join the lines of each stretch of a contig in their split into slices; where
    stretches begin in their contigs is summed over one row a stretch (splits and contigs of the files), of which those
    before the first header of a split belong to the contig of the split before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, stretch, chrom, upto, held, length = None, 0, None, 0, [], 0

        def made(bases: str) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x]) for x in (*split, stretch)] + [pa.array([chrom], pa.string()), pa.array([upto], pa.int64()), pa.array([bases])], names)

        names = ["file", "block", "stretch", "name", "upto", "bases"]
        for batch in batches:
            for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
                if (file, block) != split or value.startswith(">"):
                    if split is not None:
                        yield made("".join(held))
                    stretch = stretch + 1 if (file, block) == split else 0
                    split, upto, held, length = (file, block), 0, [], 0
                    chrom = (value[1:].split() or [""])[0] if value.startswith(">") else None
                    if chrom is not None:
                        continue
                held.append("".join(value.split()).upper())
                length += len(held[-1])
                if length >= size:
                    text = "".join(held)
                    for a in range(0, length - size + 1, size):
                        yield made(text[a : a + size])
                        upto += size
                    held, length = [text[length - length % size :]], length % size
        if split is not None:
            yield made("".join(held))

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    cut = lines.mapInArrow(run, "file string, block long, stretch long, name string, upto long, bases string")
    stretches = cut.groupBy("file", "block", "stretch").agg(F.max("name").alias("name"), F.sum(F.length("bases")).alias("n"))
    along = Window.partitionBy("file").orderBy("block", "stretch")
    contig = F.count("name").over(along)
    chrom = F.last("name", True).over(along)
    begun = stretches.select("file", "block", "stretch", chrom.alias("chrom"), contig.alias("contig"), "n")
    within = Window.partitionBy("file", "contig").orderBy("block", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    begun = begun.select("file", "block", "stretch", "chrom", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("begin"))
    placed = cut.join(begun, ["file", "block", "stretch"]).where("chrom IS NOT NULL AND bases <> ''")
    return placed.select("chrom", (F.col("begin") + F.col("upto")).alias("offset"), "bases")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, seq): whole contigs of read_genome(), a row each, for those that fit one; contigs without bases are left out."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "bases")))
    return read_genome(spark, path).groupBy("chrom").agg(F.array_join(F.transform(parts, lambda x: x["bases"]), "").alias("seq"))


def read_sample_types(spark: SparkSession, path: str) -> DataFrame:
    """(sample, sample_type) of 'sample,type' lines; blank lines and those that start with / are skipped, a header too; of repeats the last wins."""
    rows = _lines(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith("/")).withColumn("f", F.split("value", ","))
    typed = rows.select(F.trim(F.col("f")[0]).alias("sample"), F.trim(F.try_element_at("f", F.lit(2))).try_cast("int").alias("sample_type"), F.struct("file", "line_no").alias("at"))
    return typed.where("sample_type IS NOT NULL").groupBy("sample").agg(F.max_by("sample_type", "at").alias("sample_type"))


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by the suffix of its path: csv, tsv (also compressed), parquet, json, jsonl or ndjson; other suffixes are an error."""
    name = path.rstrip("/").lower()
    for packed in (".gz", ".bz2", ".zst"):
        name = name.removesuffix(packed)
    kind = name.rpartition(".")[2]
    if kind in ("csv", "tsv", "txt"):
        return spark.read.csv(path, header=True, inferSchema=True, sep="," if kind == "csv" else "\t")
    if kind in ("parquet", "pq"):
        return spark.read.parquet(path)
    if kind in ("json", "jsonl", "ndjson"):
        return spark.read.json(path, multiLine=kind == "json")
    raise ValueError(f"no reader for {path}")


def read_attention_wide(spark: SparkSession, path: str) -> DataFrame:
    """(file, sample, position, score) of wide CSV matrices: a header with sample and pos_<n>, one line a sample; empty and NaN are nulls.

    Lines are split as arrays, so a matrix may have any number of columns.
    """
    lines = _lines(spark, path)
    first = Window.partitionBy("file").orderBy("line_no")
    # The header is the first line of each file.
    heads = lines.where(F.col("value").startswith("sample,")).withColumn("n", F.row_number().over(first)).where("n = 1").select("file", F.col("line_no").alias("head_no"), F.split("value", ",").alias("names"))
    rows = lines.join(heads, "file").where("line_no <> head_no").select("file", F.split("value", ",").alias("f"), "names")
    cells = rows.select("file", F.col("f")[0].alias("sample"), F.explode(F.arrays_zip(F.slice("names", 2, 2**30).alias("name"), F.slice("f", 2, 2**30).alias("text"))).alias("x"))
    score = F.nanvl(F.col("x.text").try_cast("double"), F.lit(None).cast("double"))
    return cells.select("file", "sample", normalize_position(F.col("x.name")).alias("position"), score.alias("score")).where("position IS NOT NULL")


def read_attention_wide_parquet(spark: SparkSession, path: str, most_cells: int = 1 << 20) -> DataFrame:
    """(file, sample, position, score) of wide Parquet matrices (a column sample, and pos_<n>); files may have different columns.

    Tasks read ranges of files: row groups, and lots of columns of about most_cells cells, so files may be of any size and no
    plan has a column for a position. Files in stores that only Spark knows come as a whole (2 GB at most each).
    """
    long = read_planned(plan_matrices(spark, path, most_cells)) if knows_store(path) else read_whole(spark, path, most_cells)
    return long.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))


def read_genes(spark: SparkSession, root: str, hap: str = "hap1") -> DataFrame:
    """(gene, hap, sample, position, score) of all folders of root that have both a matrix of the haplotype and metadata.csv; the folder 1.plot is none. A matrix may be a file or a folder of one."""
    gene = F.regexp_extract("file", "/([^/]+)/[^/]*collapsed[^/]*[.]csv(/[^/]*)?$", 1)
    matrix = read_attention_wide(spark, f"{root}/*/{hap}*collapsed*.csv").withColumn("gene", gene)
    metadata = _lines(spark, f"{root}/*/metadata.csv").select(_folder().alias("gene")).distinct()
    return matrix.where("gene <> '1.plot'").join(metadata, "gene", "left_semi").select("gene", F.lit(hap).alias("hap"), "sample", "position", "score")


def _folder():
    return F.regexp_extract("file", "/([^/]+)/metadata[.]csv(/[^/]*)?$", 1)


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(gene, sample, sample_type) of the metadata.csv (file or folder) of all folders of root."""
    rows = _lines(spark, f"{root}/*/metadata.csv").withColumn("f", F.split("value", ","))
    return rows.select(_folder().alias("gene"), F.col("f")[0].alias("sample"), F.try_element_at("f", F.lit(2)).try_cast("int").alias("sample_type")).where("sample_type IS NOT NULL")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(pos, ID, cpra) of a CSV with pos or POS, and maybe ID or id, and cpra."""
    t = spark.read.csv(path, header=True)
    have = {c.lower(): c for c in t.columns}
    if "pos" not in have:
        raise ValueError("no column pos")
    text = lambda c: F.col(have[c]) if c in have else F.lit(None).cast("string")
    return t.select(F.col(have["pos"]).try_cast("long").alias("pos"), text("id").alias("ID"), text("cpra").alias("cpra")).where("pos IS NOT NULL")


def read_gwas(spark: SparkSession, path: str) -> DataFrame:
    """read_truth() without cpra; a file without positions gives no rows."""
    try:
        return read_truth(spark, path).select("pos", "ID")
    except ValueError:
        return spark.createDataFrame([], "pos long, ID string")
