"""Driver queries of readers and writers: files are made from the driver's tables, written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions.sequences import normalize_position, parse_region
from helixframe.operators import attention, base, clusters, evaluate, metrics
from helixframe.operators import regions as reg
from helixframe.plans import adapters as ad
from helixframe.plans import oracle as sql
from helixframe.plans.queries import HAPLOTYPES, KEY, REGIONS, SEQ, _base, _cohort, _effects, _gene_tests, _truth, query, r, rounded
from helixframe.sources import readers, writers
from helixframe.sources.bgzf import read_bgzf_lines
from helixframe.sources.matrices import write_folders
from helixframe.sources.scratch import scratch

WINDOWS = "SELECT n_nationkey AS k, 'chr' || (n_nationkey % 22 + 1) AS chrom, n_nationkey * 40 AS s, n_nationkey * 40 + 500 AS e, CASE WHEN n_nationkey % 2 = 0 THEN '+' ELSE '-' END AS strand, n_name AS gene FROM nation"
#: A made-up genotype of sample j at a position, as both engines read it.
GT = "(CASE WHEN (pos * {a}) % 3 = 0 THEN '1' ELSE '0' END) || (CASE WHEN pos % 7 = 0 THEN '/' ELSE '|' END) || (CASE WHEN (pos * {b}) % 4 = 0 THEN '1' ELSE '0' END)"


def _text(df, path: str) -> str:
    df.select(F.col("value").cast("string")).write.text(path)
    return path


def _vcf_lines(spark, sf_dir):
    gts = [F.expr(GT.format(a=j + 3, b=j + 5)) for j in range(4)]
    v = ad.variants(spark, sf_dir)
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", F.array_join("alts", ","), *map(F.lit, (".", ".", ".", "GT")), *gts)
    names = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "s0", "s1", "s2", "s3"])
    head = spark.range(1).select(F.lit(0).cast("long").alias("line_no"), F.lit(names).alias("value"))
    return v.select((F.regexp_extract("chrom", r"\d+", 0).cast("long") * 10_000 + F.col("pos")).alias("line_no"), line.alias("value")).unionByName(head)


def _windows(spark, sf_dir):
    n = ad.table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("long")
    rows = n.select(F.concat(F.lit("chr"), (k % 22 + 1).cast("string")).alias("chrom"), (k * 40).alias("start"), (k * 40 + 500).alias("end"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), F.col("n_name").alias("gene"))
    return rows.withColumn("region", F.concat_ws("_", "chrom", "gene"))


NAMED = f"""wn AS ({WINDOWS}), wv AS (SELECT wn.*, va.pos, va.rf, va.alts, chrom || '_' || s || '_' || e || '_' || CASE WHEN strand = '+' THEN 'forward' ELSE 'reverse' END || '_' || gene AS folder FROM wn JOIN va USING (chrom) WHERE pos > s AND pos <= e)"""


def _region_files(spark, sf_dir):
    path = scratch(spark, "region-vcfs")
    writers.write_region_vcfs(reg.region_records(_vcf_lines(spark, sf_dir), _windows(spark, sf_dir), 500), path)
    return readers.read_vcf(spark, f"{path}/*/*")


def _part(name: str):
    """What a folder name=... of a file's path says."""
    return F.regexp_extract("file", f"{name}=([^/]+)/", 1)


@query([REGIONS, NAMED], "folder, chrom, pos, '.' AS id, rf AS ref, array_to_string(alts, ',') AS alts", "wv")
def q_read_region_vcfs(spark, sf_dir):
    """J2, K1 and S1: records of regions, written and read as variants."""
    return _region_files(spark, sf_dir)[0].select(_part("region_name").alias("folder"), "chrom", "pos", "id", "ref", F.array_join("alts", ",").alias("alts"))


@query([REGIONS, NAMED], "folder, pos, 's' || j AS sample, CASE j " + " ".join(f"WHEN {j} THEN {GT.format(a=j + 3, b=j + 5)}" for j in range(4)) + " END AS gt", "wv, (SELECT unnest(generate_series(0, 3)) AS j)")
def q_read_region_genotypes(spark, sf_dir):
    """S1: the calls of the same files."""
    return _region_files(spark, sf_dir)[1].select(_part("region_name").alias("folder"), "pos", "sample", "gt")


PACKED = """folder, chrom, pos, rf AS ref, array_to_string(alts, ',') AS alts"""


@query([REGIONS, NAMED], PACKED, "(SELECT DISTINCT 'calls' || (CAST(substr(chrom, 4) AS INT) % 3) AS folder, chrom, pos, rf, alts FROM wv)")
def q_read_packed_vcf(spark, sf_dir):
    """S1 and J2: block-compressed files sorted by contig and position, read in ranges, of which only those that may hold a region."""
    lines = _vcf_lines(spark, sf_dir)
    c = F.regexp_extract(F.split_part("value", F.lit("\t"), F.lit(1)), r"^chr(\d+)$", 1).try_cast("long") % 3
    named = lines.where(~F.col("value").startswith("#")).withColumn("k", c).unionByName(lines.where(F.col("value").startswith("#")).withColumn("k", F.explode(F.array(*(F.lit(k).cast("long") for k in range(3))))))
    sorted_ = named.withColumn("folder", F.concat(F.lit("calls"), F.col("k").cast("string"))).repartition("folder").sortWithinPartitions("folder", "line_no")
    write_folders(sorted_, path := scratch(spark, "packed"), packed=True)
    regions = _windows(spark, sf_dir)
    found, _ = readers.read_vcf(spark, path, lines=read_bgzf_lines(spark, f"{path}/*/*", regions, 4096))
    kept = reg.variants_in_regions(found, regions, 500).select(F.regexp_extract("file", "/(calls[0-9])/", 1).alias("folder"), "chrom", "pos", "ref", F.array_join("alts", ",").alias("alts"))
    return kept.distinct()


@query([REGIONS], "chrom || ':' || s || '-' || e || ':' || strand AS region, chrom, s AS start, e AS \"end\", strand, CASE WHEN p_partkey % 3 = 0 THEN 'unknown' ELSE 'g' || p_partkey END AS gene", "rg")
def q_read_regions(spark, sf_dir):
    """S2 and P1: region lists with tabs and spaces, some without a gene."""
    p = ad.regions(spark, sf_dir).withColumn("k", F.element_at(F.split("region", ":"), -1).cast("long"))
    name = F.concat_ws(":", "chrom", F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")), "strand")
    line = F.when(F.col("k") % 3 == 0, F.concat(name, F.lit("\n"))).otherwise(F.concat(name, F.when(F.col("k") % 3 == 1, "\t").otherwise("  "), F.lit("g"), F.col("k").cast("string")))
    return readers.read_regions(spark, _text(p.select(line.alias("value")), scratch(spark, "regions"))).select("region", "chrom", "start", "end", "strand", "gene")


@query([REGIONS], "region, chrom, s AS start, e AS \"end\", strand || ':' || p_partkey AS strand, 'reverse' AS direction", "reg")
def q_parse_region(spark, sf_dir):
    """P1: anything but '+' after the last colon is the reverse direction."""
    return ad.regions(spark, sf_dir).select("region", parse_region(F.col("region")).alias("x")).select("region", "x.*")


@query([HAPLOTYPES], "'chr' || c AS chrom, CAST(len(s) AS BIGINT) AS bases, md5(s) AS seq_md5", f"(SELECT DISTINCT p_partkey % 22 + 1 AS c, list_aggregate(list_transform(generate_series(1, {ad.CONTIG}), lambda i: substr('ACGTTGCA', CAST((i * 7 + i // 11 + (p_partkey % 22 + 1)) % 8 + 1 AS BIGINT), 1)), 'string_agg', '') AS s FROM part)")
def q_read_fasta(spark, sf_dir):
    """S3: contigs in wrapped lines of lower case."""
    lines = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / 60)), lambda i: F.lower(F.substring("seq", (i * 60 + 1).cast("int"), F.lit(60)))), "\n")
    c = ad.contigs(spark, sf_dir).select(F.concat(F.lit(">"), F.col("chrom"), F.lit(" made up\n"), lines).alias("value"))
    return readers.read_fasta(spark, _text(c, scratch(spark, "fasta"))).select("chrom", F.length("seq").cast("long").alias("bases"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


@query([], "DISTINCT 's' || l_suppkey AS sample, CAST(l_suppkey % 4 AS INT) AS sample_type", "lineitem")
def q_read_sample_types(spark, sf_dir):
    """S4: labels among blank lines, lines that start with a slash, and a header."""
    s = ad.supplier_samples(spark, sf_dir)
    line = F.concat(F.when(F.col("sample") % 5 == 0, "sample,sample_type\n").when(F.col("sample") % 5 == 1, "/ skipped,9\n\n").otherwise(""), F.lit("s"), F.col("sample").cast("string"), F.lit(","), F.col("sample_type").cast("string"))
    return readers.read_sample_types(spark, _text(s.select(line.alias("value")), scratch(spark, "labels")))


@query([], "kind, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name", "nation, (SELECT unnest(['csv', 'tsv', 'parquet', 'jsonl']) AS kind)")
def q_load_tables(spark, sf_dir):
    """S5: one table in four formats."""
    n, out = ad.table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), None
    for kind, write in (("csv", lambda p: n.write.csv(p, header=True)), ("tsv", lambda p: n.write.csv(p, header=True, sep="\t")), ("parquet", n.write.parquet), ("jsonl", n.write.json)):
        write(path := f"{scratch(spark, 'table')}.{kind}")
        one = readers.load_table(spark, path).select(F.lit(kind).alias("kind"), F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
        out = one if out is None else out.unionByName(one)
    return out


MATRIX = "gene, hap, CAST(sample AS VARCHAR) AS sample, position, round(score, 9) + 0.0 AS score"


@query([sql.EMBEDDING], MATRIX, "att")
def q_wide_text(spark, sf_dir):
    """K3 and S6: matrices as wide CSV."""
    writers.write_attention_wide(ad.embedding_attention(spark, sf_dir), path := scratch(spark, "wide"))
    back = readers.read_attention_wide(spark, f"{path}/*/*")
    return rounded(back.where("score IS NOT NULL").select(_part("gene").alias("gene"), _part("hap").alias("hap"), "sample", "position", "score"))


@query([sql.EMBEDDING], MATRIX, "att")
def q_wide_parquet(spark, sf_dir):
    """K3 and S6: matrices as wide Parquet."""
    writers.write_attention_wide_parquet(ad.embedding_attention(spark, sf_dir), path := scratch(spark, "wide"))
    back = readers.read_attention_wide_parquet(spark, f"{path}/*/*/*.parquet")
    return rounded(back.where("score IS NOT NULL").select(_part("gene").alias("gene"), _part("hap").alias("hap"), "sample", "position", "score"))


def _folders(spark, sf_dir) -> str:
    s = ad.embedding_samples(spark, sf_dir)
    metadata = ad.embedding_roster(spark, sf_dir).where("hap = 'hap1' AND gene <> 'gene3'").join(s, "sample").select("gene", "sample", "sample_type")
    writers.write_gene_folders(ad.embedding_attention(spark, sf_dir), metadata, path := scratch(spark, "genes"))
    return path


@query([sql.EMBEDDING], MATRIX, "att WHERE hap = 'hap2' AND gene <> 'gene3'")
def q_read_genes(spark, sf_dir):
    """S7: folders of genes; one without metadata is no gene."""
    return rounded(readers.read_genes(spark, _folders(spark, sf_dir), "hap2").where("score IS NOT NULL").select("gene", "hap", "sample", "position", "score"))


@query([sql.EMBEDDING], "'gene' || g AS gene, CAST(sample AS VARCHAR) AS sample, sample_type", "smp, (SELECT unnest([0, 1, 2]) AS g)")
def q_read_metadata(spark, sf_dir):
    """S7 and K3: the labels beside the matrices."""
    return readers.read_metadata(spark, _folders(spark, sf_dir))


@query([sql.SITES, sql.TRUTH], "kind, pos, ID AS \"ID\", CASE WHEN kind = 'truth' THEN 'c:' || pos END AS cpra", "truth, (SELECT unnest(['truth', 'gwas']) AS kind)")
def q_read_truth(spark, sf_dir):
    """S8: known sites with pos and ID, GWAS sites with POS and id."""
    t = _truth(spark, sf_dir)
    t.select("pos", "ID", F.concat(F.lit("c:"), F.col("pos").cast("string")).alias("cpra")).write.csv(a := scratch(spark, "truth"), header=True)
    t.select(F.col("ID").alias("id"), F.col("pos").alias("POS")).write.csv(b := scratch(spark, "gwas"), header=True)
    known = readers.read_truth(spark, a).select(F.lit("truth").alias("kind"), "pos", "ID", "cpra")
    return known.unionByName(readers.read_gwas(spark, b).select(F.lit("gwas").alias("kind"), "pos", "ID", F.lit(None).cast("string").alias("cpra")))


@query(
    [HAPLOTYPES, "pr AS (SELECT region, sample, max(seq) FILTER (hap = 'hap1') AS a, max(seq) FILTER (hap = 'hap2') AS b, max(array_to_string(ps, ';')) FILTER (hap = 'hap1') AS pa FROM hp GROUP BY ALL), ok AS (SELECT *, regexp_full_match(a, '[ACGTNacgtn]+') AND regexp_full_match(b, '[ACGTNacgtn]+') AS ok FROM pr)"],
    "sample % 4 AS sample_type, count(*) AS n, count(DISTINCT region) AS regions, CAST(sum(CASE WHEN ok THEN len(a) + len(b) ELSE 0 END) AS BIGINT) AS bases, CAST(sum(CASE WHEN ok THEN len(pa) ELSE 0 END) AS BIGINT) AS positions",
    "ok GROUP BY sample % 4",
)
def q_labeled_haplotype_files(spark, sf_dir):
    """K2: labelled haplotypes as CSV by region, read back and summed."""
    writers.write_labeled_haplotypes(reg.labeled_haplotypes(*_cohort(spark, sf_dir), ad.supplier_samples(spark, sf_dir)), path := scratch(spark, "haplotypes"), together=True, packed=True)
    back = spark.read.schema("sample string, sample_type string, hap1_seq string, hap1_pos string, hap2_seq string, hap2_pos string, region string").csv(path, header=True)
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    return back.groupBy(F.col("sample_type").cast("long").alias("sample_type")).agg(F.count("*").alias("n"), F.count_distinct("region").alias("regions"), F.sum(size("hap1_seq") + size("hap2_seq")).alias("bases"), F.sum(size("hap1_pos")).alias("positions"))


@query([sql.GENES, sql.GENE_TESTS], "gene, " + ", ".join(f"round(max(p) FILTER (metric = '{m}'), 8) + 0.0 AS {m}_p, bool_or(significant) FILTER (metric = '{m}') AS {m}_significant" for m in metrics.METRICS), "tst GROUP BY gene")
def q_gene_pvalue_file(spark, sf_dir):
    """K4: the table of 52 columns as CSV."""
    writers.write_gene_pvalues(_gene_tests(spark, sf_dir), path := f"{scratch(spark, 'pvalues')}.csv")
    back = readers.load_table(spark, path)
    return rounded(back.select("gene", *(F.col(f"{m}_p").cast("double").alias(f"{m}_p") for m in metrics.METRICS), *(F.col(f"{m}_significant").cast("boolean").alias(f"{m}_significant") for m in metrics.METRICS)), 8)


@query([sql.SITES, sql.BASE], KEY + ', "n_A" AS "nA_nonNA", ' + r("log2FC pvalue padj"), "dfr")
def q_base_result_files(spark, sf_dir):
    """K5: result tables of the base level, the differential one read back."""
    args = _base(spark, sf_dir)
    diff = base.differential(*args)
    deletion = base.deletion_enrichment(*args, ad.site_attention(spark, sf_dir).select("gene", "hap", "sample").distinct())
    writers.write_base_results(diff, base.separability(*args), deletion, path := scratch(spark, "base"))
    back = spark.read.csv(f"{path}/differential", header=True, inferSchema=True)
    return rounded(back.select("gene", "hap", "groupA", "groupB", F.col("position").cast("long").alias("position"), F.col("nA_nonNA").cast("long").alias("nA_nonNA"), *(F.col(c).cast("double").alias(c) for c in ("log2FC", "pvalue", "padj"))))


@query([sql.SITES, sql.BASE], 'gene, hap, "groupA", "groupB", CAST(cluster_id AS INT) AS cluster_id, n_points, start_position, end_position, direction, round(total_score, 7) + 0.0 AS total_score', "sco")
def q_cluster_result_files(spark, sf_dir):
    """K6: all tables of the cluster step, the clusters read back."""
    effects, truth, args = _effects(spark, sf_dir), _truth(spark, sf_dir), base.pair_table(spark, ad.PAIRS)
    found = clusters.dbscan_1d(clusters.significant_sites(effects))
    scores = clusters.cluster_scores(found)
    matches = evaluate.match_clusters(evaluate.kept_clusters(scores), truth)
    swept = evaluate.evaluation_sweep(base.dense_trace(effects), truth, evaluate.windows_table(spark))
    summary = clusters.run_summary(effects, clusters.significant_sites(effects), scores, args)
    writers.write_cluster_results(summary, scores, clusters.sites_without_cluster(found), matches, evaluate.cluster_truth_metrics(matches, truth), swept, path := scratch(spark, "clusters"))
    back = spark.read.csv(f"{path}/clusters", header=True, inferSchema=True)
    return rounded(back.select("gene", "hap", "groupA", "groupB", F.col("cluster_id").cast("int").alias("cluster_id"), *(F.col(c).cast("long").alias(c) for c in ("n_points", "start_position", "end_position")), "direction", F.col("total_score").cast("double").alias("total_score")), 7)


@query([SEQ], "sample, CAST(len(seq) AS BIGINT) AS bases", "sq WHERE len(seq) > 0")
def q_valid_sequences(spark, sf_dir):
    """P4."""
    return attention.valid_sequences(ad.sequences(spark, sf_dir)).select("sample", F.length("seq").cast("long").alias("bases"))


@query([], "l_suppkey % 500 AS position, 'pos_' || (l_suppkey % 500) AS name, count(*) AS n", "lineitem GROUP BY ALL")
def q_normalize_position(spark, sf_dir):
    """P10: column names as positions; names that are none are left out."""
    name = F.concat(F.lit("pos_"), (F.col("l_suppkey") % 500).cast("string"))
    rows = ad.table(spark, sf_dir, "lineitem").select(F.explode(F.array(name, F.lit("sample"), F.lit("pos_x"))).alias("name"))
    return rows.withColumn("position", normalize_position(F.col("name"))).where("position IS NOT NULL").groupBy("position", "name").agg(F.count("*").alias("n"))


@query([], "DISTINCT l_suppkey AS sample, CAST(l_suppkey % 4 AS INT) AS sample_type", "lineitem QUALIFY dense_rank() OVER (ORDER BY l_suppkey) <= 10")
def q_first_samples(spark, sf_dir):
    """T4: the first ten samples (the limit is the feature)."""
    return reg.first_samples(ad.supplier_samples(spark, sf_dir), 10)


@query([], "l_orderkey, l_linenumber, l_partkey", "lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1")
def q_first_rows(spark, sf_dir):
    """U3: of repeats the first in order; of those that tie, the first in the files."""
    rows = ad.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "_metadata.file_path", "_metadata.row_index")
    return reg.first_rows(rows, "l_orderkey", "l_linenumber", "file_path", "row_index").drop("file_path", "row_index")
