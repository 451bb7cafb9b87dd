import glob
import gzip

from helixframe.sources import readers, writers

VCF = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\nchr1\t11\t.\tA\tG,T\t.\t.\t.\tGT\t0|1\t2|0\nchr1\t12\t.\tCA\tC\t.\t.\t.\tGT\t./.\t1|1\n"


def test_vcf_plain_and_gzipped(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    with gzip.open(tmp_path / "b.vcf.gz", "wt") as f:
        f.write(VCF.replace("S2", "S9"))
    variants, calls = readers.read_vcf(spark, str(tmp_path / "*.vcf*"))
    assert variants.count() == 4 and variants.where("pos = 11").first()["alts"] == ["G", "T"]
    assert {r["sample"] for r in calls.collect()} == {"S1", "S2", "S9"} and calls.count() == 8


def test_text_formats(spark, tmp_path):
    (tmp_path / "r.txt").write_text("chr1:1-5:+\tG1\n\nchr2:3-9:-\n")
    assert [tuple(x) for x in readers.read_regions(spark, str(tmp_path / "r.txt")).collect()] == [("chr1:1-5:+", "chr1", 1, 5, "+", "G1"), ("chr2:3-9:-", "chr2", 3, 9, "-", "unknown")]
    (tmp_path / "f.fa").write_text(">c1 words\nacg\nTT\n>c2\nNN\n")
    assert {x["chrom"]: x["seq"] for x in readers.read_fasta(spark, str(tmp_path / "f.fa")).collect()} == {"c1": "ACGTT", "c2": "NN"}
    (tmp_path / "s.csv").write_text("sample,type\n/skip,1\nA,0\n\nB,2,more\nA,2\n")
    assert {x["sample"]: x["sample_type"] for x in readers.read_sample_types(spark, str(tmp_path / "s.csv")).collect()} == {"A": 2, "B": 2}
    (tmp_path / "t.csv").write_text("POS,id\n7,x\n")
    assert [tuple(x) for x in readers.read_truth(spark, str(tmp_path / "t.csv")).collect()] == [(7, "x", None)]
    (tmp_path / "g.csv").write_text("other\n7\n")
    assert readers.read_gwas(spark, str(tmp_path / "g.csv")).count() == 0


def test_matrices_round_trip(spark, tmp_path):
    a = spark.createDataFrame([("g", "hap1", "s1", 3, 1.5), ("g", "hap1", "s1", 20, 2.0), ("g", "hap1", "s2", 20, 4.0)], "gene string, hap string, sample string, position long, score double")
    roster = spark.createDataFrame([("g", "hap1", s) for s in ("s1", "s2", "s3")], "gene string, hap string, sample string")
    writers.write_attention_wide(a, str(tmp_path / "w"), roster)
    text = "".join(open(f).read() for f in glob.glob(f"{tmp_path}/w/gene=g/hap=hap1/part*"))
    assert text == "sample,pos_3,pos_20\ns1,1.5,2.0\ns2,,4.0\ns3,,\n"
    for gene in ("g", "h", "1.plot"):
        (tmp_path / "root" / gene).mkdir(parents=True)
        (tmp_path / "root" / gene / "hap1_attention_collapsed.csv").write_text(text)
    for gene in ("g", "1.plot"):
        (tmp_path / "root" / gene / "metadata.csv").write_text("sample,sample_type\ns1,0\n")
    back = readers.read_genes(spark, str(tmp_path / "root"))
    assert {(r["gene"], r["sample"], r["position"], r["score"]) for r in back.where("score IS NOT NULL").collect()} == {("g", "s1", 3, 1.5), ("g", "s1", 20, 2.0), ("g", "s2", 20, 4.0)}
    writers.write_attention(a, str(tmp_path / "long"))
    assert spark.read.parquet(str(tmp_path / "long")).count() == 3


def test_labelled_haplotypes_and_tables(spark, tmp_path):
    from helixframe.operators.regions import paired_haplotypes

    h = spark.createDataFrame([("r", "s", "hap1", "ACG", [1, 2, 3]), ("r", "s", "hap2", "AC", [1, 2]), ("r", "t", "hap1", "A<D>", [1]), ("r", "t", "hap2", "A", [1])], "region string, sample string, hap string, seq string, positions array<long>")
    p = paired_haplotypes(h, spark.createDataFrame([("s", 2)], "sample string, sample_type int"))
    got = {r["sample"]: tuple(r)[2:] for r in p.collect()}
    assert got == {"s": ("2", "ACG", "1;2;3", "AC", "1;2"), "t": ("", "", "", "", "")}
    writers.write_labeled_haplotypes(p, str(tmp_path / "haps"))
    assert spark.read.csv(str(tmp_path / "haps"), header=True).count() == 2
    for name, body in (("x.csv", "a,b\n1,2\n"), ("x.tsv", "a\tb\n1\t2\n"), ("x.json", '[{"a": 1, "b": 2}]'), ("x.jsonl", '{"a": 1, "b": 2}\n')):
        (tmp_path / name).write_text(body)
        assert [(r["a"], r["b"]) for r in readers.load_table(spark, str(tmp_path / name)).collect()] == [(1, 2)]


def test_labelled_haplotypes_are_written_as_they_come(spark, tmp_path):
    rows = [(region, sample, label, *cells) for region in ("chr1:0-9:+:1", "a b", "50%") for sample, label, cells in (("s", "2", ("ACG", "1;2;3", "AC", "1;2")), ('t,"', "", ("", "", "", "")), (None, "x\\", ("A", "1", "N", "7")))]
    p = spark.createDataFrame(rows, "region string, sample string, sample_type string, hap1_seq string, hap1_pos string, hap2_seq string, hap2_pos string").coalesce(1)
    jobs = spark.sparkContext.statusTracker()
    read = lambda d: sorted(map(repr, spark.read.csv(str(tmp_path / d), header=True, schema=p.drop("region").schema).select(*p.columns).collect()))
    writers.write_labeled_haplotypes(p, str(tmp_path / "plain"))
    spark.sparkContext.setJobGroup("together", "")
    writers.write_labeled_haplotypes(p, str(tmp_path / "together"), together=True)
    writers.write_labeled_haplotypes(p, str(tmp_path / "packed"), together=True, packed=True)
    # One stage a job: no shuffle.
    assert [len(jobs.getJobInfo(j).stageIds) for j in jobs.getJobIdsForGroup("together")] == [1, 1]
    spark.sparkContext.setJobGroup("others", "")
    assert read("plain") == read("together") == read("packed") and len(read("plain")) == 9
    assert {f.name for f in (tmp_path / "plain").glob("region=*")} == {f.name for f in (tmp_path / "together").iterdir()} == {f.name for f in (tmp_path / "packed").iterdir()}
    writers.write_labeled_haplotypes(p.repartition(3), str(tmp_path / "mixed"), packed=True)
    assert read("mixed") == read("plain") and len(glob.glob(f"{tmp_path}/mixed/*/*.gz")) == 3


def test_region_files(spark, tmp_path):
    from helixframe.operators.regions import region_records

    lines = spark.createDataFrame(list(enumerate(VCF.strip().split("\n"))), "line_no long, value string")
    regions = spark.createDataFrame([("chr1:10-11:+", "chr1", 10, 11, "+", "A"), ("chr1:0-50:-", "chr1", 0, 50, "-", "B"), ("chr2:1-2:-", "chr2", 1, 2, "-", "C")], "region string, chrom string, start long, end long, strand string, gene string")
    writers.write_region_vcfs(region_records(lines, regions), str(tmp_path / "v"))
    sizes = {f.split("region_name=")[1].split("/")[0]: open(f).read() for f in glob.glob(f"{tmp_path}/v/*/part*")}
    assert {k: v.count("\n") for k, v in sizes.items()} == {"chr1_10_11_forward_A": 2, "chr1_0_50_reverse_B": 3, "chr2_1_2_reverse_C": 1}
    assert all(v.startswith("#CHROM") for v in sizes.values())


def test_result_tables(spark, tmp_path):
    diff = spark.createDataFrame([("g", "hap1", 1, 2, 5, 0.001)], "gene string, hap string, groupA int, groupB int, position long, padj double")
    deletion = diff.selectExpr("*", "1.0D AS OR_deleted")
    writers.write_base_results(diff, diff, deletion, str(tmp_path / "b"))
    assert spark.read.csv(f"{tmp_path}/b/deletion", header=True).count() == 1
    writers.write_cluster_results(*[diff] * 6, str(tmp_path / "c"))
    assert "analysis_timestamp" in spark.read.csv(f"{tmp_path}/c/truth_metrics", header=True).columns


def test_cohort_files(spark, tmp_path):
    """Files of 40 samples under 36 header lines, named after their regions: their kinds of variants and calls are counted right."""
    import random

    from helixframe.operators.regions import indel_lengths

    r, want = random.Random(1), {}
    for name, n, ins, dels in (("chr1_1324755_1328896_forward_A", 93, 5, 4), ("chr5_73444826_73448777_reverse_B", 61, 10, 4), ("chr17_7658999_7663000_forward_C", 54, 0, 3)):
        chrom, start = name.split("_")[0], int(name.split("_")[1])
        lines, calls = [f"##line {i}" for i in range(36)] + ["\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *(f"S{i:02}" for i in range(1, 41))])], {}
        for k in range(n):
            ref, alt = ("A", "A" + "CG" * 9) if k < ins else ("A" + "T" * 21, "A") if k < ins + dels else ("A", "G")
            gts = [r.choice(["0|0"] * 6 + ["0|1", "1|0", "1|1"]) for _ in range(40)]
            for g in gts:
                calls[g] = calls.get(g, 0) + 1
            lines.append("\t".join([chrom, str(start + 30 * k + 1), ".", ref, alt, ".", ".", "AC=1;AN=80", "GT", *gts]))
        (tmp_path / f"{name}.vcf").write_text("\n".join(lines) + "\n")
        want[name] = (n, ins, dels, calls)
    variants, genotypes = readers.read_vcf(spark, str(tmp_path / "*.vcf"))
    carriers = readers.read_vcf(spark, str(tmp_path / "*.vcf"), carriers=True)[1]
    for name, (n, ins, dels, calls) in want.items():
        mine = variants.where(variants["file"].endswith(f"{name}.vcf"))
        sizes = indel_lengths(mine)
        assert (mine.count(), sizes.where("insertion > 0").count(), sizes.where("deletion > 0").count()) == (n, ins, dels)
        got = {x["gt"]: x["count"] for x in genotypes.where(genotypes["file"].endswith(f"{name}.vcf")).groupBy("gt").count().collect()}
        assert got == calls
        assert carriers.where(carriers["file"].endswith(f"{name}.vcf")).count() == sum(calls.values()) - calls["0|0"]


def test_wide_parquet_and_folders(spark, tmp_path):
    a = spark.createDataFrame([("g", "hap1", "s1", 3, 1.5), ("g", "hap1", "s1", 20, 2.0), ("g", "hap1", "s2", 20, None), ("h", "hap1", "s1", 7, 4.0)], "gene string, hap string, sample string, position long, score double")
    roster = spark.createDataFrame([(g, "hap1", s) for g in "gh" for s in ("s1", "s2", "s3")], "gene string, hap string, sample string")
    writers.write_attention_wide_parquet(a, str(tmp_path / "w"), roster)
    assert spark.read.parquet(str(tmp_path / "w/gene=g/hap=hap1")).columns == ["sample", "pos_3", "pos_20"]
    back = readers.read_attention_wide_parquet(spark, str(tmp_path / "w/*/*/*.parquet"), most_cells=2)
    assert sorted(tuple(x)[1:] for x in back.where("score IS NOT NULL").collect()) == [("s1", 3, 1.5), ("s1", 7, 4.0), ("s1", 20, 2.0)] and back.count() == 9
    metadata = spark.createDataFrame([("g", "s1", 0), ("g", "s2", 2)], "gene string, sample string, sample_type int")
    writers.write_gene_folders(a, metadata, str(tmp_path / "root"))
    assert sorted(tuple(x) for x in readers.read_metadata(spark, str(tmp_path / "root")).collect()) == [("g", "s1", 0), ("g", "s2", 2)]
    assert {(x["gene"], x["sample"], x["position"]) for x in readers.read_genes(spark, str(tmp_path / "root")).where("score IS NOT NULL").collect()} == {("g", "s1", 3), ("g", "s1", 20)}


def test_parameter_tables_are_bounded(spark):
    import pytest

    from helixframe.operators.base import dense_trace, listed

    with pytest.raises(ValueError, match="parameter table"):
        listed(spark.range(2000).selectExpr("int(id) AS groupA", "2 AS groupB"), "groupA", "groupB")
    wide = spark.createDataFrame([("g", "hap1", 1, 2, p, 1.0, 0.5, 1.0) for p in (1, 250_001)], "gene string, hap string, groupA int, groupB int, position long, log2FC double, padj double, cohen_d double")
    assert dense_trace(wide).count() == 250_001 and dense_trace(wide.limit(0)).count() == 0
