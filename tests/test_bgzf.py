"""Block-compressed variant files in ranges against plain lines."""

import random
import struct
import zlib

import pytest

from helixframe.sources import bgzf, matrices, readers


def block(data):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    raw = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(raw) + 25) + raw + struct.pack("<II", zlib.crc32(data), len(data))


def pack(text, size, r):
    out, at = b"", 0
    while at < len(text):
        n = r.randint(1, size)
        out += block(text[at : at + n])
        at += n
    return out + block(b"")


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    r = random.Random(6)
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n"
    rows = [(f"chr{c}", p) for c in (1, 2, 3) for p in sorted(r.sample(range(1, 9000), 400))]
    text = head + "".join(f"{c}\t{p}\t.\tA\tG\t.\t.\t{'x' * r.choice([0, 5, 300])}\tGT\t0|1\t1|{p % 2}\n" for c, p in rows)
    path = tmp_path_factory.mktemp("vcf")
    (path / "a.vcf.gz").write_bytes(pack(text.encode(), 900, r))
    (path / "b.vcf.gz").write_bytes(pack(text.encode().rstrip(b"\n"), 9000, r))
    return str(path), text.split("\n")[:-1], rows


@pytest.mark.parametrize("step", [300, 1000, 7000, 1 << 24])
def test_every_line_once_and_in_order(spark, made, step):
    path, lines, _ = made
    got = {}
    for r in bgzf.read_bgzf_lines(spark, path, step=step).orderBy("file", "line_no").collect():
        got.setdefault(r["file"][-8:], []).append(r["value"])
    assert got == {"a.vcf.gz": lines, "b.vcf.gz": lines}
    assert bgzf.file_ranges(spark, path, step).count() > (10 if step == 300 else 1)


def test_variants_equal_those_of_the_plain_reader(spark, made):
    path, _, rows = made
    plain, calls = readers.read_vcf(spark, path)
    cut, cut_calls = readers.read_vcf(spark, path, lines=bgzf.read_bgzf_lines(spark, path, step=2000))
    assert sorted((r["chrom"], r["pos"]) for r in cut.collect()) == sorted((r["chrom"], r["pos"]) for r in plain.collect()) == sorted(rows * 2)
    key = lambda df: sorted((r["chrom"], r["pos"], r["sample"], r["gt"]) for r in df.collect())
    assert key(cut_calls) == key(calls)


def test_regions_leave_ranges_out_but_no_record(spark, made):
    path, _, rows = made
    wanted = [("chr2", a, a + 120) for a in (10, 4000, 8700)] + [("chr3", 5000, 5001), ("chr9", 0, 100)]
    regions = spark.createDataFrame([(f"r{i}", *w) for i, w in enumerate(wanted)], "region string, chrom string, start long, end long")
    ranges = bgzf.file_ranges(spark, path, 1000)
    kept = bgzf.ranges_of_regions(ranges, regions)
    assert kept.count() < ranges.count() / 2
    variants, _ = readers.read_vcf(spark, path, lines=bgzf.read_bgzf_lines(spark, path, regions, 1000))
    found = {(v["chrom"], v["pos"]) for v in variants.collect()}
    inside = {(c, p) for c, p in rows if any(c == k and a < p <= b for k, a, b in wanted)}
    assert inside <= found and len(inside) > 5 and len(found) < len(rows)


def test_packed_folders_are_gzip_files_and_ranges(spark, tmp_path):
    import glob
    import gzip

    lines = [("a.gz", f"{i}\t" + "y" * (i % 900)) for i in range(3000)] + [("b.gz", "only")]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(lines)], "i int, folder string, value string")
    matrices.write_folders(df.repartition("folder").sortWithinPartitions("folder", "i"), str(tmp_path / "p"), packed=True)
    for folder in ("a.gz", "b.gz"):
        want = [v for f, v in lines if f == folder]
        (name,) = glob.glob(f"{tmp_path}/p/{folder}/*.gz")
        assert gzip.open(name, "rt").read().split("\n") == [*want, ""]
        assert [r["value"] for r in bgzf.read_bgzf_lines(spark, name, step=1500).orderBy("line_no").collect()] == want
