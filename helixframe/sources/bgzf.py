"""Lines of block-compressed text files (gzip members that tell their size), read in ranges by many tasks.

A range of a file owns the lines that begin in its blocks, but for the first one, which the range before reads to its end; so
ranges need to know nothing of each other. For files sorted by contig and position, as variant files are, the first record of
each range tells which ranges can hold a region, so others are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.sources.matrices import store_of

#: Bytes of a range. A block has 65,536 bytes at most.
RANGE, MOST = 16 << 20, 1 << 16
MAGIC = b"\x1f\x8b\x08\x04"


def _size(f: pa.NativeFile, at: int) -> tuple[int, int] | None:
    """(bytes before the data, bytes of the block) of a block at this place, None if there is none."""
    f.seek(at)
    head = f.read(12)
    if len(head) < 12 or head[:4] != MAGIC:
        return None
    extra = f.read(int.from_bytes(head[10:12], "little"))
    i = 0
    while i + 4 <= len(extra):
        n = int.from_bytes(extra[i + 2 : i + 4], "little")
        if extra[i : i + 2] == b"BC" and n == 2:
            return 12 + len(extra), int.from_bytes(extra[i + 4 : i + 6], "little") + 1
        i += 4 + n
    return None


def first_block(f: pa.NativeFile, low: int, end: int) -> int:
    """Where the first block from low on begins, end if none does: a place that looks like a block and is followed by another or the end."""
    if low == 0:
        return 0
    f.seek(low)
    window = f.read(2 * MOST)
    i = window.find(MAGIC)
    while i >= 0:
        if (found := _size(f, low + i)) and (low + i + found[1] == end or _size(f, low + i + found[1])):
            return low + i
        i = window.find(MAGIC, i + 1)
    return end


def range_lines(f: pa.NativeFile, low: int, high: int, end: int) -> Iterator[list[bytes]]:
    """The lines that a range owns, some at a time; end is the file's size."""
    at, skip, left = first_block(f, low, end), low > 0, b""
    if at >= high:
        return
    while at < end and (found := _size(f, at)):
        f.seek(at + found[0])
        text = zlib.decompress(f.read(found[1] - found[0] - 8), -15)
        beyond, at = at >= high, at + found[1]
        cut = text.find(b"\n")
        if skip:
            if beyond:
                return
            if cut < 0:
                continue
            skip, text = False, text[cut + 1 :]
        elif beyond and cut >= 0:
            yield [left + text[:cut]]
            return
        *lines, left = (left + text).split(b"\n")
        if lines:
            yield lines
    if left and not skip:
        yield [left]


def file_ranges(spark: SparkSession, path: str, step: int = RANGE) -> DataFrame:
    """(file, number, low, high, size) of the ranges of the files at path."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size")).where("size > 0")
    each = files.select("file", "size", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long"))).alias("number", "low"))
    return each.select("file", F.col("number").cast("long").alias("number"), "low", F.least(F.col("low") + step, F.col("size")).alias("high"), "size")


def _read(ranges: DataFrame, first_only: bool) -> DataFrame:
    """(file, number, line, value) of ranges; first_only: of each the first line that is no comment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                fs, at = store_of(x["file"])
                with fs.open_input_file(at) as f:
                    n = 0
                    for lines in range_lines(f, x["low"], x["high"], x["size"]):
                        if first_only:
                            lines = [v for v in lines if v and not v.startswith(b"#")][:1]
                        if lines:
                            yield pa.record_batch([pa.array([x["file"]] * len(lines)), pa.array([x["number"]] * len(lines), pa.int64()), pa.array(range(n, n + len(lines)), pa.int64()), pa.array([v.decode() for v in lines])], ["file", "number", "line", "value"])
                        n += len(lines)
                        if first_only and n:
                            break

    return ranges.repartition("file", "number").mapInArrow(run, "file string, number long, line long, value string")


def ranges_of_regions(ranges: DataFrame, regions: DataFrame) -> DataFrame:
    """Those of ranges, of files sorted by contig and position, that may hold records of regions (chrom, start, end; start exclusive), and each file's first.

    One block of each range is read. A range in which the contig changes, or that holds no begin of a record, is kept.
    """
    fields = F.split("value", "\t", 3)
    first = _read(ranges, True).select("file", "number", fields[0].alias("chrom"), fields[1].try_cast("long").alias("pos"))
    along = Window.partitionBy("file").orderBy("number")  # a row a range
    fences = ranges.join(first, ["file", "number"], "left").withColumns({"next_chrom": F.lead("chrom").over(along), "next_pos": F.lead("pos").over(along)})
    closed = F.coalesce(F.col("chrom") == F.col("next_chrom"), F.lit(False)) & F.col("pos").isNotNull() & F.col("next_pos").isNotNull() & (F.col("number") > 0)
    # The next range's first record may be the second line from its begin on, so the line before it may be this range's last.
    wanted = regions.select(F.col("chrom").alias("c"), F.col("start").alias("s"), F.col("end").alias("e")).distinct()
    met = (F.col("chrom") == F.col("c")) & (F.col("s") < F.col("next_pos")) & (F.col("e") >= F.col("pos"))
    kept = fences.where(~closed).select(*ranges.columns).unionByName(fences.where(closed).join(wanted, met, "left_semi").select(*ranges.columns))
    return kept


def read_bgzf_lines(spark: SparkSession, path: str, regions: DataFrame | None = None, step: int = RANGE) -> DataFrame:
    """(file, line_no, value) of block-compressed files in a store that pyarrow knows; with regions, of ranges_of_regions() only. line_no increases along each file, and is no count."""
    ranges = file_ranges(spark, path, step)
    kept = ranges if regions is None else ranges_of_regions(ranges, regions)
    return _read(kept, False).select("file", (F.shiftleft("number", 36) + F.col("line")).alias("line_no"), F.regexp_replace("value", "\r$", "").alias("value"))
