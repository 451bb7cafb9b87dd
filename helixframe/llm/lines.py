"""Line dedup by pairwise alignment.

Overlapping documents are found through rare lines, those that at most RARE documents hold: each holder is paired with the
first one, so a rare line costs fewer than RARE pairs. Each pair is aligned by patience diff (lines that occur once on
either side are matched in order and the matches extended), and aligned common blocks are deleted from the later document.

An exact way settles the rest: blocks whose lines are all frequent, blocks of which the first holder of no line is the
holder, repeats that a diff cannot anchor. Any block is a union of runs, consecutive lines that just reach the length of a
block; lines that the alignments left ask whether an earlier document has one of their runs. Only runs whose lines other
documents have too are listed, and runs within aligned blocks do not ask.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.shingles import mix, powers, release
from helixframe.llm.storage import documents, materialize

#: A common block is deleted if it holds so many characters, line ends and outer spaces not counted.
LEAST_CHARS = 40
#: A line is rare if no more documents hold it. Lines of more documents make no pairs; their blocks are found as runs.
RARE = 64
#: Rows that hold one line or run are dealt over so many tasks.
SALTS = 32


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first number, with increasing second numbers."""
    tails, at, back = [], [], [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        tails[k : k + 1] = [b]
        at[k : k + 1] = [i]
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Matched places of equal items of a and b, increasing on both sides: patience diff without recursion on the stack."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        there = {x: j for j, x in enumerate(b[b0:b1], b0) if nb[x] == 1}
        fixed = _increasing([(i, there[x]) for i, x in enumerate(a[a0:a1], a0) if na[x] == 1 and x in there])
        if not fixed:
            continue
        found += fixed
        ends = [(a0 - 1, b0 - 1), *fixed, (a1, b1)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:], strict=False)]
    return sorted(found)


def common_blocks(later: Sequence[int], earlier: Sequence[int], chars: Sequence[int], least: int = LEAST_CHARS) -> list[int]:
    """Lines of later in aligned blocks of consecutive lines that hold least characters or more."""
    out, block = [], []
    for pair in [*patience(later, earlier), (-9, -9)]:
        if block and pair != (block[-1][0] + 1, block[-1][1] + 1):
            mine = [i for i, _ in block]
            if sum(chars[i] for i in mine) >= least:
                out += mine
            block = []
        block.append(pair)
    return out


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, lines array<long>, chars array<int>): hashes and lengths of the lines without outer spaces. key orders rows by id, then by a hash of the text; rows with a null id are left out."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return docs.where(F.col(id_col).isNotNull()).select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h")).alias("key"), F.transform(trimmed, lambda x: F.xxhash64(x)).alias("lines"), F.transform(trimmed, lambda x: F.length(x)).alias("chars")).dropDuplicates(["key"])


def with_first(rows: DataFrame, on: str) -> DataFrame:
    """rows with two more columns, for those whose value of the column on, never null, n > 1 rows have: earlier, the least key of these rows, and n.

    Rows of one value are dealt over SALTS tasks, whose least keys meet by value and are dealt back, so that a value which
    very many rows have burdens no single task.
    """
    dealt = rows.where(F.col(on).isNotNull()).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    value = Window.partitionBy("of")
    parts = dealt.groupBy(F.col(on).alias("of"), F.col("salt").alias("part")).agg(F.min("key").alias("least"), F.count("*").alias("rows"))
    first = parts.select("of", "part", F.min("least").over(value).alias("earlier"), F.sum("rows").over(value).alias("n")).where("n > 1")
    return dealt.join(first, (F.col(on) == F.col("of")) & (F.col("salt") == F.col("part"))).select(*rows.columns, "earlier", "n")


def shared_lines(table: DataFrame) -> DataFrame:
    """(key, line, earlier, n): the lines of each row of line_table(), blank ones left out, that n > 1 rows hold, and the first of these rows."""
    zipped = F.filter(F.arrays_zip("lines", "chars"), lambda x: x["chars"] > 0)
    return with_first(table.select("key", F.explode(F.array_distinct(F.transform(zipped, lambda x: x["lines"]))).alias("line")), "line")


def overlaps(shared: DataFrame, rare: int = RARE) -> DataFrame:
    """(later, earlier) keys: each row with the first row that holds one of its rare lines; shared as of shared_lines()."""
    return shared.where((F.col("n") <= rare) & (F.col("earlier") < F.col("key"))).select(F.col("key").alias("later"), "earlier").distinct()


def least_runs(lines: np.ndarray, chars: np.ndarray, offsets: np.ndarray, least: int = LEAST_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the shortest runs of least characters from each line on, and up to each line, in texts laid end to end; start and end count over all texts, end excluded."""
    n, sums = len(lines), np.concatenate(([0], np.cumsum(chars, dtype=np.int64)))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.arange(n)
    until = np.searchsorted(sums, sums[:n] + max(least, 1), "left")
    since = np.searchsorted(sums, sums[1:] - max(least, 1), "right") - 1
    on, up = until <= offsets[row + 1], since >= offsets[row]
    up &= until[since] != start + 1  # that run is listed from its start
    start, end = np.concatenate((start[on], since[up])), np.concatenate((until[on], start[up] + 1))
    raised, lowered = powers(n + 1)
    joined = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(lines.view(np.uint64)) * raised[:n], dtype=np.uint64)))
    return mix((joined[end] - joined[start]) * lowered[start] + (end - start).astype(np.uint64)).view(np.int64), start, end


def held_runs(table: DataFrame, shared: DataFrame, aligned: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(id, h, start, end): runs of lines of each row of line_table(), end excluded, that an earlier row has and that hold a line which is not in aligned.

    shared is of shared_lines(), aligned (id, h, gone) of aligned_lines(). A row has each of its lines in shared once, so lists
    by row are bounded by the text.
    """
    kind = table.schema["key"].dataType["id"].dataType.simpleString()
    known = shared.groupBy("key").agg(F.collect_list("line").alias("known"))
    rows = table.join(known, "key").select(F.col("key.id").alias("id"), F.col("key.h").alias("h"), "lines", "chars", "known").join(aligned, ["id", "h"], "left")
    rows = rows.select("id", "h", "lines", "chars", "known", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("lines")
            offsets = np.concatenate(([0], np.cumsum(listed.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)))
            lines, chars = listed.flatten().to_numpy(), batch.column("chars").flatten().to_numpy()
            usable, unsettled = chars == 0, np.ones(len(lines), bool)
            for begin, end, known, gone in zip(offsets, offsets[1:], batch.column("known"), batch.column("gone"), strict=False):
                usable[begin:end] |= np.isin(lines[begin:end], known.values.to_numpy())
                unsettled[begin + gone.values.to_numpy()] = False
            found, start, end = least_runs(lines, chars, offsets, least)
            strange, asked = (np.concatenate(([0], np.cumsum(x))) for x in (~usable, unsettled))
            met = strange[end] == strange[start]
            found, start, end = found[met], start[met], end[met]
            row = np.searchsorted(offsets, start, "right") - 1
            begin = offsets[row]
            yield pa.record_batch([pa.array(found), batch.column("id").take(pa.array(row)), batch.column("h").take(pa.array(row)), pa.array((start - begin).astype(np.int32)), pa.array((end - begin).astype(np.int32)), pa.array(asked[end] > asked[start])], ["run", "id", "h", "start", "end", "asks"])
        release()

    runs = rows.mapInArrow(run, f"run long, id {kind}, h long, start int, end int, asks boolean").withColumn("key", F.struct("id", "h"))
    return with_first(runs, "run").where(F.col("asks") & (F.col("earlier") < F.col("key"))).select("id", "h", "start", "end")


def aligned_lines(table: DataFrame, pairs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(id, h, gone array<int>): the lines of each row of line_table() that are in aligned blocks of one of its pairs of overlaps()."""
    pairs = pairs.join(table.select(F.col("key").alias("later"), F.col("lines").alias("mine"), "chars"), "later").join(table.select(F.col("key").alias("earlier"), F.col("lines").alias("theirs")), "earlier")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = zip(f["mine"], f["theirs"], f["chars"], strict=True)
            yield pd.DataFrame({"id": f["id"], "h": f["h"], "gone": [common_blocks(m.tolist(), t.tolist(), c.tolist(), least) for m, t, c in rows]})

    kind = table.schema["key"].dataType["id"].dataType.simpleString()
    gone = pairs.select(F.col("later.id").alias("id"), F.col("later.h").alias("h"), "mine", "theirs", "chars").mapInPandas(run, f"id {kind}, h long, gone array<int>")
    # A row meets at most one earlier one for each of its lines.
    return gone.where(F.size("gone") > 0).groupBy("id", "h").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def kept_runs(hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of lines that are not hit, as their first line from 1 on and their number; lines beyond hit belong to the last run."""
    edge = np.diff(np.concatenate(([0], (~hit).astype(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()
    if not end or end[-1] < len(hit):
        start.append(len(hit))
        end.append(len(hit))
    end[-1] = 1 << 30
    return [{"first": a + 1, "n": b - a} for a, b in zip(start, end, strict=True)]


def deleted_lines(table: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(id, h, deleted, kept array<struct<first, n>>): how many lines of each row are in blocks an earlier row has, and the runs of lines between them, counted from 1; the last run is open."""
    kind = table.schema["key"].dataType["id"].dataType.simpleString()
    nothing = F.lit(None).cast("int")
    shared = materialize(shared_lines(table), "shared-lines")
    aligned = materialize(aligned_lines(table, overlaps(shared), least), "aligned-lines")
    both = aligned.select("id", "h", "gone", nothing.alias("start"), nothing.alias("end")).unionByName(held_runs(table, shared, aligned, least).select("id", "h", F.lit(None).cast("array<int>").alias("gone"), "start", "end"))
    # A row has one list of aligned lines and at most two runs for each line, so lists are bounded by the text.
    lists = both.groupBy("id", "h").agg(F.flatten(F.collect_list("gone")).alias("gone"), F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "end"))).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for gone, runs in zip(batch.column("gone"), batch.column("runs"), strict=True):
                aligned = gone.values.to_numpy(zero_copy_only=False).astype(np.int64)
                start, end = (runs.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
                n = max(aligned.max(initial=-1) + 1, end.max(initial=0))
                depth = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
                hit = np.cumsum(depth) > 0
                hit[aligned] = True
                out.append((int(hit.sum()), kept_runs(hit)))
            yield pa.record_batch([batch.column("id"), batch.column("h"), pa.array([n for n, _ in out], pa.int64()), pa.array([k for _, k in out], runs_type)], ["id", "h", "deleted", "kept"])

    runs_type = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))
    return lists.select("id", "h", "gone", "runs").mapInArrow(run, f"id {kind}, h long, deleted long, kept array<struct<first:int,n:int>>")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHARS, counts: tuple[str, str] = ("n_lines", "n_deleted")) -> DataFrame:
    """docs with text_col without the blocks of lines that an earlier document has, and two columns named counts: lines, and deleted ones.

    Earlier means a smaller id, and for equal ids a smaller hash of the text; rows equal in both are one document and all
    keep the same lines. A block is judged on the input, and its first holder keeps it there. Lines are compared
    without outer spaces; blank lines go only inside of a block. Rows with a null id or text are returned as they are;
    columns named as counts are replaced, all others are kept, whatever their names.
    """
    kept = docs.drop(*counts)
    own = {c: f"{c}_{uuid.uuid4().hex}" for c in ("id", "h", "deleted", "kept")}
    gone = materialize(deleted_lines(materialize(line_table(docs, id_col, text_col), "lines"), least), "gone-lines").withColumnsRenamed(own)
    text, lines = F.coalesce(F.col(text_col), F.lit("")), F.split(F.col(text_col), "\n")
    joined = kept.join(gone, (F.col(id_col) == F.col(own["id"])) & (F.xxhash64(text) == F.col(own["h"])), "left")
    left = F.array_join(F.flatten(F.transform(own["kept"], lambda r: F.slice(lines, r["first"], r["n"]))), "\n")
    new = F.when(F.col(own["kept"]).isNull(), F.col(text_col)).otherwise(left)
    out = joined.select(*(F.col(c) for c in kept.columns if c != text_col), new.alias(text_col), F.size(F.split(text, "\n")).cast("long").alias(counts[0]), F.coalesce(own["deleted"], F.lit(0)).cast("long").alias(counts[1]))
    return out.select(*kept.columns, *counts)


def op8_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps without blocks of lines that an earlier one has; see dedup_lines() for nulls, ties and repeated rows."""
    kept = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_deleted", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_bytes"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
