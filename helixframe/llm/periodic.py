"""Periodic runs of words, found by tiles of each scale of periods.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends, at least REPEATS periods and
LEAST words long. Periods are taken by octave (2^k to 2^(k+1) - 1), and the words of a document, for each octave, in
overlapping tiles:

1. Boundaries of an octave are 2^k words apart. A run with a period q of the octave agrees with itself q words on over at
   least 3q words, and so over whole blocks from one boundary to the next. Boundary Z-functions tell, for each boundary and
   each q of the octave, whether a block agrees, and for those that do, how far the agreement goes forward and back in the
   tile. Tiles know nothing of each other; a document up to CORE words is one tile of all its octaves and is solved where it
   is read, longer ones are dealt out in tiles, larger ones for larger periods.
2. What is found is an interval of a document and a period. Intervals are shuffled by document and period, and those that
   overlap or touch are fragments of one, as tiles overlap by four times the smallest period of the octave.
3. Of equal stretches with several periods the smallest is the run's (the others are its multiples).

Words are told apart by a 64-bit hash, blocks of words by a 64-bit hash of two hashes of half of it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.shingles import mix, release, slices, word_spans
from helixframe.llm.storage import documents, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: A run has so many periods and words at least.
REPEATS, LEAST = 4, 6
#: Words of a tile that its boundaries lie in, for octaves up to WIDE; of a wider octave k, 2 ** (k + 4).
CORE, WIDE = 1 << 16, 12
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def octaves(n: int) -> int:
    """How many octaves of periods a document of n words can have runs of."""
    return (n // REPEATS).bit_length() if n >= LEAST else 0


def block_names(words: np.ndarray, levels: int) -> list[np.ndarray]:
    """For each k < levels, a hash of the 2^k words from each word on."""
    out = [words]
    for k in range(1, levels):
        half = 1 << (k - 1)
        out.append(mix(out[-1][:-half] * _A + out[-1][half:] * _B + np.uint64(k)) if len(out[-1]) > half else np.zeros(0, np.uint64))
    return out


def _agreement(names: list[np.ndarray], at: np.ndarray, q: np.ndarray, edge: np.ndarray, levels: list[int], forward: bool) -> np.ndarray:
    """For how many words from each place on (or up to it) the text agrees with itself q words on, within edge."""
    m = np.zeros(len(at), np.int64)
    for k in levels:
        size, name = 1 << k, names[k]
        i = at + m if forward else at - m - size
        inside = i + q + size <= edge if forward else i >= edge
        i = np.where(inside, i, 0)
        m += np.where(inside & (name[i] == name[np.where(inside, i + q, 0)]), size, 0) if len(name) else 0
    return m


def solve_tiles(words: np.ndarray, begin: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray, lowest: int, highest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of tiles that agree with themselves, for periods of the octaves lowest to highest (exclusive).

    Tile t holds words[begin[t]:begin[t + 1]], which are those of a document of n[t] words from number first[t] on; its
    boundaries lie from low[t] to high[t] (exclusive). Returns (tile, period, start, end) in word numbers of the document.
    Intervals that are too short for a run are left out, unless they reach a tile's end within the document.
    """
    empty = np.zeros(0, np.int64)
    out: list[tuple] = []
    if highest <= lowest or not len(words):
        return empty, empty, empty, empty
    names = block_names(words, highest)
    tile = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    number = np.arange(len(words)) - (begin[:-1] - first)[tile]
    ends, low, high = begin[1:][tile], low[tile], high[tile]
    whole = (first == 0) & (first + np.diff(begin) == n)
    for k in range(lowest, highest):
        size, name = 1 << k, names[k]
        p = np.arange(max(0, len(name) - size)) + size
        boundary = ((number[p] >> k) - 1) << k
        q = number[p] - boundary
        # Where a tile begins after its document does, words before are in no block.
        ok = (boundary >= low[p]) & (boundary < high[p]) & (p + size <= ends[p]) & (p - q >= begin[:-1][tile[p]])
        ok[ok] = name[p[ok]] == name[p[ok] - q[ok]]
        p, boundary, q = p[ok], boundary[ok], q[ok]
        if not len(p):
            continue
        t = tile[p]
        order = np.lexsort((boundary, q, t))
        t, q, boundary = t[order], q[order], boundary[order]
        opens = np.ones(len(t), bool)
        opens[1:] = (t[1:] != t[:-1]) | (q[1:] != q[:-1]) | (boundary[1:] != boundary[:-1] + size)
        a = np.flatnonzero(opens)
        z = np.append(a[1:], len(t)) - 1
        likely = (z > a) | ~whole[t[a]] | (size == 1)
        a, z = a[likely], z[likely]
        t, q, start, end = t[a], q[a], boundary[a], boundary[z] + size
        shift = begin[t] - first[t]
        down = list(range(k - 1, -1, -1))
        start = start - _agreement(names, start + shift, q, begin[t], [k, k, *down], False)
        end = end + _agreement(names, end + shift, q, begin[t + 1], [k] * REPEATS + down, True)
        last = first[t] + begin[t + 1] - begin[t]
        long = end - start >= np.maximum((REPEATS - 1) * q, LEAST - q)
        cut = ((start == first[t]) & (first[t] > 0)) | ((end + q == last) & (last < n[t]))
        keep = long | cut
        out.append((t[keep], q[keep], start[keep], end[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (empty, empty, empty, empty)


def tiles(n: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(lowest, highest, first, last, low, high) of the tiles of a document of n words: octaves, words held, and where boundaries lie."""
    top, k = octaves(n), 0
    while k < top:
        after = min(top, WIDE + 1) if k == 0 else k + 1
        core = max(CORE, 1 << (after + 3)) if k else CORE
        for low in range(0, n, core):
            yield k, after, max(0, low - (1 << (after - 1))), min(n, low + core + (REPEATS << (after - 1))), low, min(n, low + core)
        k = after


TILE = "struct<lowest: int, highest: int, first: long, low: long, high: long, words: binary>"
FRAGMENT = "struct<period: long, start: long, end: long>"


def _joined(starts: np.ndarray, ends: np.ndarray, row: np.ndarray, data: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of each row with one space between them: bytes, and where rows begin in them."""
    keep = np.zeros(len(data) + 1, np.int8)
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends, -1)
    keep = np.cumsum(keep[:-1]).astype(bool)
    gaps = ends[:-1][row[1:] == row[:-1]]
    data = data.copy()
    data[gaps] = 32
    keep[gaps] = True
    upto = np.concatenate(([0], np.cumsum(keep)))
    begin = np.searchsorted(row, np.arange(rows + 1))
    at = np.append(starts, len(data))[begin]
    return data[keep], upto[at]


def tiled(docs: DataFrame) -> DataFrame:
    """docs (id, text) as rows (row, id, n, collapsed, text, fragments, tile).

    Of each document a row with its number of words; its fragments, and where it has none the SHA-256 of its words with a space
    between them, else its text. A document of more than CORE words has no fragments yet, but further rows that hold a tile.
    """
    kind = docs.schema["id"].dataType
    fragment = pa.struct([("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
    tile_type = pa.struct([("lowest", pa.int32()), ("highest", pa.int32()), ("first", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("words", pa.binary())])
    names = ["row", "id", "n", "collapsed", "text", "fragments", "tile"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts, ids = pc.fill_null(batch.column("text"), ""), batch.column("id")
            for a, b in slices(texts):
                text = texts.slice(a, b - a)
                h, row, starts, ends, data = word_spans(text)
                begin = np.searchsorted(row, np.arange(b - a + 1))
                n = np.diff(begin)
                joined, at = _joined(starts, ends, row, data, b - a)
                found: dict[int, list] = {}
                # Documents with as many octaves are solved together.
                classes = np.array([octaves(x) for x in n.tolist()])
                for top in np.unique(classes[(classes > 0) & (n <= CORE)]).tolist():
                    mine = np.flatnonzero((classes == top) & (n <= CORE))
                    words = np.concatenate([h[begin[k] : begin[k + 1]] for k in mine.tolist()])
                    none = np.zeros(len(mine), np.int64)
                    for t, *x in zip(*(x.tolist() for x in solve_tiles(words, np.concatenate(([0], np.cumsum(n[mine]))), none, none, n[mine], n[mine], 0, top)), strict=True):
                        found.setdefault(int(mine[t]), []).append(dict(zip(("period", "start", "end"), x, strict=True)))
                open_ = [k in found or n[k] > CORE for k in range(b - a)]
                collapsed = [None if o else hashlib.sha256(joined[at[k] : at[k + 1]]).hexdigest() for k, o in enumerate(open_)]
                columns = [pa.array(range(number, number + b - a), pa.int64()), ids[a:b], pa.array(n, pa.int64()), pa.array(collapsed, pa.string()), text.cast(pa.string()).take(pa.array([k if o else None for k, o in enumerate(open_)], pa.int64())), pa.array([found.get(k, []) for k in range(b - a)], pa.list_(fragment)), pa.nulls(b - a, tile_type)]
                yield pa.record_batch(columns, names)
                for k in np.flatnonzero(n > CORE).tolist():
                    for lowest, highest, first, last, low, high in tiles(int(n[k])):
                        tile = {"lowest": lowest, "highest": highest, "first": first, "low": low, "high": high, "words": h[begin[k] + first : begin[k] + last].tobytes()}
                        yield pa.record_batch([pa.array([number + k], pa.int64()), ids[a + k : a + k + 1], pa.array([n[k]], pa.int64()), *(pa.nulls(1, x) for x in (pa.string(), pa.string(), pa.list_(fragment))), pa.array([tile], tile_type)], names)
                number += b - a
        release()

    return docs.select("id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"row long, id {kind.simpleString()}, n long, collapsed string, text string, fragments array<{FRAGMENT}>, tile {TILE}")


def solved(tile_rows: DataFrame) -> DataFrame:
    """(row, period, start, end) of rows (row, n, tile), which are dealt out anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                x, n = batch.column("tile")[k].as_py(), np.array([batch.column("n")[k].as_py()])
                words = np.frombuffer(x["words"], np.uint64)
                _, *found = solve_tiles(words, np.array([0, len(words)]), *(np.array([x[c]]) for c in ("first", "low", "high")), n, x["lowest"], x["highest"])
                yield pa.record_batch([pa.array([batch.column("row")[k].as_py()] * len(found[0]), pa.int64()), *map(pa.array, found)], ["row", "period", "start", "end"])
        release()

    return tile_rows.repartition("row", "tile.lowest", "tile.first").select("row", "n", "tile").mapInArrow(run, "row long, period long, start long, end long")


def stitched(fragments: DataFrame) -> DataFrame:
    """(row, start, length, period) of the runs of fragments (row, period, start, end): those of a document and period that overlap or touch are one."""
    along = Window.partitionBy("row", "period").orderBy("start", "end")
    before = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    joined = fragments.withColumn("opens", (before.isNull() | (F.col("start") > before)).cast("int")).withColumn("part", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    whole = joined.groupBy("row", "period", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start") + F.col("period")
    return whole.select("row", "start", length.alias("length"), "period").where(length >= F.greatest(F.lit(LEAST), REPEATS * F.col("period"))).groupBy("row", "start", "length").agg(F.min("period").alias("period"))


def _collapsed(listed: DataFrame) -> DataFrame:
    """(id, runs, collapsed) of rows (id, text, runs)."""
    pattern = re.compile(rb"[^\x20\x09-\x0D]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for k in range(len(batch)):
                words = pattern.findall(batch.column("text")[k].as_py().encode())
                dropped = np.zeros(len(words) + 1, np.int64)
                for x in batch.column("runs")[k].as_py() or ():
                    dropped[x["start"] + x["period"]] += 1
                    dropped[x["start"] + x["length"]] -= 1
                gone = np.cumsum(dropped) > 0
                made.append(hashlib.sha256(b" ".join(w for w, d in zip(words, gone.tolist(), strict=False) if not d)).hexdigest())
            yield pa.record_batch([batch.column("id"), batch.column("runs"), pa.array(made, pa.string())], ["id", "runs", "collapsed"])
        release()

    kinds = {c: listed.schema[c].dataType.simpleString() for c in ("id", "runs")}
    return listed.select("id", "text", "runs").mapInArrow(run, f"id {kinds['id']}, runs {kinds['runs']}, collapsed string")


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs, collapsed) of each row of docs: its runs (start, length, period) by start, then period, and the SHA-256 of the text without their repeats.

    Words are runs of anything but ASCII white space, numbered from 0. A word goes if any run has it after its first period;
    the others are joined by a space. Null and empty texts have no words: no runs, and the hash of the empty text. Rows with
    the same id are documents of their own, null ids stay. An empty table gives an empty one.
    """
    rows = materialize(tiled(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))), "tiles")
    ready = rows.where("tile IS NULL")
    here = ready.select("row", F.explode("fragments").alias("x")).select("row", "x.*")
    runs = stitched(here.unionByName(solved(rows.where("tile IS NOT NULL"))))
    listed = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    typed = F.transform("runs", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), x["period"].alias("period")))
    listed = listed.select("row", typed.alias("runs"))
    open_ = _collapsed(ready.where("text IS NOT NULL").select("row", "id", "text").join(listed, "row", "left"))
    none = F.array().cast("array<struct<start: long, length: long, period: long>>")
    return ready.where("text IS NULL").select("id", none.alias("runs"), "collapsed").unionByName(open_.withColumn("runs", F.coalesce("runs", none)))


def run_digest(found: DataFrame) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of periodic_runs(): the run with most periods (then the earliest, then the shortest period), or nulls."""
    def better(best: Column, x: Column) -> Column:
        more, same = x["length"] * best["period"] > best["length"] * x["period"], x["length"] * best["period"] == best["length"] * x["period"]
        earlier = (x["start"] < best["start"]) | ((x["start"] == best["start"]) & (x["period"] < best["period"]))
        return F.when(best.isNull() | more | (same & earlier), x).otherwise(best)

    best = F.aggregate("runs", F.try_element_at("runs", F.lit(1)), better)
    text = F.array_join(F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))), "")
    out = found.withColumn("best", best)
    return out.select("id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with one document in ten made periodic from some word on.

    Of h, the CRC-32 of doc_id in decimal, h % 10 = 0 chooses documents with words, and g = h // 10 the rest: from word a = g % n on
    words repeat with period p = 1 + (n - a) // (3 + g % 8). Null ids and texts stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.withColumns({"h": h, "w": F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))})
    placed = chosen.withColumns({"g": F.expr("h div 10"), "n": F.size("w")}).withColumn("a", F.expr("if(n > 0, cast(g % n as int), 0)"))
    placed = placed.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    made = F.expr("array_join(concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), cast((n - a) div p as int) + 1)), 1, n - a)), ' ')")
    return placed.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op13_scale_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, one in ten of which is made periodic; see with_planted_runs() and periodic_runs() for nulls, ties and repeated rows."""
    return run_digest(periodic_runs(with_planted_runs(documents(spark, sf_dir).select("doc_id", "text")))).withColumnRenamed("id", "doc_id")


_CRC = "list_reduce([{0}, 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, (s & 1) * 3988292384))"
ORACLE = rf"""
WITH c AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: {_CRC.format("xor(c, b)")}), 4294967295) AS h
  FROM documents
), g AS (SELECT *, h // 10 AS g, len(w) AS n FROM c
), a AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM g
), p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a
), d AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w FROM p
), x AS (SELECT r, n, unnest(range(0, n)) AS i, unnest(w) AS v FROM d
), e AS (SELECT x.r, x.i, y.i - x.i AS q FROM x JOIN x AS y ON x.r = y.r AND x.v = y.v AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), s AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM e) GROUP BY r, q, k
), u AS (SELECT r, start, length, min(q) AS period FROM s WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length
), t AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM u GROUP BY r
), b AS (
  SELECT DISTINCT ON (u.r) u.r, u.start, u.length, u.period FROM u
  WHERE NOT EXISTS (SELECT 1 FROM u AS o WHERE o.r = u.r AND o.length * u.period > u.length * o.period) ORDER BY u.r, u.start, u.period
), z AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM u
), k AS (SELECT x.r, string_agg(v, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN z ON x.r = z.r AND x.i = z.i GROUP BY x.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, CAST(length AS BIGINT) AS length, period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (r) LEFT JOIN b USING (r) LEFT JOIN k USING (r)
"""
