"""From sequences to one score for each reference position: chunking, pluggable scorers and collapsing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Lengths up to which a sequence is short, and medium: fixed values.
SHORT, MEDIUM = 4096, 131072


def valid_sequences(sequences: DataFrame) -> DataFrame:
    """Rows with a sequence and positions; join their scores back to the samples by a left join, so that no sample is lost."""
    return sequences.where((F.length("seq") > 0) & (F.size("positions") > 0))


def length_stats(sequences: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Longest, floored mean length and number of non-empty sequences, with the class of the longest."""
    n = F.length("seq")
    out = sequences.where(n > 0).groupBy(*keys).agg(F.max(n).cast("long").alias("max_length"), F.floor(F.sum(n) / F.count("*")).cast("long").alias("avg_length"), F.count("*").alias("n_sequences"))
    return out.withColumn("plan", F.when(F.col("max_length") <= SHORT, "short").when(F.col("max_length") <= MEDIUM, "medium").otherwise("long"))


def chunk_spans(sequences: DataFrame, size: int = 8192, overlap: int = 4096) -> DataFrame:
    """sequences (keys, seq[, positions]) with one row a chunk: chunk, chunk_start, chunk_end, valid_start, valid_end (from 0, ends exclusive), chunk_seq and chunk_positions instead of seq and positions.

    The last chunk ends at the end of the sequence and is moved back to full size; the valid part leaves out half of the
    overlap at inner edges. Empty sequences have no chunk. A chunk carries its own bases and positions only.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step, half, n = size - overlap, overlap // 2, F.length("seq")
    count = F.when(n <= size, 1).otherwise(F.ceil((n - overlap) / step)).cast("int")

    def chunk(i: Column) -> Column:
        last = i == count - 1
        start = F.when(last, F.greatest(n - size, F.lit(0))).otherwise(i * step).cast("int")
        end = F.least(start + size, n).cast("int")
        valid = [F.when(i == 0, start).otherwise(start + half).alias("valid_start"), F.when(last, end).otherwise(end - half).alias("valid_end")]
        own = [F.slice("positions", start + 1, end - start).alias("chunk_positions")] if "positions" in sequences.columns else []
        return F.struct(i.alias("chunk"), start.alias("chunk_start"), end.alias("chunk_end"), *valid, F.substring("seq", start + 1, end - start).alias("chunk_seq"), *own)

    kept = [c for c in sequences.columns if c not in ("seq", "positions")]
    return sequences.where(n > 0).select(*kept, F.explode(F.transform(F.sequence(F.lit(0), count - 1), chunk)).alias("c")).select(*kept, "c.*")


def score_sequences(df: DataFrame, scorer: Callable[[], Callable[[list[str]], list[Sequence[float]]]], column: str = "seq", batch: int = 32) -> DataFrame:
    """df with scores array<double>: one score for each token of column, by any model.

    scorer is called once in each task and returns a function from texts to lists of scores; it gets batch texts at a
    time. Null and empty texts have empty scores.
    """
    schema = StructType([*df.schema, StructField("scores", ArrayType(DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for f in frames:
            found: list = [[]] * len(f)
            at = np.flatnonzero(f[column].fillna("").str.len().to_numpy() > 0)
            for a in range(0, len(at), batch):
                for i, s in zip(at[a : a + batch], score(f[column].iloc[at[a : a + batch]].tolist()), strict=True):
                    found[i] = np.asarray(s, float).tolist()
            yield f.assign(scores=pd.Series(found, index=f.index, dtype=object))

    return df.mapInPandas(run, schema)


def _tokens(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, i, position, score): scores with their positions, as far as both go."""
    n = F.least(F.size("scores"), F.size("positions"))
    pairs = F.arrays_zip(F.slice("positions", 1, n).alias("position"), F.slice("scores", 1, n).alias("score"))
    return df.where(n > 0).select(*keys, F.posexplode(pairs).alias("i", "x")).select(*keys, "i", F.col("x.position").alias("position"), F.col("x.score").alias("score"))


def collapse_last(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One score for each position: that of the last token there. df: (keys, positions, scores)."""
    return _tokens(df, keys).groupBy(*keys, "position").agg(F.max_by("score", "i").alias("score"))


def collapse_chunks(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One score for each position of chunked sequences: the mean of the chunks' means there, over valid parts.

    chunks: chunk_spans() with scores of chunk_seq. Scores beyond the chunk are cut; a
    chunk with fewer scores than its valid part asks for is dropped.
    """
    have = F.size("scores") >= F.col("valid_end") - F.col("chunk_start")
    n = F.col("valid_end") - F.col("valid_start")
    valid = chunks.where(have).select(*keys, "chunk", F.slice("chunk_positions", F.col("valid_start") - F.col("chunk_start") + 1, n).alias("positions"), F.slice("scores", F.col("valid_start") - F.col("chunk_start") + 1, n).alias("scores"))
    by_chunk = _tokens(valid, [*keys, "chunk"]).groupBy(*keys, "chunk", "position").agg(F.avg("score").alias("score"))
    return by_chunk.groupBy(*keys, "position").agg(F.avg("score").alias("score"))


def attention_column_sums(weights: DataFrame, keys: Sequence[str] = ("sample", "hap")) -> DataFrame:
    """(keys, col, score): attention weights (keys, head, row, col, weight) summed over query rows, averaged over all heads."""
    heads = weights.groupBy(*keys).agg(F.count_distinct("head").alias("heads"))
    return weights.groupBy(*keys, "col").agg(F.sum("weight").alias("total")).join(heads, list(keys)).select(*keys, "col", (F.col("total") / F.col("heads")).alias("score"))


#: Tokens of a block of rows or columns; two blocks make a tile. A tile computes so many of its rows at once.
TILE, ROWS = 4096, 512


def _tiles(qk: DataFrame, keys: Sequence[str], tile: int) -> DataFrame:
    """(keys, head, rows, cols, tokens, q, others, k): each pair of a block of query rows with one of columns up to it; vectors end to end."""
    by = [*keys, "head"]
    block = F.floor(F.col("token") / tile).cast("long")
    x = F.sort_array(F.collect_list(F.struct("token", "q", "k")))
    blocks = qk.groupBy(*by, block.alias("block")).agg(x.alias("x"))
    flat = lambda c: F.flatten(F.transform("x", lambda r: r[c])).cast("array<double>")
    tokens = F.transform("x", lambda r: r["token"].cast("long"))
    rows = blocks.select(*by, F.col("block").alias("rows"), tokens.alias("tokens"), flat("q").alias("q"))
    cols = blocks.select(*by, F.col("block").alias("cols"), tokens.alias("others"), flat("k").alias("k"))
    return rows.join(cols, by).where("cols <= rows")


def _scores(row: dict) -> Iterator[tuple[slice, np.ndarray]]:
    """Scaled products of a tile, some rows at a time; columns after a row are left out as -inf."""
    tokens, others = row["tokens"], row["others"]
    q, k = row["q"].reshape(len(tokens), -1), row["k"].reshape(len(others), -1)
    for a in range(0, len(tokens), ROWS):
        at = slice(a, a + ROWS)
        s = q[at] @ k.T / np.sqrt(q.shape[1])
        s[tokens[at, None] < others[None, :]] = -np.inf
        yield at, s


def _each_tile(tiles: DataFrame, keys: Sequence[str], columns: Sequence[str], made: Callable, schema: str) -> DataFrame:
    """What made(columns of a tile as arrays) gives as arrays, with keys and head."""
    by = [*keys, "head"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [made({c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in columns}) for i in range(len(batch))]
            if found:
                yield pa.record_batch([*(batch.column(c) for c in by), *(pa.array([x[c] for x in found]) for c in found[0])], [*by, *found[0]])

    kinds = ", ".join(f"{c} {tiles.schema[c].dataType.simpleString()}" for c in by)
    return tiles.select(*by, *columns).mapInArrow(run, f"{kinds}, {schema}")


def _row_parts(tile: dict) -> dict:
    """Of each row the largest score in the tile, and the sum of exponentials below it."""
    most, total = (np.zeros(len(tile["tokens"])) for _ in range(2))
    for at, s in _scores(tile):
        most[at] = s.max(1)
        total[at] = np.exp(s - most[at, None]).sum(1)
    return {"token": tile["tokens"], "most": most, "total": total}


def _column_parts(tile: dict) -> dict:
    """Of each column the sum of the tile's weights, given the maxima and denominators of whole rows."""
    out = np.zeros(len(tile["others"]))
    for at, s in _scores(tile):
        out += (np.exp(s - tile["most"][at, None]) / (tile["total"][at, None] + 1e-12)).sum(0)
    return {"token": tile["others"], "part": out}


def attention_column_sums_qk(qk: DataFrame, keys: Sequence[str] = ("sample", "hap"), tile: int = TILE) -> DataFrame:
    """attention_column_sums() of causal softmax rows of scaled q k', from vectors (keys, head, token, q, k), without the whole matrix.

    A head is cut into tiles of tile x tile tokens, which are tasks' work by themselves. A first pass gives each row's
    maximum and sum within each tile, which are merged by row; a second one sums the weights by column. Tokens are
    numbers along the sequence, each once; a row sees its own token and those before.
    """
    keys = list(keys)
    by, block = [*keys, "head"], F.floor(F.col("token") / tile).cast("long")
    tiles = _tiles(qk.select(*by, "token", "q", "k"), keys, tile)
    parts = _each_tile(tiles, keys, ["tokens", "q", "others", "k"], _row_parts, "token array<long>, most array<double>, total array<double>")
    each = parts.select(*by, F.explode(F.arrays_zip("token", "most", "total")).alias("x")).select(*by, "x.*")
    merged = each.groupBy(*by, "token").agg(F.max("most").alias("m"), F.collect_list(F.struct("most", "total")).alias("x"))  # one for each block of columns
    total = F.aggregate("x", F.lit(0.0), lambda t, x: t + x["total"] * F.exp(x["most"] - F.col("m")))
    listed = merged.select(*by, block.alias("rows"), F.struct("token", "m", total.alias("total")).alias("x")).groupBy(*by, "rows").agg(F.sort_array(F.collect_list("x")).alias("x"))
    whole = listed.select(*by, "rows", F.transform("x", lambda x: x["m"]).alias("most"), F.transform("x", lambda x: x["total"]).alias("total"))
    sums = _each_tile(tiles.join(whole, [*by, "rows"]), keys, ["tokens", "q", "others", "k", "most", "total"], _column_parts, "token array<long>, part array<double>")
    by_head = sums.select(*by, F.explode(F.arrays_zip("token", "part")).alias("x")).groupBy(*by, F.col("x.token").alias("token")).agg(F.sum("x.part").alias("score"))
    return by_head.groupBy(*keys, F.col("token").cast(qk.schema["token"].dataType).alias("col")).agg(F.avg("score").alias("score"))
