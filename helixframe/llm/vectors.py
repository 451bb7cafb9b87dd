"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A rotation is three rounds of random signs and a Walsh-Hadamard transform; its hash is the axis (with sign) nearest to
the rotated vector. A table's bucket is the hashes of several rotations; a vector is also looked up in the bucket with
its second nearest axis (the one that loses least, over the rotations). Vectors that meet in a bucket are compared by
cosine in double precision. A bucket is cut into blocks, and pairs of blocks are compared as matrices: what leaves a task
are sums of links and a forest, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.components import components
from helixframe.llm.storage import materialize

SIMILARITY = 0.95
#: Vectors compared at once.
BLOCK = 512
#: So many lengths of vectors may occur in a table; each is hashed by itself.
MOST_LENGTHS = 1000
#: The chance to miss a pair at the least similarity, for which the number of tables is chosen; probes and closer pairs lower it.
MISS = 1e-4


@lru_cache(1000)
def agreement(dim: int, similarity: float, tries: int = 4000) -> float:
    """The chance that a rotation gives two vectors of this cosine the same axis, with its sign: rotated vectors are as good as normal ones, so pairs of these are tried."""
    r = np.random.default_rng(dim)
    same, step = 0, max(1, 2_000_000 // dim)
    for a in range(0, tries, step):
        n = min(step, tries - a)
        x, y = r.normal(size=(n, dim)), r.normal(size=(n, dim))
        y = similarity * x + math.sqrt(max(0.0, 1 - similarity**2)) * y
        i, j = np.abs(x).argmax(1), np.abs(y).argmax(1)
        rows = np.arange(n)
        same += int(((i == j) & (np.sign(x[rows, i]) == np.sign(y[rows, j]))).sum())
    return max(1, same) / tries


def layout(n: int, dim: int, similarity: float) -> tuple[int, int]:
    """(tables, rotations in a bucket) for n vectors: buckets stay small, and the chance to miss a pair at the least similarity is MISS."""
    padded = max(2, 1 << max(0, dim - 1).bit_length())
    rotations = max(1, round(math.log(max(n, 1)) / math.log(2 * padded)))
    return max(4, math.ceil(math.log(MISS) / math.log(max(1e-12, 1 - agreement(padded, similarity) ** rotations)))), rotations


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.concatenate((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(-1, n)
        h *= 2
    return x / math.sqrt(n)


def unit(vectors: pd.Series) -> np.ndarray:
    """The vectors as rows of length 1, in double precision."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def buckets(x: np.ndarray, tables: int, rotations: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Own and second bucket of each row in each table, as numbers."""
    dim = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, dim - x.shape[1])))
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, rotations, 3, dim))
    own, second = np.zeros((2, len(x), tables), np.int64)
    for t in range(tables):
        axes, others, losses = [], [], []
        for r in range(rotations):
            y = x
            for s in signs[t, r]:
                y = hadamard(y * s)
            size = np.abs(y)
            order = np.argsort(-size, 1, kind="stable")[:, :2] if dim > 1 else np.zeros((len(x), 2), int)
            axis = 2 * order + (np.take_along_axis(y, order, 1) < 0)
            best = np.take_along_axis(size, order, 1)
            axes.append(axis[:, 0])
            others.append(axis[:, 1])
            losses.append(best[:, 0] - best[:, 1])
        weakest = np.argmin(losses, 0)
        for r in range(rotations):
            own[:, t] = own[:, t] * 2 * dim + axes[r]
            second[:, t] = second[:, t] * 2 * dim + np.where(weakest == r, others[r], axes[r])
            own[:, t] %= 2**31 - 1
            second[:, t] %= 2**31 - 1
    return own, second


def _labels(linked: np.ndarray) -> np.ndarray:
    """The least row that each row of a symmetric boolean matrix reaches."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(linked)).min(1, initial=len(linked))
        fresh = np.minimum(label, near)
        fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh


def compare(table: int, bucket: int, halves: np.ndarray, ids: np.ndarray, x: np.ndarray, own: np.ndarray, second: np.ndarray, sizes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links among the vectors of a bucket: what each gains, and the first vector that it is connected with.

    halves: of a pair of different blocks, in which of the two each vector is; only links across count. A pair is counted
    in the first table in which the two meet, and there in the bucket of the one with the smaller id if both look the
    other up.
    """
    s = x @ x.T
    linked = s >= least
    np.fill_diagonal(linked, False)
    if len(np.unique(halves)) > 1:
        linked &= halves[:, None] != halves[None, :]
    a, b = np.nonzero(np.triu(linked | linked.T, 1))
    meet = (own[a] == own[b]) | (own[a] == second[b]) | (second[a] == own[b])
    first = meet.argmax(1)
    low = np.where(ids[a] < ids[b], a, b)
    high = a + b - low
    here = np.where((own[low, table] == own[high, table]) | (own[low, table] == second[high, table]), own[low, table], own[high, table])
    counted = (first == table) & meet[np.arange(len(a)), table] & (here == bucket)
    a, b = a[counted], b[counted]
    gains = np.bincount(a, weights=sizes[b], minlength=len(ids)) + np.bincount(b, weights=sizes[a], minlength=len(ids))
    kept = np.zeros_like(linked)
    kept[a, b] = kept[b, a] = True
    return gains.astype(np.int64), _labels(kept)


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """One row (id, n_links, component_id, kept) per input row.

    n_links: other rows linked directly (cosine of similarity or more); component_id: the smallest id reachable. Null
    vectors, zero vectors, and those with null or non-finite components link with nothing, and vectors of different lengths
    don't link. Equal vectors are compared once, with their number. A row with a null id links with nothing and has no
    component. The number of rotations in a bucket follows the logarithm of the number of vectors of a length, so that
    buckets stay small. Other columns are not looked at.
    """
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    zero = ~F.exists("v", lambda e: e != 0)
    rows = rows.withColumn("v", F.when(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & ~F.coalesce(zero, F.lit(True)), F.col("v")))
    keyed = materialize(rows.withColumn("k", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256))), "vectors")
    usable = keyed.where("v IS NOT NULL")
    lengths = usable.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).limit(MOST_LENGTHS + 1).collect()
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    if not lengths:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    layouts = {r["dim"]: layout(r["n"], r["dim"], similarity) for r in lengths}
    distinct = materialize(usable.groupBy("k").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")), "distinct-vectors")

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for dim, f in whole.groupby(whole["v"].map(len), sort=False):
                own, second = buckets(unit(f["v"]), *layouts[dim])
                yield pd.DataFrame({"rep": f["rep"], "copies": f["copies"], "v": f["v"], "own": list(own.astype(np.int32)), "second": list(second.astype(np.int32))})

    coded = materialize(distinct.select("rep", "copies", "v").mapInPandas(hashed, f"rep long, copies long, v array<{kind}>, own array<int>, second array<int>"), "coded-vectors")
    both = F.arrays_zip("own", "second")
    # A bucket's number tells the length of its vectors, too.
    places = coded.select("rep", F.size("v").alias("dim"), F.posexplode(both).alias("t", "b")).select("rep", (F.col("t") + F.col("dim").cast("long") * 65536).alias("t"), F.explode(F.array_distinct(F.array("b.own", "b.second"))).alias("bucket"))
    crowd = places.groupBy("t", "bucket").agg(F.count("*").alias("n")).where("n > 1").select("t", "bucket", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    met = places.join(crowd, ["t", "bucket"]).select("rep", "t", "bucket", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    met = met.select("rep", "t", "bucket", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    full = met.join(coded, "rep").repartition("t", "bucket", "lo", "hi").sortWithinPartitions("t", "bucket", "lo", "hi")

    def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_groups(frames, ["t", "bucket", "lo", "hi"]):
            out = []
            starts = np.flatnonzero((f[["t", "bucket", "lo", "hi"]].diff() != 0).any(axis=1).to_numpy())
            ids, copies, parts, t, bucket = (f[c].to_numpy() for c in ("rep", "copies", "part", "t", "bucket"))
            for a, b in zip(starts, [*starts[1:], len(f)], strict=True):
                if b - a > 1:
                    x, own, second = unit(f["v"].iloc[a:b]), *(np.stack(f[c].iloc[a:b].to_numpy()) for c in ("own", "second"))
                    gains, label = compare(int(t[a]) % 65536, int(bucket[a]), parts[a:b], ids[a:b], x, own, second, copies[a:b], similarity)
                    for i in np.flatnonzero(gains):
                        out.append((int(ids[a + i]), int(gains[i]), int(ids[a + label[i]])))
            if out:
                yield pd.DataFrame(out, columns=["u", "gain", "v"])

    gained = materialize(full.select("rep", "copies", "v", "own", "second", "t", "bucket", "part", "lo", "hi").mapInPandas(linked, "u long, gain long, v long"), "vector-links")
    sums = gained.groupBy("u").agg(F.sum("gain").alias("gain"))
    joined = components(gained.select("u", "v"))
    # A class's smallest id is its representative, so the smallest id of a component is one too.
    classes = distinct.select("k", "rep", "copies").join(sums, F.col("rep") == F.col("u"), "left").join(joined, F.col("rep") == F.col("node"), "left")
    classes = classes.select(F.col("k").alias("of"), (F.coalesce("gain", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    found = keyed.select("id", "k").join(classes, F.col("k") == F.col("of"), "left")
    component = F.coalesce("component_id", "id")
    return found.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str], least: int = 2000) -> Iterator[pd.DataFrame]:
    """Frames of least rows or more from a partition sorted by keys, cut between groups only."""
    held: list[pd.DataFrame] = []
    size = 0
    for f in frames:
        held.append(f)
        size += len(f)
        if size < least:
            continue
        f = pd.concat(held, ignore_index=True)
        last = (f[keys] != f[keys].iloc[-1]).any(axis=1).to_numpy()
        cut = int(last.nonzero()[0][-1]) + 1 if last.any() else 0
        if cut:
            yield f.iloc[:cut].reset_index(drop=True)
        held, size = [f.iloc[cut:]], len(f) - cut
    if size:
        yield pd.concat(held, ignore_index=True)


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all embeddings at a cosine of 0.95; see near_vectors() for nulls, lengths and repeated rows."""
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumnRenamed("id", "vec_id")


ORACLE = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS MATERIALIZED (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pr AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
rc AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT rc.a, pr.b FROM rc JOIN pr ON pr.a = rc.b),
co AS (SELECT a, min(b) AS c FROM rc GROUP BY a), nl AS (SELECT a, count(*) AS n FROM pr GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN co ON co.a = vec_id LEFT JOIN nl ON nl.a = vec_id
"""
