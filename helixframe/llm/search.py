"""Ranked lexical search: an inverted index in shards, read by Block-Max MaxScore.

A shard is a run of documents with the lists of all their terms. Documents of a shard are numbered by length, so that those
with similar impact are neighbours; a list is cut into blocks of BLOCK postings, each with its first and last document, its
largest impact and its packed gaps and counts. The impact of a term in a document is a whole number; a query's weight times
the largest impact of a list bounds what the term can give.

A shard answers a query in windows of documents. With the lists in order of their bounds, those whose bounds together stay
below the score of the k-th best document so far are not essential: no document is a result by them alone. Candidates come
from the essential lists only. Of the other lists the bounds of the blocks, in which the candidates would be, are added
first, and a candidate that can't reach the k-th score is rejected; only blocks that still have a candidate are unpacked, list
by list, with candidates rejected again after each.

Shards are searched in two rounds. The first searches one in SAMPLE, and its k-th score of each query is the floor from which
the second begins, so most shards give few rows or none. The heaps of all shards are merged by rank in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.shingles import release, slices, term_tables, word_counts, word_spans
from helixframe.llm.storage import documents, materialize

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms (with repeats) of a shard, postings of a block, documents of a window.
SHARD, BLOCK, WINDOW = 2_000_000, 128, 4096
#: One shard in so many is searched first.
SAMPLE = 16
#: Bytes of queries that are sent to all tasks at once, about; more are searched in lots.
LOT = 4 << 20
INDEX = "shard long, term string, df long, top long, blocks binary, postings binary, ids binary, lengths binary"
_NAMES = ["shard", "term", "df", "top", "blocks", "postings", "ids", "lengths"]
#: The numbers kept of a block.
_BLOCK = np.dtype([("first", "<i4"), ("last", "<i4"), ("top", "<i4"), ("size", "<u2"), ("gap", "u1"), ("tf", "u1")])


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def norm(n: np.ndarray, documents_: int, terms: int) -> np.ndarray:
    """What the length of a document counts for, 100 for the mean."""
    return 10 + (90 * n * documents_) // terms


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """data[starts:ends] of each, A-Z as a-z, as an array of bytes."""
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(low[data[at]].tobytes())])


def _binary(parts: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(parts.tobytes())])


def _width(most: np.ndarray) -> np.ndarray:
    """Bytes that hold these numbers."""
    return 1 + (most > 0xFF).astype(np.uint8) + (most > 0xFFFF) + (most > 0xFFFFFF)


class _Shard:
    """Documents on their way into a shard."""

    def __init__(self):
        self.terms, self.hashes, self.postings, self.ids, self.lengths, self.words = [], [], [], [], [], 0

    def add(self, text: pa.Array, ids: pa.Array) -> None:
        h, row, starts, ends, data = word_spans(text, term_tables())
        n = np.bincount(row, minlength=len(text))
        some = np.flatnonzero(n)
        number = np.zeros(len(text), np.int64)
        number[some] = np.arange(len(some)) + sum(map(len, self.lengths))
        hashes, place, term = np.unique(h, return_index=True, return_inverse=True)
        pair, tf = np.unique(term.astype(np.int64) * len(text) + row, return_counts=True)
        self.terms.append(_gathered(data, starts[place], ends[place]))
        self.hashes.append(hashes)
        self.postings.append((hashes[pair // len(text)], number[pair % len(text)].astype(np.int32), tf.astype(np.int32)))
        self.ids.append(ids.take(pa.array(some)))
        self.lengths.append(n[some])
        self.words += len(h)

    def rows(self, shard: int, documents_: int, terms: int) -> Iterator[pa.RecordBatch]:
        lengths = np.concatenate(self.lengths)
        by_length = np.argsort(lengths, kind="stable")
        number = np.empty(len(lengths), np.int32)
        number[by_length] = np.arange(len(lengths))
        lengths = lengths[by_length]
        ids = pa.concat_arrays(self.ids).take(pa.array(by_length))
        hashes, place = np.unique(np.concatenate(self.hashes), return_index=True)
        named = pa.concat_arrays(self.terms).take(pa.array(place)).cast(pa.large_string()).cast(pa.string())
        term, doc, tf = (np.concatenate(x) for x in zip(*self.postings, strict=True))
        term, doc = np.searchsorted(hashes, term), number[doc]
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order], tf[order]
        begin = np.searchsorted(term, np.arange(len(hashes) + 1))
        df = np.diff(begin)
        # A list has its postings in blocks of BLOCK and one of the rest.
        per = -(-df // BLOCK)
        of = np.repeat(np.arange(len(df)), per)
        start = begin[of] + BLOCK * (np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per))
        size = np.minimum(start + BLOCK, begin[of + 1]) - start
        block = np.repeat(np.arange(len(of)), size)
        gap = np.diff(doc, prepend=0)
        gap[start] = 0
        made = np.zeros(len(of), _BLOCK)
        held = impact(tf.astype(np.int64), norm(lengths, documents_, terms)[doc])
        made["first"], made["last"], made["size"] = doc[start], doc[start + size - 1], size
        made["top"] = np.maximum.reduceat(held, start)
        made["gap"], made["tf"] = _width(np.maximum.reduceat(gap, start)), _width(np.maximum.reduceat(tf, start))
        width = made["gap"].astype(np.int64) + made["tf"]
        ends = np.cumsum(size * width)
        packed, within = np.zeros(int(ends[-1]), np.uint8), np.arange(len(doc)) - start[block]
        base = (ends - size * width)[block] + within
        for values, columns, before in ((gap, made["gap"], np.zeros(len(of), np.int64)), (tf, made["tf"], made["gap"].astype(np.int64))):
            for plane in range(int(columns.max())):
                here = np.flatnonzero((columns > plane)[block])
                b = block[here]
                packed[base[here] + (before[b] + plane) * size[b]] = (values[here] >> (8 * plane)) & 0xFF
        first_block = np.concatenate(([0], np.cumsum(per)))
        n = len(df)
        columns = [pa.array(np.full(n, shard)), named, pa.array(df.astype(np.int64)), pa.array(np.maximum.reduceat(made["top"], first_block[:-1]).astype(np.int64)), _binary(made, first_block * _BLOCK.itemsize), _binary(packed, np.concatenate(([0], ends))[first_block]), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
        yield pa.record_batch(columns, _NAMES)
        null = pc.is_null(ids).to_numpy(zero_copy_only=False)
        key = np.where(null, np.iinfo(np.int64).max, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False))
        packed_ids = np.stack((key, null.astype(np.int64))).tobytes()
        yield pa.record_batch([pa.array([shard]), *(pa.nulls(1, t) for t in (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())), pa.array([packed_ids], pa.binary()), pa.array([lengths.astype(np.int64).tobytes()], pa.binary())], _NAMES)


def collection_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents with any term, and terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents_ = terms = 0
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            for a, b in slices(text):
                n = word_counts(text.slice(a, b - a), term_tables())
                documents_, terms = documents_ + np.count_nonzero(n), terms + int(n.sum())
        yield pa.record_batch([pa.array([documents_], pa.int64()), pa.array([terms], pa.int64())], ["documents", "terms"])
        release()

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "documents long, terms long")
    return tuple(x or 0 for x in counted.agg(F.sum("documents"), F.sum("terms")).first())


def build_index(docs: DataFrame, size: tuple[int, int], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all docs, of the given collection_size(), as a table in the shared folder: a row for each shard and term, and one for each shard with its documents.

    Documents stay in the order and partition they are in; nothing is shuffled. Terms are runs of letters, digits and
    characters beyond ASCII, A-Z as a-z, told apart by a 64-bit hash within a shard. Null and empty texts are in no list.
    """
    documents_, terms = size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            for a, b in slices(text):
                made.add(text.slice(a, b - a), batch.column("id").slice(a, b - a))
                if made.words >= SHARD:
                    yield from made.rows(shard, documents_, terms)
                    shard, made = shard + 1, _Shard()
                    release()
        if made.words:
            yield from made.rows(shard, documents_, terms)
        release()

    return materialize(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, INDEX), "index")


class List:
    """A term's postings in a shard; blocks are unpacked when they are first asked for."""

    def __init__(self, df: int, top: int, blocks: bytes, postings: bytes):
        self.top, self.blocks, self.packed = top, np.frombuffer(blocks, _BLOCK), np.frombuffer(postings, np.uint8)
        self.first, self.last, self.tops = (self.blocks[c].astype(np.int64) for c in ("first", "last", "top"))
        self.begin = np.concatenate(([0], np.cumsum(self.blocks["size"], dtype=np.int64)))
        self.offset = np.concatenate(([0], np.cumsum(self.blocks["size"].astype(np.int64) * (self.blocks["gap"].astype(np.int64) + self.blocks["tf"]))))
        self.open = np.zeros(len(self.blocks), bool)
        self.docs, self.impacts = np.zeros(df, np.int64), np.zeros(df, np.int64)

    def unpack(self, which: np.ndarray, norms: np.ndarray) -> None:
        for i in which[~self.open[which]].tolist():
            b, (a, z) = self.blocks[i], self.begin[i : i + 2]
            planes = self.packed[self.offset[i] : self.offset[i + 1]].reshape(-1, z - a).astype(np.int64)
            whole = lambda x: x[0] if len(x) == 1 else (x << (8 * np.arange(len(x)))[:, None]).sum(0)
            self.docs[a:z] = docs = int(b["first"]) + np.cumsum(whole(planes[: b["gap"]]))
            self.impacts[a:z] = impact(whole(planes[b["gap"] :]), norms[docs])
            self.open[i] = True

    def within(self, a: int, z: int, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents from a to z (exclusive) and the impacts there."""
        i, j = int(np.searchsorted(self.last, a)), int(np.searchsorted(self.first, z))
        if i >= j:
            return self.docs[:0], self.impacts[:0]
        self.unpack(np.arange(i, j), norms)
        lo, hi = self.begin[i], self.begin[j]
        x, y = np.searchsorted(self.docs[lo:hi], (a, z))
        return self.docs[lo + x : lo + y], self.impacts[lo + x : lo + y]

    def bounds(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each document the block that it would be in and that block's largest impact, or 0 if it is in none."""
        i = np.searchsorted(self.last, docs)
        within = i < len(self.last)
        i = np.where(within, i, 0)
        within &= self.first[i] <= docs
        return i, np.where(within, self.tops[i], 0)

    def at(self, docs: np.ndarray, blocks: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Impacts in documents, each of which would be in the block given."""
        self.unpack(np.unique(blocks), norms)
        # Blocks that are not unpacked yet have no documents to search among, so each block is searched by itself.
        out = np.zeros(len(docs), np.int64)
        for b in np.unique(blocks).tolist():
            mine = np.flatnonzero(blocks == b)
            a, z = self.begin[b], self.begin[b + 1]
            i = np.minimum(a + np.searchsorted(self.docs[a:z], docs[mine]), z - 1)
            out[mine] = np.where(self.docs[i] == docs[mine], self.impacts[i], 0)
        return out


@dataclass
class Best:
    """The k best documents so far: by score, then id."""

    k: int
    floor: int
    scores: np.ndarray
    docs: np.ndarray

    @classmethod
    def of(cls, k: int, floor: int) -> Best:
        return cls(k, max(floor, 1), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def offer(self, scores: np.ndarray, docs: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.floor
        scores, docs = np.concatenate((self.scores, scores[good])), np.concatenate((self.docs, docs[good]))
        order = np.lexsort((ids[docs], -scores))[: self.k]
        self.scores, self.docs = scores[order], docs[order]
        if len(order) == self.k:
            self.floor = max(self.floor, int(self.scores[-1]))


def search_shard(lists: list[tuple[int, List]], norms: np.ndarray, ids: np.ndarray, k: int, floor: int) -> Best:
    """The k best documents of a shard for a query's lists, each with its weight, that have a score of floor or more. ids break ties."""
    lists = sorted((x for x in lists if x[0] > 0), key=lambda x: x[0] * x[1].top)
    upto = np.cumsum([w * x.top for w, x in lists])
    best = Best.of(k, floor)
    for a in range(0, len(norms), WINDOW):
        weak = int(np.searchsorted(upto, best.floor))
        if weak == len(lists):
            break
        z = min(a + WINDOW, len(norms))
        sums = np.zeros(z - a, np.int64)
        for w, x in lists[weak:]:
            docs, held = x.within(a, z, norms)
            sums[docs - a] += w * held
        docs = np.flatnonzero(sums)
        scores, docs = sums[docs], docs + a
        # What the blocks of the other lists may add at most decides before any is unpacked.
        near = [x.bounds(docs) for _, x in lists[:weak]]
        bound = scores + sum(w * most for (w, _), (_, most) in zip(lists, near, strict=False))
        for i in range(weak - 1, -1, -1):
            keep = bound >= best.floor
            scores, docs, bound = scores[keep], docs[keep], bound[keep]
            near = [(b[keep], most[keep]) for b, most in near[: i + 1]]
            (w, x), (blocks, most) = lists[i], near[i]
            there = np.flatnonzero(most)
            found = np.zeros(len(docs), np.int64)
            found[there] = x.at(docs[there], blocks[there], norms)
            scores, bound = scores + w * found, bound + w * (found - most)
        best.offer(scores, docs, ids)
    return best


def _answers(lists: DataFrame, queries: list[tuple[int, list[tuple[str, int]]]], floors: dict[int, int], size: tuple[int, int], k: int) -> DataFrame:
    """(query, id, score) of the k best documents of each shard for each query, those of at least the query's floor."""
    sent = lists.sparkSession.sparkContext.broadcast((queries, floors))

    def run(table: pa.Table) -> pa.Table:
        queries, floors = sent.value
        shard = {}
        for batch in table.to_batches():
            for k_ in range(len(batch)):
                term = batch.column("term")[k_].as_py()
                if term is None:
                    key, null = np.frombuffer(batch.column("ids")[k_].as_py(), np.int64).reshape(2, -1)
                    norms = norm(np.frombuffer(batch.column("lengths")[k_].as_py(), np.int64), *size)
                else:
                    shard[term] = List(*(batch.column(c)[k_].as_py() for c in ("df", "top", "blocks", "postings")))
        out = []
        for q, terms in queries:
            mine = [(w, shard[t]) for t, w in terms if t in shard]
            if mine:
                best = search_shard(mine, norms, key, k, floors.get(q, 0))
                out += [(q, None if null[d] else int(key[d]), int(s)) for d, s in zip(best.docs.tolist(), best.scores.tolist(), strict=True)]
        release()
        q, i, s = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], ["query", "id", "score"])

    return lists.groupBy("shard").applyInArrow(run, "query long, id long, score long")


def search(index: DataFrame, size: tuple[int, int], queries: DataFrame, k: int = 10, *, query_col: str = "text") -> DataFrame:
    """queries' columns with rank, id and score of the k best documents of an index of collection_size() size.

    A query's terms count once each; a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its df being counted over all
    shards. Equal scores rank by id, null ids last; documents without any score have no rank, so a query without known
    terms, null or empty has no rows. Equal queries are searched once each.
    """
    names = queries.columns
    asked = materialize(queries.select(F.monotonically_increasing_id().alias("query"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("of")), "queries")
    text = F.translate(F.coalesce(F.col(f"of.{query_col}").cast("string"), F.lit("")), UPPER, LOWER)
    terms = asked.select("query", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))).alias("term"))
    counts = index.where("term IS NOT NULL").select("term", "df").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * size[0] + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = materialize(terms.join(counts, "term").select("query", "term", weight.alias("weight")), "query-terms")
    lots = 1 + (weighed.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0) // LOT
    first = F.pmod(F.xxhash64("shard"), F.lit(SAMPLE)) == 0
    found = []
    for lot in range(lots):
        mine = weighed.where(F.pmod(F.xxhash64("query"), F.lit(lots)) == lot)
        sent = [(q, [tuple(x) for x in t]) for q, t in mine.groupBy("query").agg(F.collect_list(F.struct("term", "weight"))).collect()]  # about LOT bytes
        needed = index.join(mine.select("term").distinct(), "term", "left_semi").unionByName(index.where("term IS NULL")).select(*_NAMES)
        begun = materialize(_answers(needed.where(first), sent, {}, size, k), "answers")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc()))
        floors = {q: s for q, s in begun.withColumn("place", place).where(F.col("place") == k).select("query", "score").collect()}
        found += [begun, materialize(_answers(needed.where(~first), sent, floors, size, k), "answers")]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    ranked = every.withColumn("rank", rank).where(F.col("rank") <= k)
    return asked.join(ranked, "query").select(*(F.col("of").getField(c).alias(c) for c in names), "rank", "id", "score")


def op12_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents for each benchmark item; see search() and build_index() for nulls, ties and repeated rows."""
    docs = documents(spark, sf_dir)
    size = collection_size(docs)
    index = build_index(docs, size)
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return search(index, size, asked).select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), l AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0
), t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term
), f AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * l.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, l GROUP BY term, l.n
), q AS (
  SELECT k, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM (SELECT row_number() OVER () AS k, * FROM benchmark)
), s AS (
  SELECT k, item_id, r, doc_id, CAST(sum(f.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (10 + (90 * len(d.w) * l.n) // l.l)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN t USING (term) JOIN d USING (r), l GROUP BY ALL
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id ASC NULLS LAST, r) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
