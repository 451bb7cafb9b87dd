"""Exact substring dedup: bytes covered by strings of a fixed length that an earlier document has.

The suffixes of all texts that matter are sorted one bucket at a time, by way of a difference cover. A cover of modulus v
is a set of residues such that for any two positions i and j some d < v has both i + d and j + d in it (counted from the
start of their texts, modulo v). So any two equal windows of `length` bytes, wherever they start, have a cover sample at the
same offset d, and from there on equal strings of length - v + 1 bytes. Texts are kept in blocks, and three steps ask about
them, each answered one bucket (a range of keys) at a time:

1. The cover samples of all blocks are sorted by their strings, which ranks them. Samples whose string only one document has
   get no rank: no suffix is tied with them.
2. Suffixes that hold a ranked sample are tied as far as ranks tell. They are sorted by rank and context (all windows that
   hold the sample at an offset below v). Where a smaller id has the same rank and context, all these windows are covered;
   that settles nearly everything within long repeats without looking at single suffixes.
3. Where one rank has several contexts, at the ends of repeats, the windows that are still open are sorted by themselves.

Buckets travel as sorted, packed lists, one for each block, and answers come back as codes in the order of the list. The table
of blocks is bucketed by block, so that answers are joined to texts and texts are never shuffled. Strings are compared by
hashes: of the samples, to so many bits that one in 65,536 meets another by chance (which costs work only), and of contexts
and windows to 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.blocks import ANSWER, CROWDED, DEALT, Block, Lists, bucket_bits, each_block, edges, key_bits, known_keys, pack, settle, text_bytes, unsigned, write_blocks
from helixframe.llm.shingles import mix
from helixframe.llm.storage import documents, materialize

LENGTH = 50
#: Perfect difference sets by their modulus.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
#: Positions hashed at once.
STEP = 1 << 19
_R = 0x9E3779B97F4A7C15


def difference_cover(length: int) -> tuple[int, tuple[int, ...]]:
    """The largest cover whose samples leave strings of at least its modulus."""
    v = max((v for v in COVERS if 2 * v <= length + 1), default=3)
    return v, COVERS[v]


@lru_cache(1)
def _values() -> np.ndarray:
    return np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64)


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of size bytes, by joining hashes of half the size."""

    def join(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
        n = len(data) - n_a - n_b + 1
        return a[:n] * np.uint64(pow(_R, n_b, 2**64)) + b[n_a : n_a + n]

    if len(data) < size:
        return np.zeros(0, np.uint64)
    power, n, made, m = _values()[data], 1, None, 0
    while n <= size:
        if size & n:
            made, m = (power, n) if made is None else (join(made, power, m, n), m + n)
        if 2 * n <= size:
            power = join(power, power, n, n)
        n *= 2
    return mix(made)


def hash_at(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the strings of size bytes at these places, in increasing order; STEP places are looked at at once, however long a text is."""
    out = np.zeros(len(at), np.uint64)
    for a in range(0, len(data), STEP):
        i, j = np.searchsorted(at, (a, a + STEP))
        if i < j:
            out[i:j] = rolling(data[a : a + STEP + size - 1], size)[at[i:j] - a]
    return out


@dataclass(frozen=True)
class Plan:
    """length, the cover's modulus and residues, the length of a sample's string, the bits of its hash that are compared, and those that choose a bucket."""

    length: int
    modulus: int
    cover: tuple[int, ...]
    key: int
    bits: int
    bucket_bits: int

    @classmethod
    def of(cls, n_bytes: int, length: int) -> Plan:
        modulus, cover = difference_cover(length)
        samples = max(1, n_bytes * len(cover) // modulus)
        return cls(length, modulus, cover, length - modulus + 1, key_bits(samples), bucket_bits(samples))


class Work:
    """A block's questions, and what follows from the answers. The same block gives the same questions again."""

    def __init__(self, plan: Plan, b: Block, known: dict[int, np.ndarray] | None = None):
        """known: what ranked_rows() noted, if it has been there already; then only ranked samples are looked at."""
        self.plan, self.b = plan, b
        self.id = pc.fill_null(b.ids, 0).to_numpy()
        if known is not None:
            none = np.zeros(0, np.uint64)
            self.at, self.rank, self.crowded = known.get(0, none).astype(np.int64), known.get(1, none), known.get(2, none) == 2
            self.ids = unsigned(self.id[b.row(self.at)])
            return
        named, sizes = np.asarray(b.ids.is_valid()), np.diff(b.offsets)
        mask = np.zeros(len(b.data), bool)
        for k in np.flatnonzero(named & (sizes >= plan.length)).tolist():
            start, end = int(b.offsets[k]), int(b.offsets[k + 1])
            for c in plan.cover:
                mask[start + c : end - plan.key + 1 : plan.modulus] = True
        self.at = np.flatnonzero(mask)
        self.rank = hash_at(b.data, self.at, plan.key) >> np.uint64(64 - plan.bits)
        self.ids = unsigned(self.id[b.row(self.at)])

    def samples(self) -> tuple[Lists, np.ndarray]:
        """Step 1: the samples by rank, and which of them two ids of the block have."""
        order = np.argsort(self.rank)
        ranked, ids = self.rank[order], self.ids[order]
        new = edges(ranked)
        first = np.flatnonzero(new)
        lists = Lists(order, new, ranked[first], self.plan.bits, self.plan.bucket_bits)
        several = np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first) if len(first) else np.zeros(0, bool)
        return lists, several

    def contexts(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows that hold a sample at an offset below the modulus, cut at the text's ends."""
        back, size = self.plan.modulus - 1, self.plan.length + self.plan.modulus - 1
        row = self.b.row(at)
        start, end = self.b.offsets[row], self.b.offsets[row + 1]
        whole = (at - back >= start) & (at - back + size <= end)
        out = np.zeros(len(at), np.uint64)
        out[whole] = hash_at(self.b.data, at[whole] - back, size)
        power = np.array([pow(_R, j, 2**64) for j in range(size)], np.uint64)
        cut = np.flatnonzero(~whole)
        for k in range(0, len(cut), 10_000):
            part = cut[k : k + 10_000]
            place = at[part, None] - back + np.arange(size)
            there = (place >= start[part, None]) & (place < end[part, None])
            x = _values()[self.b.data[np.clip(place, 0, len(self.b.data) - 1)]] * there
            shape = (np.maximum(start[part] - at[part] + back, 0) * size + np.minimum(end[part] - at[part], size)).astype(np.uint64)
            out[part] = mix((x * power).sum(1, dtype=np.uint64) + mix(shape + np.uint64(1)))
        return out

    def ranked_rows(self, number: int, codes: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """After step 1: the places, ranks and codes of the ranked samples, as answers of step 0."""
        code = self.samples()[0].answered(codes)
        known = np.flatnonzero(code)
        if len(known):
            packed = [pack(x) for x in (self.at[known].astype(np.uint64), self.rank[known], code[known])]
            yield pa.record_batch([pa.array([number] * 3, pa.int64()), pa.array([0] * 3, pa.int32()), pa.array([0, 1, 2], pa.int32()), pa.array(packed, pa.binary())], ["block", "step", "bucket", "codes"])

    def contexts_of_ranks(self) -> None:
        """Step 2: the ranked samples, by rank and context, or by both together where a rank is crowded."""
        context = self.contexts(self.at)
        key = np.where(self.crowded, mix(self.rank ^ context) >> np.uint64(64 - self.plan.bits), self.rank)
        order = np.lexsort((self.ids, context, key))
        new = edges(key[order], context[order])
        first = order[new]
        self.lists = Lists(order, new, key[first], self.plan.bits, self.plan.bucket_bits)
        self.columns = {"contexts": context[first], "ids": self.ids[first], "flags": self.crowded[first]}
        self.later = self.ids > self.ids[first][self.lists.entry]

    def windows(self, codes: dict[int, np.ndarray]) -> None:
        """After step 2: the covered windows, and those still open."""
        code = self.lists.answered(codes)
        covered = self.later | (code == 1)
        self.covered = self._windows_of(self.at[covered])
        self.open = np.flatnonzero(self._windows_of(self.at[~covered & (code == 2)]) & ~self.covered)
        h, self.ids = hash_at(self.b.data, self.open, self.plan.length), unsigned(self.id[self.b.row(self.open)])
        order = np.lexsort((self.ids, h))
        new = edges(h[order])
        first = order[new]
        self.lists = Lists(order, new, h[first], 64, self.plan.bucket_bits)
        self.columns = {"ids": self.ids[first]}
        self.later = self.ids > self.ids[first][self.lists.entry]

    def _windows_of(self, at: np.ndarray) -> np.ndarray:
        """A mask of the windows (by their first bytes) that hold the samples at an offset below the modulus."""
        row = self.b.row(at)
        first = np.maximum(at - self.plan.modulus + 1, self.b.offsets[row])
        last = np.minimum(at, self.b.offsets[row + 1] - self.plan.length)
        return _mask(first, last + 1, len(self.b.data))

    def gone(self, codes: dict[int, np.ndarray]) -> np.ndarray:
        """After step 3: a mask of the covered bytes."""
        self.covered[self.open[self.later | (self.lists.answered(codes) == 1)]] = True
        start = np.flatnonzero(self.covered)
        return _mask(start, start + self.plan.length, len(self.b.data))


def _mask(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    depth = np.bincount(start, minlength=n + 1).astype(np.int32)
    depth -= np.bincount(end, minlength=n + 1).astype(np.int32)
    return np.cumsum(depth, out=depth)[:n] > 0


def sort_contexts(keys, contexts, ids, flags, ends) -> np.ndarray:
    """1 where a smaller id has the key with the same context, 2 for the smallest ids of a context whose key has others too, or is crowded."""
    order = np.lexsort((ids, contexts, keys))
    new_key = edges(keys[order])
    new = new_key | edges(contexts[order])
    entry, of_key = np.cumsum(new) - 1, np.cumsum(new_key) - 1
    least = ids[order][np.flatnonzero(new)][entry]
    several = np.bincount(of_key[np.flatnonzero(new)])[of_key] > 1
    out = np.empty(len(keys), np.uint8)
    out[order] = np.where(ids[order] > least, 1, np.where(several | (flags[order] > 0), 2, 0))
    return out


def sort_windows(keys, contexts, ids, flags, ends) -> np.ndarray:
    """1 for windows that a smaller id has."""
    order = np.lexsort((ids, keys))
    new = edges(keys[order])
    out = np.empty(len(keys), np.uint8)
    out[order] = ids[order] > ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block: int | None = None, crowded: int = CROWDED) -> DataFrame:
    """Remove each byte covered by a string of length bytes that also starts in a document with a smaller id.

    One row (id, n_bytes, n_removed, n_spans, kept_sha256, kept) per input row. Texts are UTF-8 bytes, a null text is
    empty; matches never cross documents, overlaps count, and strings are judged on the input. Rows with equal ids are
    not repeats of each other. A row with a null id keeps its text and is nobody's earlier document. Other columns are not looked at. A block's
    text and its samples are in memory at once, so that a text of 100 MB takes a task about 1 GB.
    """
    if length < 5:
        raise ValueError("length: 5 or more")
    n_bytes = text_bytes(docs, text_col)
    plan = Plan.of(n_bytes, length)
    table = write_blocks(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), n_bytes, block)

    def step_1(b: Block, number: int, codes: dict) -> Iterator[pa.RecordBatch]:
        lists, several = Work(plan, b).samples()
        yield from lists.rows(number, flags=several)

    def ranks(b: Block, number: int, codes: dict) -> Iterator[pa.RecordBatch]:
        yield from Work(plan, b).ranked_rows(number, codes[1])

    def step_2(b: Block, number: int, codes: dict) -> Iterator[pa.RecordBatch]:
        (work := Work(plan, b, codes[0])).contexts_of_ranks()
        yield from work.lists.rows(number, **work.columns)

    def step_3(b: Block, number: int, codes: dict) -> Iterator[pa.RecordBatch]:
        (work := Work(plan, b, codes[0])).contexts_of_ranks()
        work.windows(codes[2])
        yield from work.lists.rows(number, **work.columns)

    def cut_out(b: Block, number: int, codes: dict) -> Iterator[pa.RecordBatch]:
        (work := Work(plan, b, codes[0])).contexts_of_ranks()
        work.windows(codes[2])
        gone = work.gone(codes[3])
        out = []
        for id_, start, end in zip(b.ids.to_pylist(), b.offsets[:-1].tolist(), b.offsets[1:].tolist(), strict=True):
            hit = gone[start:end]
            kept = b.data[start:end][~hit].tobytes()
            out.append((id_, end - start, end - start - len(kept), int(hit[:1].sum()) + int((hit[1:] & ~hit[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    def asked(answers: list[DataFrame], number: int, ask: Callable, verdict: Callable) -> DataFrame:
        return materialize(settle(each_block(table, answers, ask, DEALT), number, verdict), f"answers-{number}")

    known = asked([], 1, step_1, partial(known_keys, crowded=crowded))
    answers = [materialize(each_block(table, [known], ranks, ANSWER), "ranks")]
    answers.append(asked(answers, 2, step_2, sort_contexts))
    answers.append(asked(answers, 3, step_3, sort_windows))
    return each_block(table, answers, cut_out, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps without the 50-byte strings that a smaller doc_id has; see remove_repeats() for nulls, ties and repeated rows."""
    return remove_repeats(documents(spark, sf_dir)).drop("kept").withColumnRenamed("id", "doc_id")


ORACLE = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
pc AS MATERIALIZED (SELECT doc_id, n, j, substr(h, 1000 * j + 1, 1098) AS x FROM (SELECT doc_id, h, n, unnest(generate_series(0, (n - 50) // 500)) AS j FROM d WHERE n >= 50)),
w AS MATERIALIZED (SELECT doc_id, 500 * j + i AS p, substr(x, 2 * i + 1, 100) AS x FROM (SELECT doc_id, j, x, unnest(generate_series(0, least(499, n - 50 - 500 * j))) AS i FROM pc)),
f AS (SELECT x, min(doc_id) AS least FROM w GROUP BY x HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM w JOIN f USING (x) WHERE least < doc_id),
g AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM c),
sp AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, k),
ed AS (SELECT doc_id, list(struct_pack(a := a, b := b) ORDER BY a) AS s, count(*) AS n_spans, sum(b - a) AS removed FROM sp GROUP BY doc_id),
kp AS (SELECT d.doc_id, n, coalesce(removed, 0) AS removed, coalesce(n_spans, 0) AS n_spans, CASE WHEN s IS NULL THEN h ELSE
  array_to_string(list_transform(generate_series(1, len(s) + 1), lambda i: substr(h, 2 * CASE WHEN i = 1 THEN 0 ELSE s[i - 1].b END + 1, 2 * (CASE WHEN i > len(s) THEN n ELSE s[i].a END - CASE WHEN i = 1 THEN 0 ELSE s[i - 1].b END))), '') END AS kept FROM d LEFT JOIN ed USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM kp
"""
