"""Questions about all texts, answered one bucket of keys at a time.

Texts are kept in blocks, in a table that is bucketed by block. A block asks about keys (hashes of what its texts hold): its
distinct keys are sorted, cut by bucket (a range of keys) and shuffled as packed lists. A task then sorts the lists of all
blocks for one bucket, and answers each list with a code for each of its keys. Answers are joined to the blocks by block, so
that texts are never shuffled, and a block works out the same keys again to read them.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.shingles import as_bytes, enter, release, slices
from helixframe.llm.storage import shared_dir

#: Bytes of text in a block (a longer text is a block of its own) of a small corpus and of a large one, and in a bucket of the table of blocks.
BLOCK, LARGE_BLOCK, TABLE_BUCKET = 2 << 20, 64 << 20, 16 << 20
#: Blocks grow when there would be more than so many.
MANY_BLOCKS = 200_000
#: Keys in one bucket of keys, which a task sorts in memory, on average.
BUCKET = 3 << 19
#: A key that so many blocks have is crowded.
CROWDED = 64


def key_bits(keys: int) -> int:
    """Bits of a hash of which one in 65,536 meets another by chance among so many keys."""
    return min(62, max(1, keys).bit_length() + 16)


def bucket_bits(keys: int) -> int:
    """The logarithm of the number of buckets for so many keys."""
    return min(20, max(4, math.ceil(math.log2(keys / BUCKET + 1))))


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0


def pack(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, as planes of bytes, compressed."""
    x = x.astype(np.uint64, copy=False)
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(x).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes) -> np.ndarray:
    n, out = int.from_bytes(b[1:9], "little"), None
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[9:], max_output_size=max(1, b[0] * n)), np.uint8).reshape(b[0], n)
    out = np.zeros((n, 8), np.uint8)
    out[:, : b[0]] = planes.T
    return out.reshape(-1).view(np.uint64)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


@dataclass
class Block:
    """Texts end to end: text k has ids[k] (null where there is none) and stands from offsets[k] to offsets[k + 1]."""

    ids: pa.Array
    offsets: np.ndarray
    data: np.ndarray

    def row(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def texts(self) -> pa.Array:
        return pa.LargeStringArray.from_buffers(len(self.ids), pa.py_buffer(self.offsets.astype(np.int64).tobytes()), pa.py_buffer(self.data.tobytes()))


def write_blocks(docs: DataFrame, n_bytes: int, most: int | None = None) -> DataFrame:
    """docs: (id, text), n_bytes of text, in blocks of about most bytes (without, BLOCK or more for a large corpus). (block, ids, sizes, data) in the shared folder, bucketed by block: the texts in their order, without a shuffle; a null text is empty."""
    kind = docs.schema["id"].dataType.simpleString()
    most = most or min(LARGE_BLOCK, max(BLOCK, n_bytes // MANY_BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("blocks")
        held, size, number = [], 0, TaskContext.get().partitionId() << 32

        def made() -> pa.RecordBatch:
            ids, text = pa.concat_arrays([x for x, _ in held]), pa.concat_arrays([x.cast(pa.large_string()) for _, x in held])
            data, offsets = as_bytes(text)
            columns = [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([np.diff(offsets)], pa.list_(pa.int64())), pa.array([zstandard.ZstdCompressor(level=7).compress(data.tobytes())], pa.binary())]
            return pa.record_batch(columns, ["block", "ids", "sizes", "data"])

        for batch in batches:
            text = batch.column("text")
            for a, b in slices(text, most):
                held.append((batch.column("id")[a:b], text[a:b]))
                size += sum(pc.binary_length(text[a:b]).to_numpy())
                if size >= most:
                    yield made()
                    held, size, number = [], 0, number + 1
        if held:
            yield made()
        release()

    rows = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))
    buckets = min(20_000, max(8, -(-n_bytes // TABLE_BUCKET)))
    spark, name = docs.sparkSession, f"blocks_{uuid.uuid4().hex}"
    rows.mapInArrow(run, f"block long, ids array<{kind}>, sizes array<long>, data binary").write.format("parquet").bucketBy(buckets, "block").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


class Lists:
    """Keys in order, each once, dealt to buckets; and what is answered about them."""

    def __init__(self, order: np.ndarray, new: np.ndarray, keys: np.ndarray, bits: int, bucket: int):
        """order sorts the items by key (and more); new says, in that order, where a list entry begins; keys (of so many bits, bucket of which choose the bucket) are those of the entries."""
        self.first, self.keys, self.shift = np.flatnonzero(new), keys, np.uint64(bits - bucket)
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.bucket, self.begin = np.unique(keys >> self.shift, return_index=True)

    def ranges(self) -> Iterator[tuple[int, int, int]]:
        yield from zip(self.bucket.tolist(), self.begin.tolist(), [*self.begin[1:].tolist(), len(self.keys)][: len(self.begin)], strict=True)

    def rows(self, block: int, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {c: [] for c in _COLUMNS}
        for bucket, a, b in self.ranges():
            found["bucket"].append(bucket)
            found["block"].append(block)
            found["keys"].append(pack_sorted(self.keys[a:b] - (np.uint64(bucket) << self.shift)))
            for c in ("contexts", "ids", "flags"):
                found[c].append(pack(columns[c][a:b]) if c in columns else None)
        if found["bucket"]:
            yield pa.record_batch([pa.array(found[c], t) for c, t in _COLUMNS.items()], list(_COLUMNS))

    def answered(self, codes: dict[int, np.ndarray]) -> np.ndarray:
        """The code of each item."""
        out = np.zeros(len(self.keys), np.uint8)
        for bucket, a, b in self.ranges():
            if bucket in codes:
                out[a:b] = codes[bucket]
        return out[self.entry]


_COLUMNS = {"bucket": pa.int32(), "block": pa.int64(), "keys": pa.binary(), "contexts": pa.binary(), "ids": pa.binary(), "flags": pa.binary()}
#: The schemas of answers, those of step 0 being what a block has noted for itself, and of the lists that settle() reads.
ANSWER = "block long, step int, bucket int, codes binary"
DEALT = "bucket int, block long, keys binary, contexts binary, ids binary, flags binary"


def edges(*sorted_: np.ndarray) -> np.ndarray:
    new = np.zeros(len(sorted_[0]), bool)
    new[:1] = True
    for x in sorted_:
        new[1:] |= x[1:] != x[:-1]
    return new


def unsigned(ids: np.ndarray) -> np.ndarray:
    """Ids as unsigned numbers in the same order."""
    return ids.view(np.uint64) ^ np.uint64(1 << 63)


def each_block(table: DataFrame, answers: list[DataFrame], made: Callable, schema: str) -> DataFrame:
    """What made(block, its number, answers by step as {bucket: codes}) gives for each block."""
    names = ["block", "ids", "sizes", "data"]
    if answers:
        every = answers[0]
        for more in answers[1:]:
            every = every.unionByName(more)
        table = table.join(every.groupBy("block").agg(F.collect_list(F.struct("step", "bucket", "codes")).alias("answers")), "block", "left")
        names.append("answers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k] for c in names}
                ids, sizes = row["ids"].values, row["sizes"].values.to_numpy()
                raw = zstandard.ZstdDecompressor().decompress(row["data"].as_py(), max_output_size=max(1, int(sizes.sum())))
                codes: dict[int, dict[int, np.ndarray]] = {0: {}, 1: {}, 2: {}, 3: {}}
                for x in (row["answers"].as_py() or ()) if "answers" in row else ():
                    codes[x["step"]][x["bucket"]] = unpack(x["codes"]) if x["step"] == 0 else unpack(x["codes"]).astype(np.uint8)
                block = Block(ids, np.concatenate(([0], np.cumsum(sizes))), np.frombuffer(raw, np.uint8))
                yield from made(block, row["block"].as_py(), codes)
        release()

    return table.select(*names).mapInArrow(run, schema)


def settle(dealt: DataFrame, step: int, verdict: Callable) -> DataFrame:
    """(block, step, bucket, codes): the answers of verdict(lists of keys, contexts, ids and flags of all blocks) for one bucket at a time. Lists with nothing to tell are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("blocks")
        held, bucket = [], None

        def answer() -> Iterator[pa.RecordBatch]:
            columns = [[unpack_sorted(r["keys"]) for r in held], *([None if r[c] is None else unpack(r[c]) for r in held] for c in ("contexts", "ids", "flags"))]
            ends = np.cumsum([len(k) for k in columns[0]])
            codes = np.split(verdict(*(np.concatenate(c) if c[0] is not None else None for c in columns), ends), ends[:-1])
            told = [(r["block"], pack(c)) for r, c in zip(held, codes, strict=True) if c.any()]
            if told:
                block, packed = zip(*told, strict=True)
                yield pa.record_batch([pa.array(block, pa.int64()), pa.array([step] * len(told), pa.int32()), pa.array([bucket] * len(told), pa.int32()), pa.array(packed, pa.binary())], ["block", "step", "bucket", "codes"])

        for batch in batches:
            for k in range(len(batch)):
                r = {c: batch.column(c)[k].as_py() for c in _COLUMNS}
                if held and r["bucket"] != bucket:
                    yield from answer()
                    held = []
                bucket = r["bucket"]
                held.append(r)
        if held:
            yield from answer()
        release()

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, ANSWER)


def known_keys(keys, contexts, ids, flags, ends, crowded: int = CROWDED) -> np.ndarray:
    """A verdict for settle(): 1 for keys that are flagged or that several blocks have, 2 for those of crowded blocks or more."""
    order = np.argsort(keys)
    new = edges(keys[order])
    entry = np.empty(len(keys), np.int64)
    entry[order] = np.cumsum(new) - 1
    blocks, several = np.bincount(entry), np.bincount(entry, weights=flags) > 0
    return (np.where(blocks >= crowded, 2, (several | (blocks > 1)).astype(np.int8))[entry]).astype(np.uint8)
