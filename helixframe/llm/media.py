"""Media columns: content-defined chunking of payloads, with chunks deduplicated by digest.

A payload is stored as the samples of a binary grey-scale image (PGM, 64 samples a row, 8 bits each). The image is cut
where a rolling gear hash of its last 32 bytes has its top bits zero, so equal passages give equal chunks wherever they
stand. A chunk is named by the first bytes of its SHA-256. Three tables come of it: manifests (payload -> ordered digests), the chunk store
(digest -> compressed bytes, each once) and, read back, the media rebuilt from both and checked against the manifest.
"""

from __future__ import annotations

import bz2
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.shingles import slices
from helixframe.llm.storage import documents, materialize

ROW = 64
#: Chunk sizes in bytes: least, 2 ** AVERAGE_BITS beyond that on average, most. Most texts have some thousand bytes, so chunks are smaller than that.
LEAST, AVERAGE_BITS, MOST = 256, 10, 65536
#: Bytes worked on at once (a longer payload is still taken whole).
PART = 4 << 20
#: Compressed bytes of payloads that make up a pack of the store.
PACK = 200_000
#: Bytes of SHA-256 that name a payload and a chunk.
KEY_BYTES, DIGEST_BYTES = 16, 12
GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def to_media(payload: bytes) -> bytes:
    """PGM with the payload as samples, padded with zeros to whole rows, one row at least."""
    rows = max(1, -(-len(payload) // ROW))
    return b"P5\n%d %d\n255\n" % (ROW, rows) + payload.ljust(rows * ROW, b"\0")


def samples(media: bytes) -> bytes:
    """The samples of a PGM as to_media() writes it."""
    kind, size, top, data = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or top != b"255" or len(data) != width * height:
        raise ValueError("not a grey-scale image of 8-bit samples")
    return data


def cut_points(data: np.ndarray, least: int = LEAST, bits: int = AVERAGE_BITS, most: int = MOST) -> list[int]:
    """Ends of the chunks of data (bytes as uint8), the last of which is len(data)."""
    n = len(data)
    if n <= least:
        return [n]
    h = GEAR[data]
    for s in (1, 2, 4, 8, 16):  # doubles the number of bytes that a hash covers
        more = h.copy()
        more[s:] += h[:-s] << np.uint32(s)
        h = more
    places = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    ends, start = [], 0
    while n - start > least:
        k = int(np.searchsorted(places, start + least))
        end = min(int(places[k]) if k < len(places) else n, start + most, n)
        ends.append(end)
        start = end
    return ends if ends and ends[-1] == n else [*ends, n]


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:DIGEST_BYTES]


def _chunks(payload: bytes) -> tuple[bytes, list[bytes]]:
    media = to_media(payload)
    ends = cut_points(np.frombuffer(media, np.uint8))
    return media, [media[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def payload_key(payload: bytes) -> bytes:
    return hashlib.sha256(payload).digest()[:KEY_BYTES]


def manifests(payloads: DataFrame) -> DataFrame:
    """payloads: (payload binary). One row per distinct payload: (payload_key, media_sha256, digests, sizes); digests and sizes are those of the chunks of its medium, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), PART):
                out = {}
                for payload in (x.as_py() for x in batch.column(0)[a:b]):
                    if (key := payload_key(payload)) not in out:
                        media, chunks = _chunks(payload)
                        out[key] = (hashlib.sha256(media).digest(), [digest(c) for c in chunks], [len(c) for c in chunks])
                sha, digests, sizes = zip(*out.values(), strict=True) if out else ((),) * 3
                yield pa.record_batch([pa.array(out.keys(), pa.binary()), pa.array(sha, pa.binary()), pa.array(digests, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int32()))], ["payload_key", "media_sha256", "digests", "sizes"])

    return payloads.select("payload").mapInArrow(run, "payload_key binary, media_sha256 binary, digests array<binary>, sizes array<int>").dropDuplicates(["payload_key"])


def chunk_holders(listed: DataFrame) -> DataFrame:
    """(payload_key, digest, holder) of the chunks that several manifests list: the holder, the least key of them, is the one whose pack stores the chunk. A chunk of very many payloads is summed before it is shuffled, and joined, not collected."""
    each = listed.select("payload_key", F.explode(F.array_distinct("digests")).alias("digest"))
    held = each.groupBy("digest").agg(F.min("payload_key").alias("holder"), F.max("payload_key").alias("last")).where("holder < last")
    return each.join(held.select("digest", "holder"), "digest")


_STORE = "media array<struct<payload_key:binary,media_sha256:binary,digests:array<binary>,sizes:array<int>,foreign:array<binary>,lent:array<binary>>>, data binary"


def _own(digests: list[bytes], sizes: list[int], foreign: list[bytes] | None) -> Iterator[tuple[bytes, int, int]]:
    """(digest, start, end) of the chunks that a pack stores: each once, without those that others hold."""
    seen, at = set(foreign or ()), 0
    for d, n in zip(digests, sizes, strict=True):
        if d not in seen:
            seen.add(d)
            yield d, at, at + n
        at += n


def chunk_packs(payloads: DataFrame, listed: DataFrame, holders: DataFrame) -> DataFrame:
    """The chunk store, a row per pack: (media, data). Each distinct chunk of all payloads is stored once, in the pack of its holder.

    media describes the payloads of the pack: their chunks in order, which of them others hold (foreign) and which others
    borrow (lent); data holds the chunks that are not foreign, end to end, compressed together. Each distinct payload is
    shuffled once, compressed; copies within a batch meet before.
    """

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), PART):
                out = {}
                for payload in (x.as_py() for x in batch.column(0)[a:b]):
                    if (key := payload_key(payload)) not in out:
                        out[key] = bz2.compress(to_media(payload), 1)
                yield pa.record_batch([pa.array(out.keys(), pa.binary()), pa.array(out.values(), pa.binary())], ["payload_key", "packed"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("packed"), PACK):
                part = batch.slice(a, b - a)
                data = []
                for packed, digests, sizes, foreign in zip(*(part.column(c).to_pylist() for c in ("packed", "digests", "sizes", "foreign")), strict=True):
                    media = bz2.decompress(packed)
                    data += [media[x:y] for _, x, y in _own(digests, sizes, foreign)]
                rows = pa.StructArray.from_arrays([part.column(c) for c in _FIELDS], _FIELDS)
                listed = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), rows)
                yield pa.record_batch([listed, pa.array([bz2.compress(b"".join(data), 9)], pa.binary())], ["media", "data"])

    shipped = payloads.select("payload").mapInArrow(ship, "payload_key binary, packed binary").dropDuplicates(["payload_key"])
    foreign = holders.where("holder <> payload_key").groupBy("payload_key").agg(F.collect_list("digest").alias("foreign"))
    lent = holders.where("holder = payload_key").groupBy("payload_key").agg(F.collect_list("digest").alias("lent"))
    full = shipped.join(listed, "payload_key").join(foreign, "payload_key", "left").join(lent, "payload_key", "left")
    return full.select(*_FIELDS, "packed").mapInArrow(pack, _STORE)


_FIELDS = ["payload_key", "media_sha256", "digests", "sizes", "foreign", "lent"]


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict[bytes, bytes]]]:
    """Each payload of the packs, and its chunks in the store."""
    for batch in batches:
        for media, data in zip(batch.column("media"), batch.column("data"), strict=True):
            raw, at = bz2.decompress(data.as_py()), 0
            for x in media:
                m, there = x.as_py(), {}
                for d, a, b in _own(m["digests"], m["sizes"], m["foreign"]):
                    there[d] = raw[at : at + b - a]
                    at += b - a
                yield m, there


def _joined(m: dict, there: dict[bytes, bytes]) -> bytes:
    if any(d not in there or digest(there[d]) != d for d in m["digests"]):
        raise ValueError("a chunk is missing or not what its digest says")
    media = b"".join(there[d] for d in m["digests"])
    if hashlib.sha256(media).digest() != m["media_sha256"]:
        raise ValueError("rebuilt media differ from their manifest")
    return media


def _lots(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str], most: int = PART) -> Iterator[pa.RecordBatch]:
    """Record batches of rows whose last values are about most bytes together."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= most:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def rebuild(packs: DataFrame, holders: DataFrame) -> DataFrame:
    """Media of all payloads, read from the store: (payload_key, media). A missing chunk, one with a wrong digest, or media that differ from their manifest raise.

    Chunks that others hold are taken out of their packs and joined to the payloads that list them.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((m["payload_key"], _joined(m, there)) for m, there in _stored(batches) if not m["foreign"])
        yield from _lots(rows, [pa.binary(), pa.binary()], ["payload_key", "media"])

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((d, bz2.compress(there[d], 1)) for m, there in _stored(batches) for d in m["lent"] or ())
        yield from _lots(rows, [pa.binary(), pa.binary()], ["digest", "chunk"])

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((m["payload_key"], m["media_sha256"], m["digests"], list(there), list(map(len, there.values())), bz2.compress(b"".join(there.values()), 1)) for m, there in _stored(batches) if m["foreign"])
        yield from _lots(rows, [pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()], ["payload_key", "media_sha256", "digests", "own", "sizes", "data"])

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[bytes, bytes]]:
            for batch in batches:
                for k in range(len(batch)):
                    m = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                    raw, ends = bz2.decompress(m["data"]), np.cumsum([0, *m["sizes"]]).tolist()
                    there = {d: raw[a:b] for d, a, b in zip(m["own"], ends, ends[1:], strict=False)}
                    yield m["payload_key"], _joined(m, there | {x["digest"]: bz2.decompress(x["chunk"]) for x in m["borrowed"] or ()})

        yield from _lots(rows(), [pa.binary(), pa.binary()], ["payload_key", "media"])

    lends = F.exists("media", lambda m: m["lent"].isNotNull())
    borrows = F.exists("media", lambda m: m["foreign"].isNotNull())
    chunks = packs.where(lends).mapInArrow(lend, "digest binary, chunk binary")
    borrowed = holders.where("holder <> payload_key").select("payload_key", "digest").join(chunks, "digest").groupBy("payload_key").agg(F.collect_list(F.struct("digest", "chunk")).alias("borrowed"))
    parts = packs.where(borrows).mapInArrow(partly, "payload_key binary, media_sha256 binary, digests array<binary>, own array<binary>, sizes array<int>, data binary")
    done = parts.join(borrowed, "payload_key", "left").mapInArrow(complete, "payload_key binary, media binary")
    return packs.mapInArrow(whole, "payload_key binary, media binary").unionByName(done)


def media_features(media: DataFrame) -> DataFrame:
    """media: (payload_key, media). Hashes of the samples and of the media, and image features as text: rows, mean, standard deviation and entropy of the samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for m in (x.as_py() for x in batch.column("media")):
                data = samples(m)
                counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.float64)
                p, level = counts / counts.sum(), np.arange(256)
                mean = float(p @ level)
                spread = float(np.sqrt(max(0.0, p @ (level - mean) ** 2)))
                p = p[p > 0]
                feature = f"rows={len(data) // ROW};mean={mean:.6f};std={spread:.6f};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.6f}"
                out.append((len(data), hashlib.sha256(data).digest(), zlib.crc32(data[-ROW:]), len(m), hashlib.sha256(m).digest(), feature))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.record_batch([batch.column("payload_key"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["payload_key", *names])

    return media.select("payload_key", "media").mapInArrow(run, "payload_key binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string")


def media_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as chunked media, read it back and describe it; one row per input row.

    A null text is the empty payload (one row of zeros). Work is done once per distinct text; ids may repeat or be null.
    Rows of a text with very many copies meet its features in a plain join, which Spark splits.
    """
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), payload.alias("payload"))
    listed = materialize(manifests(rows), "manifests")
    holders = materialize(chunk_holders(listed), "chunk-holders")
    packs = materialize(chunk_packs(rows, listed, holders), "chunk-packs")
    features = media_features(rebuild(packs, holders))
    described = rows.select("id", F.octet_length("payload").cast("long").alias("n_bytes"), F.substring(F.unhex(F.sha2("payload", 256)), 1, KEY_BYTES).alias("payload_key")).join(features, "payload_key")
    return described.drop("payload_key").withColumns({c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256")})


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and features of every document's stored media; a null text is the empty payload, equal texts give equal values."""
    return media_digests(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
