"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of consecutive words, all of which a document has to hold side by side. The set of a
window is its shingles of a few words; as all of them are necessary, the prefix that a join has to look at is one shingle,
and the rarest one meets the fewest documents. So:

1. the shingles of all items are counted over all documents (one pass, in which a bitmap of bounded size keeps what no item
   has out of the counts), and a window takes the one that the fewest documents hold as its prefix token;
2. a second pass notes where documents hold prefix tokens, with the words around; these rows are joined to the windows by
   token;
3. a pair is dropped if the window would begin before or end after the document (its length, and the token's place in
   both), and the rest are compared word by word over the whole window.

A window with a shingle that no document holds is met by nothing. Texts are read where they are; only places of prefix tokens
are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.shingles import mix, release, slices, term_tables, word_spans
from helixframe.llm.storage import documents, materialize

#: Words of a window, and of a shingle (both of shorter items: all their words).
WINDOW, SHINGLE = 10, 3
#: The logarithm of a bitmap's bits for each token, and of all its bits at most (16 MB).
SPARSE, MOST_BITS = 10, 27
#: Places in one row; further ones of a document go to further rows.
PLACES = 1024
#: Bytes of windows that are sent to all executors; more are met in a shuffle.
SMALL = 16 << 20
_FACTORS = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def _hashed(h: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the shingles of size words that begin at each word; 0 where the text ends before."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(len(h), np.uint64)
    if n:
        sh = np.full(n, np.uint64(size))
        for j in range(size):
            sh = mix(sh * _FACTORS[0] + h[j : n + j] * _FACTORS[1] + _FACTORS[2])
        out[:n] = np.where(row[:n] == row[size - 1 :], sh | np.uint64(1), np.uint64(0))
    return out


def _word(data: np.ndarray, a: int, b: int) -> str:
    return data[a:b].tobytes().lower().decode()


def item_words(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, words, tokens, size): words of each item with any, and the hashes of its shingles of size words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            for a, b in slices(text):
                h, row, starts, ends, data = word_spans(text.slice(a, b - a), term_tables())
                begin = np.searchsorted(row, np.arange(b - a + 1))
                for k in range(b - a):
                    i, j = int(begin[k]), int(begin[k + 1])
                    if i < j:
                        size = min(SHINGLE, j - i)
                        words = [_word(data, *w) for w in zip(starts[i:j].tolist(), ends[i:j].tolist(), strict=True)]
                        tokens = _hashed(h[i:j], row[i:j], size)[: j - i - size + 1].view(np.int64)
                        yield pa.record_batch([batch.column("item")[a + k : a + k + 1], pa.array([words], pa.list_(pa.string())), pa.array([tokens], pa.list_(pa.int64())), pa.array([size], pa.int32())], ["item", "words", "tokens", "size"])
        release()

    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "item string, words array<string>, tokens array<long>, size int")


def bitmap(tokens: DataFrame) -> Broadcast:
    """Bits of the tokens' (column token) leading bits: (their number, bytes), at most 2 ** MOST_BITS bits however many tokens there are."""
    bits = min(MOST_BITS, max(15, tokens.count().bit_length() + SPARSE))
    slot = F.shiftrightunsigned("token", 64 - bits)
    made = tokens.groupBy(F.shiftright(slot, 15).alias("part")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    out = bytearray(1 << (bits - 3))
    for part, held in made.toLocalIterator():
        out[part << 12 : (part + 1) << 12] = held
    return tokens.sparkSession.sparkContext.broadcast((bits, bytes(out)))


def _may_hold(tokens: np.ndarray, bits: int, held: np.ndarray) -> np.ndarray:
    """Places of tokens that the bitmap may hold."""
    slot = tokens >> np.uint64(64 - bits)
    return np.flatnonzero(((held[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool) & (tokens != 0))


def document_counts(docs: DataFrame, known: Broadcast, sizes: Sequence[int]) -> DataFrame:
    """(token, df): by how many documents (column text) each token of the bitmap is held; and some others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held = known.value[0], np.frombuffer(known.value[1], np.uint8)
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            for a, b in slices(text):
                h, row, *_ = word_spans(text.slice(a, b - a), term_tables())
                for size in sizes:
                    tokens = _hashed(h, row, size)
                    at = _may_hold(tokens, bits, held)
                    order = np.lexsort((row[at], tokens[at]))
                    found, where = tokens[at][order], row[at][order]
                    once = np.ones(len(found), bool)
                    once[1:] = (found[1:] != found[:-1]) | (where[1:] != where[:-1])
                    token, n = np.unique(found[once], return_counts=True)
                    if len(token):
                        yield pa.record_batch([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "df"])
        release()

    return docs.select("text").mapInArrow(run, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))


def prefix_windows(classes: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows by their prefix token: (token, class, offset, first, last, width, words).

    classes: (class, words, tokens, size). Windows that begin at words first to last have the token at word offset; words
    are those of all these windows. Of a window's tokens the one that the fewest documents hold is taken, and of equal ones
    the smaller hash, then the earlier; windows with a token that no document holds are left out.
    """
    n = F.size("words")
    each = classes.select("class", n.alias("n"), "size", F.posexplode("tokens").alias("offset", "token"))
    ranked = each.join(counts, "token", "left").withColumn("x", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "offset"))
    width = F.least(F.col("n"), F.lit(WINDOW))
    along = Window.partitionBy("class").orderBy("offset")
    # Shorter items are one window, which has few shingles: the end of the item ends its rows.
    least = F.min("x").over(along.rowsBetween(0, WINDOW - SHINGLE))
    windows = ranked.withColumns({"width": width, "least": least}).where("offset <= n - width AND least.df > 0")
    taken = windows.groupBy("class", "width", F.col("least.offset").alias("at"), F.col("least.token").alias("token")).agg(F.min("offset").alias("first"), F.max("offset").alias("last"))
    words = F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + F.col("width"))
    return taken.join(classes.select("class", "words"), "class").select("token", "class", F.col("at").alias("offset"), "first", "last", "width", words.alias("words"))


def token_places(docs: DataFrame, known: Broadcast, sizes: Sequence[int]) -> DataFrame:
    """Of docs (id, text) a row (row, id, n_words, places) each, and where there are very many places further rows without n_words.

    A place is a word at which a token of the bitmap may begin: (token, at, from, held), held being the words within a window of
    it on both sides, from word number from on.
    """
    kind = docs.schema["id"].dataType
    place = pa.struct([("token", pa.int64()), ("at", pa.int64()), ("from", pa.int64()), ("held", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held = known.value[0], np.frombuffer(known.value[1], np.uint8)
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            for a, b in slices(text):
                h, row, starts, ends, data = word_spans(text.slice(a, b - a), term_tables())
                begin = np.searchsorted(row, np.arange(b - a + 1))
                places: dict[int, list] = {}
                for size in sizes:
                    tokens = _hashed(h, row, size)
                    for i in _may_hold(tokens, bits, held).tolist():
                        k = int(row[i])
                        lo, hi = max(int(begin[k]), i - WINDOW + size), min(int(begin[k + 1]), i + WINDOW)
                        words = [_word(data, *w) for w in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)]
                        places.setdefault(k, []).append({"token": int(tokens[i].view(np.int64)), "at": i - int(begin[k]), "from": lo - int(begin[k]), "held": words})
                rows = range(number, number + b - a)
                n = np.diff(begin)
                yield pa.record_batch([pa.array(rows, pa.int64()), batch.column("id")[a:b], pa.array(n, pa.int64()), pa.array([places.get(k, [])[:PLACES] for k in range(b - a)], pa.list_(place))], ["row", "id", "n_words", "places"])
                for k, more in places.items():
                    for c in range(PLACES, len(more), PLACES):
                        yield pa.record_batch([pa.array([rows[k]], pa.int64()), batch.column("id")[a + k : a + k + 1], pa.array([None], pa.int64()), pa.array([more[c : c + PLACES]], pa.list_(place))], ["row", "id", "n_words", "places"])
                number += b - a
        release()

    return docs.mapInArrow(run, f"row long, id {kind.simpleString()}, n_words long, places array<struct<token: long, at: long, from: long, held: array<string>>>")


def benchmark_spans(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where documents hold windows of benchmark items.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z as a-z. A window is WINDOW terms of an item in their
    order, or all of an item that has fewer. Returns three tables:
    rows (row, id, n_words): one for each row of docs; spans (row, start, end, class): each occurrence of a window, as word
    numbers, end exclusive; members (class, item): items, as text, with the same terms in the same order are one class.

    Null and empty texts have no terms; items without terms have no windows; a null item is the item '' (empty). Rows with
    the same id are documents of their own, and null ids stay. Without documents or items the tables are empty.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    listed = materialize(item_words(items, item_col, item_text_col).withColumn("class", F.sha2(F.array_join("words", " "), 256)), "items")
    members = listed.select("class", "item").distinct()
    classes = materialize(listed.dropDuplicates(["class"]).select("class", "words", "tokens", "size"), "item-classes")
    sizes = sorted(r[0] for r in classes.select("size").distinct().collect())  # at most SHINGLE
    every = classes.select(F.explode("tokens").alias("token")).distinct()
    known = bitmap(every)
    counts = document_counts(texts, known, sizes).join(every, "token", "left_semi")
    windows = materialize(prefix_windows(classes, counts), "item-windows")
    known.unpersist()
    placed = materialize(token_places(texts, bitmap(windows.select("token").distinct()), sizes), "token-places")
    size = windows.agg(F.sum(F.length(F.array_join("words", " ")) + 64)).first()[0] or 0
    met = placed.select("row", F.explode("places").alias("p")).select("row", "p.*").join(F.broadcast(windows) if size <= SMALL else windows, "token")
    # All words that a document has around the token are at hand, so its ends bound the windows that can be there.
    begins = F.col("at") - F.col("offset")
    low = F.greatest(F.col("first"), F.col("from") - begins)
    high = F.least(F.col("last"), F.col("from") + F.size("held") - F.col("width") - begins)
    bounded = met.withColumns({"low": low, "high": high}).where("low <= high")
    here = lambda w: F.slice("held", (w + begins - F.col("from") + 1).cast("int"), F.col("width")) == F.slice("words", (w - F.col("first") + 1).cast("int"), F.col("width"))
    found = bounded.withColumn("w", F.explode(F.filter(F.sequence("low", "high"), here)))
    spans = found.select("row", (F.col("w") + begins).alias("start"), (F.col("w") + begins + F.col("width")).alias("end"), "class")
    return placed.where("n_words IS NOT NULL").select("row", "id", "n_words"), spans, members


def contamination(docs: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of docs; see benchmark_spans() for its arguments and odd rows.

    n_hit counts the terms inside any span, n_items the items with a span; their names, sorted and joined by commas, are
    hashed. A row without a span has the hash of the empty text.
    """
    rows, spans, members = benchmark_spans(docs, items, **columns)
    spans = materialize(spans.distinct(), "benchmark-spans")
    before = F.max("end").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce(before, F.col("start"))), F.lit(0))
    hits = spans.select("row", "start", "end").distinct().withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    named = spans.select("row", "class").distinct().join(members, "class").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = rows.join(hits.join(named, "row"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    found = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("id", "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), F.sha2(F.array_join(found, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op11_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they hold a window of; see contamination() and benchmark_spans() for nulls, ties and repeated rows."""
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("id", "doc_id")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), u AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS u
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), s AS (SELECT DISTINCT n FROM u
), p AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS u FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n)
), f AS (SELECT DISTINCT p.r, p.i, p.n, u.item FROM p JOIN u ON p.n = u.n AND p.u = u.u
), h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM f) GROUP BY r
), m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM f) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN m USING (r)
"""
