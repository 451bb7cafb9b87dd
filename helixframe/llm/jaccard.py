"""N-gram Jaccard self-join by a token-group matrix.

Documents with one and the same shingle set are one class. Links between classes are found in three steps, each of which
bounds overlaps before it opens anything:

1. The union of all other classes bounds what a class can share with any: classes of whose shingles too many are their own
   cannot link, and go no further. Which shingles several classes have is settled in buckets of shingle hashes (see blocks).
2. The remaining classes are partitioned into groups of similar ones. A class's shingles are dealt by hash into as many
   parts as two linked sets can differ in, and a few more; two linked sets have one equal part at least (they differ in
   fewer shingles than there are parts). Each class is put to the least class of each of its parts; then, where classes
   that share a part are not connected yet, groups are rows of at most ROW classes on average, and a class is a query to
   the rows whose parts it shares. Shingles are sent to those rows only.
3. A row of the token-group matrix holds the union of its members' shingles and which member has which. A query whose
   overlap with the union is below what any member asks for does not open the row; else its overlaps with all members are
   counted at once, along its shingles' lines of the matrix.

Whole sets are compared, so no link is wrong, and none is lost. A task holds one row and a block of queries; what leaves it
is a forest of the links found, not the links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.blocks import DEALT, Block, Lists, bucket_bits, each_block, edges, key_bits, known_keys, settle, text_bytes, write_blocks
from helixframe.llm.components import components
from helixframe.llm.shingles import mix, shingle_sets
from helixframe.llm.storage import documents, materialize
from helixframe.llm.vectors import whole_groups

#: Parts beyond those that the pigeonhole principle asks for: so many parts may be empty in a set before empty parts are listed too.
SPARE = 2
#: Classes in one row of the token-group matrix, and queries put to it at once, on average.
ROW, BLOCK = 512, 1024


@lru_cache(64)
def bands(num: int, den: int, upto: int) -> tuple[list[int], list[int]]:
    """Starts of the size bands, such that sets that link are in one band or neighbouring ones; and the parts for pairs of a band and the next (0: only equal sets link)."""
    starts, parts = [1], []
    while starts[-1] <= upto:
        starts.append(starts[-1] * den // num + 1)
        largest = starts[-1] - 1
        differ = (largest + largest * den // num) * (den - num) // (den + num)
        parts.append(differ + 1 + SPARE if differ else 0)
    return starts, parts


def part_hashes(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of the parts of a set, for the two band pairs that it may link in."""
    n = len(tokens)
    starts, parts = bands(num, den, 1 << max(10, n.bit_length()))
    band = int(np.searchsorted(starts, n, "right")) - 1
    where, what, out = mix(tokens + np.uint64(0x51ED270B)) >> np.uint64(11), mix(tokens ^ np.uint64(0xA0761D6478BD642F)), []
    for pair in (band - 1, band):
        if pair < 0 or not (k := parts[pair]):
            continue
        of = (where % np.uint64(k)).astype(np.int64)
        sums = np.zeros(k, np.uint64)
        np.add.at(sums, of, what)
        held = np.bincount(of, minlength=k)
        listed = np.flatnonzero(held) if (held == 0).sum() <= SPARE else np.arange(k)
        out.append(mix(sums[listed] + mix((np.uint64(pair) << np.uint64(32)) + listed.astype(np.uint64))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def class_of(tokens: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True) if len(tokens) else None


class BlockSets:
    """The shingle sets of a block's texts, and which of their shingles are to be asked about."""

    def __init__(self, b: Block, words: int, bits: int, bucket: int):
        self.sets = shingle_sets(b.texts(), words)
        self.names = [class_of(s) for s in self.sets]
        self.first = {c: k for k, c in reversed(list(enumerate(self.names))) if c is not None}  # a class is asked about once
        self.asked = sorted(self.first.values())
        tokens = np.concatenate([self.sets[k] for k in self.asked]) >> np.uint64(64 - bits) if self.asked else np.zeros(0, np.uint64)
        order = np.argsort(tokens)
        new = edges(tokens[order])
        self.lists = Lists(order, new, tokens[order][new], bits, bucket)
        self.several = np.diff(np.append(self.lists.first, len(tokens))) > 1

    def survivors(self, codes: dict[int, np.ndarray], num: int, den: int) -> set[int]:
        """Texts whose sets may link with one of another class: those of their shingles that some other class has are enough for it."""
        code, at, out = self.lists.answered(codes), 0, set()
        for k in self.asked:
            n = len(self.sets[k])
            if int((code[at : at + n] > 0).sum()) * den >= n * num:
                out.add(k)
            at += n
        return out


def shingle_rows(docs: DataFrame, n_bytes: int, words: int, num: int, den: int) -> DataFrame:
    """docs: (id, text). One row (id, class, n_shingles, tokens) per row: class is null without shingles, and tokens is null for all sets that cannot link with another class.

    A set that links shares num / den of its shingles at least with the other one, so it needs as many that the union of
    all other classes holds. That bound is met by few; the shingles of all others are not moved.
    """
    table = write_blocks(docs, n_bytes)
    tokens = max(1, n_bytes // 5)
    bits, bucket = key_bits(tokens), bucket_bits(tokens)

    def ask(b: Block, number: int, codes: dict) -> Iterator[pa.RecordBatch]:
        held = BlockSets(b, words, bits, bucket)
        yield from held.lists.rows(number, flags=held.several)

    def tell(b: Block, number: int, codes: dict) -> Iterator[pa.RecordBatch]:
        held = BlockSets(b, words, bits, bucket)
        alive = held.survivors(codes[1], num, den)
        yield pa.record_batch([b.ids, pa.array(held.names, pa.int64()), pa.array([len(s) for s in held.sets], pa.int64()), pa.array([s.view(np.int64) if k in alive else None for k, s in enumerate(held.sets)], pa.list_(pa.int64()))], ["id", "class", "n_shingles", "tokens"])

    answers = materialize(settle(each_block(table, [], ask, DEALT), 1, known_keys), "shared-shingles")
    return each_block(table, [answers], tell, f"id {docs.schema['id'].dataType.simpleString()}, class long, n_shingles long, tokens array<long>")


def parts(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(part, class) of the sets (class, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                held = batch.slice(a, 500)
                hashes = [part_hashes(t.values.to_numpy().view(np.uint64), num, den) for t in held.column("tokens")]
                own = np.repeat(held.column("class").to_numpy(), [len(h) for h in hashes])
                yield pa.record_batch([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(own)], ["part", "class"])

    return sets.mapInArrow(run, "part long, class long").distinct()


def open_rows(queries: list[np.ndarray], members: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """(query, member) with den * intersection >= num * union: the row of the token-group matrix with these members.

    A query whose overlap with the union of all members is below what any of them asks for does not open the row.
    """
    sizes = np.array([len(m) for m in members])
    tokens = np.concatenate(members)
    order = np.argsort(tokens, kind="stable")
    union, begin = np.unique(tokens[order], return_index=True)
    holder, end = np.repeat(np.arange(len(members)), sizes)[order], np.append(begin[1:], len(tokens))
    found = []
    for q, mine in enumerate(queries):
        fits = (sizes * den >= len(mine) * num) & (sizes * num <= len(mine) * den)
        if not fits.any():
            continue
        place = np.searchsorted(union, mine)
        place = place[union[np.minimum(place, len(union) - 1)] == mine]
        if len(place) * den < num * max(len(mine), sizes[fits].min()):
            continue
        n = end[place] - begin[place]
        ends = np.cumsum(n)
        common = np.bincount(holder[np.arange(ends[-1]) + np.repeat(begin[place] - ends + n, n)], minlength=len(members))
        found += [(q, int(m)) for m in np.flatnonzero(fits & (den * common >= num * (len(mine) + sizes - common)))]
    return found


def forest(links: list[tuple[int, int]]) -> dict[int, int]:
    """For each linked number the least one that it is connected with."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def row_links(placed: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v) links of a forest from placed (class, group, row, block, role): role 1 for a query, 2 for a member. Tokens are joined to what is placed, and only to that."""
    keys = ["group", "row", "block"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_groups(frames, keys, 500):
            out = []
            starts = np.flatnonzero((f[keys].diff() != 0).any(axis=1).to_numpy())
            names, role, tokens = f["class"].to_numpy(), f["role"].to_numpy(), [t.view(np.uint64) for t in f["tokens"]]
            for a, b in zip(starts, [*starts[1:], len(f)], strict=True):
                asks, held = a + np.flatnonzero(role[a:b] & 1), a + np.flatnonzero(role[a:b] & 2)
                if len(asks) and len(held):
                    found = open_rows([tokens[i] for i in asks], [tokens[i] for i in held], num, den)
                    tree = forest([(int(names[asks[q]]), int(names[held[m]])) for q, m in found if names[asks[q]] != names[held[m]]])
                    out += [(u, v) for u, v in tree.items() if u != v]
            if out:
                yield pd.DataFrame(out, columns=["u", "v"])

    dealt = placed.join(sets, "class").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select("class", "tokens", *keys, "role").mapInPandas(run, "u long, v long")


def put_queries(queries: DataFrame, members: DataFrame) -> DataFrame:
    """queries (class, group, row) and members (class, group, row) of rows, placed for row_links(): the queries of a row in blocks of BLOCK on average, and its members in each of them. Rows without queries stay closed."""
    n = queries.groupBy("group", "row").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    block = F.pmod(F.xxhash64("class", F.lit(2)), F.col("n")).cast("int").alias("block")
    asks = queries.join(n, ["group", "row"]).select("class", "group", "row", block, F.lit(1).alias("role"))
    held = members.join(n, ["group", "row"]).select("class", "group", "row", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"), F.lit(2).alias("role"))
    return asks.unionByName(held)


def class_links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v) links between the sets (class, tokens), such that sets connected by links of num / den or more are connected, and only those.

    Classes that share a part are candidates. First each is put to the least class of each of its parts; what that connects
    is one component, whose members need not meet again. Then, for parts with several components, classes are partitioned
    into rows by their least part-mate, and a class is a query to each row that shares a part with it in another component.
    """
    listed = parts(sets, num, den)
    ends = listed.groupBy("part").agg(F.min("class").alias("pivot"), F.max("class").alias("last")).where("pivot < last").select("part", "pivot")
    shared = materialize(listed.join(ends, "part"), "shared-parts")
    star = materialize(shared.where("pivot < class").select("class", F.col("pivot").alias("group"), F.lit(0).alias("row")).distinct(), "stars-of-parts")
    first = materialize(row_links(put_queries(star, star.select(F.col("group").alias("class"), "group", "row").distinct()), sets, num, den), "pivot-links")
    known = components(first)
    marked = shared.join(known.withColumnRenamed("node", "class"), "class", "left").select("part", "class", "pivot", F.coalesce("component", "class").alias("one"))
    several = marked.groupBy("part").agg(F.min("one").alias("a"), F.max("one").alias("b")).where("a < b").select("part")
    open_ = materialize(marked.join(several, "part"), "open-parts")
    home = open_.groupBy("class").agg(F.min("pivot").alias("group"), F.min("one").alias("one"))
    n = home.groupBy("group").agg(F.ceil(F.count("*") / ROW).cast("int").alias("n"))
    home = materialize(home.join(n, "group").select("class", "one", "group", F.pmod(F.xxhash64("class", F.lit(1)), F.col("n")).cast("int").alias("row")), "rows-of-classes")
    placed = open_.select("part", "class").join(home, "class")
    unions = placed.groupBy("part", "group", "row").agg(F.min("one").alias("a"), F.max("one").alias("b"))
    own = placed.select("part", "class", "one", F.col("group").alias("own_group"), F.col("row").alias("own_row"))
    other = ~((F.col("a") == F.col("b")) & (F.col("a") == F.col("one")))
    # Of two rows, the classes of the later one are the queries.
    queries = own.join(unions, "part").where(other & (F.struct("group", "row") <= F.struct(F.col("own_group").alias("group"), F.col("own_row").alias("row")))).select("class", "group", "row").distinct()
    second = row_links(put_queries(materialize(queries, "queries"), home.select("class", "group", "row")), sets, num, den)
    return first.unionByName(second)


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Link rows whose sets of word shingles have a Jaccard similarity of num / den or more. No link is lost at any similarity.

    Returns (id, n_shingles, component_id), one row per input row; component_id is the smallest id reachable, the row's own
    where nothing links. Words are runs of anything but ASCII white space, A-Z as a-z. A text with fewer words has them
    all as one shingle; a null or wordless text has none and links with nothing. Rows with equal sets link. Null ids keep
    their row and are no component's smallest id. Sets are compared by 64-bit hashes of their shingles.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    seen = materialize(shingle_rows(rows, text_bytes(docs, text_col), words, num, den), "shingles")
    by_row = seen.select("id", "class", "n_shingles")
    firsts = materialize(by_row.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("id").alias("first")), "class-ids")
    sets = materialize(seen.where("tokens IS NOT NULL").select("class", "tokens").dropDuplicates(["class"]), "sets")
    joined = components(materialize(class_links(sets, num, den), "links"))
    named = firsts.join(joined, F.col("class") == F.col("node"), "left").select("class", "first", F.coalesce("component", "class").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("smallest"))
    final = named.join(least, "component").select(F.col("class").alias("of"), "smallest")
    return by_row.join(final, F.col("class") == F.col("of"), "left").select("id", "n_shingles", F.coalesce("smallest", "id").alias("component_id"))


def op6_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by word 3-grams at a similarity of 0.9; see jaccard_components() for nulls, ties and repeated rows."""
    return jaccard_components(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
t AS MATERIALIZED (SELECT doc_id, unnest(s) AS t FROM s),
pr AS MATERIALIZED (SELECT x.a, x.b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL) x JOIN n p ON p.doc_id = x.a JOIN n q ON q.doc_id = x.b WHERE 100 * c >= 90 * (p.n + q.n - c)),
rc AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT rc.a, pr.b FROM rc JOIN pr ON pr.a = rc.b)
SELECT n.doc_id, n AS n_shingles, min(b) AS component_id FROM n JOIN rc ON rc.a = n.doc_id GROUP BY n.doc_id, n
"""
