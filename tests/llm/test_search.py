"""Ranked search against a plain Python version: odd tables, many shards, ties, and blocks that stay packed."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.llm import search

from .test_operators import SCHEMA, key, made_docs


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(search.TERM, text or "")]


def brute(docs, queries, k=10):
    """(query, rank, id, score); ids that tie are compared as sets elsewhere, so rows of one id are alike here."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for q, text in queries:
        scores = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return key(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = [(x[0], x[1]) for x in made_docs()]
    for i in range(300):
        out.append((1000 + i, " ".join(r.choice(["alpha", "beta", "Gamma", "x", "y"] + [f"w{r.randint(0, 60)}"] * 6) for _ in range(r.choice([3, 12, 80])))))
    return out + [(2000 + i, "tie tie breaker") for i in range(30)] + [(1990, "tie tie breaker"), (None, "tie tie breaker")]


QUERIES = [(1, "alpha beta w3"), (2, "GAMMA x x y w9 w10 w11"), (3, "tie"), (4, None), (5, ""), (6, "nowhere"), (7, "ß é ñ́ thanß 12"), (8, "alpha beta w3"), (None, "breaker w1"), (9, "one two don't")]


@pytest.fixture(scope="module")
def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, None, None, 1, 2, "i", "k", 3, "c", 4) for i, t in rows], SCHEMA).repartition(3)
    return docs, spark.createDataFrame([(i, t, "s", 1, 2) for i, t in QUERIES], "item_id long, text string, id string, rank int, score int").withColumnsRenamed({"id": "doc_id"}).drop("rank", "score")


def got(docs, queries, k=10):
    size = search.collection_size(docs)
    found = search.search(search.build_index(docs, size), size, queries, k)
    return key(tuple(r[c] for c in ("item_id", "rank", "id", "score")) for r in found.collect())


@pytest.mark.parametrize("parts", [1, 40])
def test_against_brute_force(rows, frames, parts):
    """One shard, and a shard for each of many partitions, which are searched in two rounds."""
    docs, queries = frames
    assert got(docs.repartition(parts), queries) == brute(rows, QUERIES)


def test_lots_of_queries(rows, frames, monkeypatch):
    monkeypatch.setattr(search, "LOT", 60)
    assert got(*frames, k=3) == brute(rows, QUERIES, 3)


def test_shards_are_a_table(frames):
    docs = frames[0].repartition(12)
    index = search.build_index(docs, search.collection_size(docs))
    assert index.where("term IS NULL").count() > 10
    assert index.where("term = 'tie'").groupBy().sum("df").first()[0] == 32


def test_collection_size_is_that_of_the_pattern(spark, rows):
    """Null, empty, texts that begin or end within a term, all ASCII characters, others, and one longer than a slice."""
    texts = [t for _, t in rows] + ["a", "b", "-c", "d-", None, "", "-", "".join(map(chr, range(128))), "\x00é\u2028ñ\u00a0x 😀-😀", "ab. " * 400_000, "tail"]
    held = [len(terms(t)) for t in texts]
    docs = spark.createDataFrame([(t,) for t in texts], "`a text` string")
    for parts in (1, 5):
        assert search.collection_size(docs.repartition(parts).withColumnRenamed("a text", "body"), "body") == (sum(n > 0 for n in held), sum(held))
    assert search.collection_size(docs.limit(0), "a text") == (0, 0)


def test_collection_size_takes_a_fraction_of_the_pattern(spark):
    """Matching each character against the pattern took three quarters of the whole search."""
    docs = spark.range(400, numPartitions=4).select(F.repeat(F.lit("Some words, 12 of them; don't stop "), 300).alias("text")).localCheckpoint()

    def took(run):
        best = math.inf
        for _ in range(3):
            began = time.perf_counter()
            assert run() == (400, 960_000)
            best = min(best, time.perf_counter() - began)
        return best

    n = F.regexp_count("text", F.lit(search.TERM))
    assert took(lambda: search.collection_size(docs)) < 0.5 * took(lambda: tuple(docs.agg(F.count_if(n > 0), F.sum(n)).first()))


def test_empty_tables(spark, frames):
    docs, queries = frames
    assert got(docs.limit(0), queries) == [] and got(docs, queries.limit(0)) == []


def test_blocks_without_candidates_stay_packed(monkeypatch):
    """Of a list that is not essential, most blocks are never unpacked, and results are those of full sums."""
    monkeypatch.setattr(search, "BLOCK", 8)
    monkeypatch.setattr(search, "WINDOW", 256)
    r = np.random.default_rng(1)
    texts = [" ".join(["the"] * int(r.integers(0, 4)) + [f"v{int(x)}" for x in r.zipf(1.3, int(r.integers(5, 60))) % 2000]) for _ in range(3000)]
    made = search._Shard()
    made.add(pa.array(texts), pa.array(np.arange(len(texts))))
    total = sum(len(terms(t)) for t in texts)
    *batches, ends = made.rows(0, len(texts), total)
    columns = pa.Table.from_batches(batches).to_pydict()
    norms = search.norm(np.frombuffer(ends.column("lengths")[0].as_py(), np.int64), len(texts), total)
    ids = np.frombuffer(ends.column("ids")[0].as_py(), np.int64).reshape(2, -1)[0]
    opened = blocks = 0
    for query in (["the", "v7", "v900"], ["the", "v1", "v2", "v1500"], ["v1"], ["v3", "v77", "v78", "the"]):
        lists, weights = [], []
        for t in query:
            if t in columns["term"]:
                i = columns["term"].index(t)
                weights.append(math.floor(1000 * math.log((2 * len(texts) + 2) / (2 * columns["df"][i] + 1))))
                lists.append(search.List(*(columns[c][i] for c in ("df", "top", "blocks", "postings"))))
        best = search.search_shard(list(zip(weights, lists, strict=True)), norms, ids, 10, 0)
        sums = np.zeros(len(texts), np.int64)
        for w, x in zip(weights, lists, strict=True):
            full = search.List(len(x.docs), x.top, x.blocks.tobytes(), x.packed.tobytes())
            docs, held = full.within(0, len(texts), norms)
            assert len(docs) == len(x.docs) and held.max() == x.top
            sums[docs] += w * held
        order = np.lexsort((ids, -sums))[:10]
        order = order[sums[order] > 0]
        assert best.scores.tolist() == sums[order].tolist() and ids[best.docs].tolist() == ids[order].tolist()
        the = [x for t, x in zip(query, lists, strict=False) if t == "the"]
        opened, blocks = opened + sum(int(x.open.sum()) for x in the), blocks + sum(len(x.open) for x in the)
    assert 0 < opened < blocks / 2
