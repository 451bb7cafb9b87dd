"""Periodic runs against a plain Python version: small tiles, one tile, hidden multiples, odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from helixframe.llm import periodic

from .test_operators import SCHEMA, key, made_docs


def words_of(text):
    return re.findall(periodic.WORD, text or "")


def brute_runs(w):
    n, best = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                best.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, q, length) for (s, length), q in best.items())


def brute(rows):
    out = []
    for i, text in rows:
        w = words_of(text)
        runs, gone = brute_runs(w), set()
        for s, q, length in runs:
            gone |= set(range(s + q, s + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, [(s, length, q) for s, q, length in runs], hashlib.sha256(kept.encode()).hexdigest()))
    return key(out)


def got(docs):
    return key((r.id, [(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs).collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, 1, 2, "i", "k", 3, "c", 4) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    out = [(x[0], x[1]) for x in made_docs()]
    morse = [bin(i).count("1") % 2 for i in range(512)]
    fib = ["a", "b"]
    for _ in range(11):
        fib.append(fib[-1] + fib[-2])
    out += [(1000, "a " * 300), (1001, " ".join("ab"[x] for x in morse)), (1002, " ".join(fib[-1])), (1003, "x " + "a b " * 50 + "a a a a a a a " + "c d e " * 40 + "\n"), (1004, "a a a a a"), (1005, "a\ta\na a a a")]
    for i in range(60):
        w = []
        while len(w) < r.choice([20, 90, 400]):
            unit = [r.choice("abc") for _ in range(r.choice([1, 2, 3, 5, 8, 13, 30]))]
            w += unit * r.randint(1, 9) + [r.choice("abcd") for _ in range(r.randint(0, 4))]
        out.append((2000 + i, " ".join(w)))
    return out


def test_against_brute_force(spark, rows):
    want = brute(rows)
    assert got(frame(spark, rows)) == want and sum(len(r[1]) for r in want) > 100


@pytest.mark.parametrize("core, wide", [(16, 1), (64, 3), (32, 0)])
def test_small_tiles_give_the_same_runs(rows, core, wide, monkeypatch):
    """Tiles solved by themselves, fragments joined in Python as stitched() does."""
    monkeypatch.setattr(periodic, "CORE", core)
    monkeypatch.setattr(periodic, "WIDE", wide)
    names = {}
    for _, text in rows:
        w = words_of(text)
        x = np.array([names.setdefault(v, len(names) + 1) for v in w], np.uint64)
        spans = {}
        for lowest, highest, first, last, low, high in periodic.tiles(len(w)):
            one = lambda v: np.array([v])
            _, q, s, e = periodic.solve_tiles(x[first:last], np.array([0, last - first]), one(first), one(low), one(high), one(len(w)), lowest, highest)
            for a, b, c in zip(q.tolist(), s.tolist(), e.tolist(), strict=True):
                spans.setdefault(a, []).append((b, c))
        best = {}
        for q in sorted(spans):
            merged = []
            for s, e in sorted(spans[q]):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            for s, e in merged:
                if e - s + q >= max(6, 4 * q):
                    best.setdefault((s, e - s + q), q)
        assert sorted((s, q, length) for (s, length), q in best.items()) == brute_runs(w)


def test_long_document_is_dealt_out_in_tiles(spark, monkeypatch):
    r = random.Random(2)
    noise = lambda n: [r.choice("abcdefghij") + str(r.randint(0, 50)) for _ in range(n)]
    unit = noise(30000)
    w = noise(70000) + unit * 4 + unit[:11] + noise(500) + noise(40) * 3000 + ["z"] * 70000 + noise(7)
    got = periodic.periodic_runs(spark.createDataFrame([(5, " ".join(w)), (6, "b " * 10)], "doc_id long, text string")).orderBy("id").collect()
    x, y = ([(r.start, r.length, r.period) for r in row.runs] for row in got)
    assert [r for r in x if r[1] > 1000] == [(70000, 120011, 30000), (190511, 120000, 40), (310511, 70000, 1)]
    assert y == [(0, 10, 1)]


def test_digest_and_planting(spark):
    docs = [(i, " ".join(f"w{k}" for k in range(3 + 7 * (i % 9)))) for i in range(200)] + [(None, "a a a a a a"), (7, None), (8, "")]
    want = []
    for i, t in docs:
        w = words_of(t)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-r[2] / r[1], r[0], r[1]), default=None)
        text = "".join(f"{s},{length},{q}\n" for s, q, length in runs)
        want.append((i, len(runs), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4), hashlib.sha256(text.encode()).hexdigest()))
    made = periodic.run_digest(periodic.periodic_runs(periodic.with_planted_runs(spark.createDataFrame(docs, "doc_id long, text string"))))
    assert key(tuple(r)[:-1] for r in made.collect()) == key(want) and sum(r[1] for r in want) > 3


def test_empty_table(spark):
    assert periodic.run_digest(periodic.periodic_runs(spark.createDataFrame([], SCHEMA))).count() == 0
