"""Benchmark decontamination against a plain Python version, on odd tables and on a hot passage."""

import hashlib
import random
import re

import pytest

from helixframe.llm import decontaminate

from .test_operators import SCHEMA, key, made_docs

ITEMS = "item_id long, text string, doc_id string, words int, class string"


def terms(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = terms(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, named = terms(text), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[a : a + n]))) is not None:
                    hit |= set(range(a, a + n))
                    named |= found
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return key(out)


def got(docs, items):
    return key(tuple(r[c] for c in ("id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in decontaminate.contamination(docs, items).collect())


@pytest.fixture(scope="module")
def made(spark):
    rows = [(r[0], r[1]) for r in made_docs()]
    base = terms(rows[0][1])
    prose = [t for _, t in rows if t and len(terms(t)) > 60]
    items = [(1, " ".join(base[5:40])), (2, " ".join(base[5:40]).upper()), (3, "one, two"), (4, "ÀÉ"), (5, ""), (6, None), (None, " ".join(base[50:62])), (7, prose[-1]), (8, prose[-1][:70] + " elsewhere " + prose[-2][-90:]), (9, "not anywhere at all"), (3, "12 34"), (10, " ".join(base[60:69])), (11, "on"), (12, " ".join(["again"] * 30))]
    rows += [(900, " ".join(["again"] * 25)), (901, "x " + " ".join(["again"] * 10)), (902, " ".join(base[5:14]) + " stop " + " ".join(base[14:24])), (903, " ".join(base[30:40])), (904, "one\ntwo one two two")]
    frame = spark.createDataFrame([(i, t, None, None, 1, 2, "i", "k", 3, "c", 4) for i, t in rows], SCHEMA).repartition(3)
    return rows, items, frame, spark.createDataFrame([(i, t, "d", 1, "z") for i, t in items], ITEMS)


def test_against_brute_force(made):
    rows, items, docs, benchmark = made
    want = brute(rows, items)
    assert got(docs, benchmark) == want and sum(r[-1] for r in want) > 10


def test_shuffled_windows_and_full_bitmap(made, monkeypatch):
    """Without a broadcast, with places in many rows, and with a bitmap that holds nearly every token, rows are the same."""
    rows, items, docs, benchmark = made
    monkeypatch.setattr(decontaminate, "SMALL", -1)
    monkeypatch.setattr(decontaminate, "PLACES", 3)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 15)
    assert got(docs, benchmark) == brute(rows, items)


def test_spans(spark):
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(["q", *words[3:15], "q"]))], "item_id long, text string")
    rows, spans, members = decontaminate.benchmark_spans(docs, items)
    assert sorted((r.start, r.end) for r in spans.collect()) == [(3, 13), (4, 14), (5, 15)]
    assert rows.count() == 2 and [r.item for r in members.collect()] == ["5"]


def test_empty_tables(made, spark):
    _, _, docs, benchmark = made
    none = spark.createDataFrame([], SCHEMA)
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, benchmark.limit(0)).collect())


def test_hot_passage(spark):
    """A passage that all documents have, among items that are copies of each other, gives a span a document and window."""
    r = random.Random(1)
    passage = " ".join(r.choice("abcdefgh") + str(i) for i in range(24))
    docs = [(i, f"d{i} {passage} e{i}") for i in range(300)]
    items = [(i, passage) for i in range(40)]
    made = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(*made) == brute(docs, items)
    assert decontaminate.benchmark_spans(*made)[1].count() == 300 * 15
