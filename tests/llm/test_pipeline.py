"""Every stage against a brute-force version of its own, and on odd tables."""

import difflib
import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from helixframe.llm.storage import materialize

from ..conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def some(spark):
    """A slice of the documents that the brute-force versions can take."""
    return materialize(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 260"), "some")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def trigrams(text):
    letters = re.sub(r" +", " ", " " + "".join(c.lower()[0] if c.isalpha() else " " for c in text) + " ")
    return Counter(letters[i : i + 3] for i in range(len(letters) - 2)) if letters.strip() else Counter()


def test_language(spark, some):
    """EM over exact trigrams, in plain Python: the rows rejected are those without letters or without a language of half the text."""
    by_lang = defaultdict(str)
    for r in some.orderBy("doc_id").collect():
        if len(by_lang[r["lang"]]) < 1500 and r["lang"]:
            by_lang[r["lang"]] += " " + (r["text"] or "")[:500]
    mixed = " ".join(by_lang[x][:1500] for x in sorted(by_lang)[:3])
    some = some.unionByName(spark.createDataFrame([(9001, "12 34 !?", None, "a", 8), (9002, None, None, "a", 0), (9003, mixed, None, "a", len(mixed)), (9004, mixed[:3000], None, "a", 3000)], some.schema))
    docs, counts = some.collect(), defaultdict(Counter)
    for r in docs:
        if r["lang"]:
            counts[r["lang"]].update(trigrams(r["text"] or ""))
    langs, bins = sorted(counts), 1 << 14
    total = {x: sum(counts[x].values()) for x in langs}
    prob = lambda t, x: (counts[x][t] + 0.5) / (total[x] + 0.5 * bins)
    got, want = {r["doc_id"] for r in p.language(spark, some, SF).collect()}, set()
    for r in docs:
        c = trigrams(r["text"] or "")
        if not c:
            continue
        w = dict.fromkeys(langs, 1 / len(langs))
        for _ in range(12):
            new = Counter()
            for t, n in c.items():
                mixed = sum(w[x] * prob(t, x) for x in langs)
                for x in langs:
                    new[x] += n * w[x] * prob(t, x) / mixed
            w = {x: new[x] / sum(c.values()) for x in langs}
        if max(w.values()) >= 0.5:
            want.add(r["doc_id"])
    assert len(got ^ want) <= 0.01 * len(docs) and len(got) < len(docs)


def blocks_gone(mine, theirs):
    out = set()
    for a, _, n in difflib.SequenceMatcher(None, mine, theirs, autojunk=False).get_matching_blocks():
        if sum(map(len, mine[a : a + n])) >= 40:
            out |= set(range(a, a + n))
    for s in range(len(mine)):
        for q in range(len(theirs)):
            n = 0
            while s + n < len(mine) and q + n < len(theirs) and mine[s + n] == theirs[q + n]:
                n += 1
            if n and sum(map(len, mine[s : s + n])) >= 40:
                out |= set(range(s, s + n))
    return out


def test_line_dedup(spark, some):
    docs, holders, want = sorted(some.collect(), key=lambda r: r["doc_id"]), defaultdict(list), []
    for k, r in enumerate(docs):
        lines = (r["text"] or "").split("\n")
        mine, gone = [x.strip(" ") for x in lines], set()
        for j in sorted({j for x in mine if x for j in holders[x]}):
            gone |= blocks_gone(mine, [x.strip(" ") for x in (docs[j]["text"] or "").split("\n")])
        for x in set(mine):
            holders[x].append(k)
        text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if r["text"] is None or not gone:
            want.append((r["doc_id"], r["text"], r["n_chars"]))
        elif text.strip(" "):
            want.append((r["doc_id"], text, len(text)))
    got = rows(p.line_dedup(spark, some, SF).select("doc_id", "text", "n_chars"))
    assert got == sorted(want, key=repr) and got != rows(some.select("doc_id", "text", "n_chars"))


def test_near_duplicates(spark):
    docs = materialize(spark.read.parquet(f"{SF}/documents.parquet"), "all")
    sets, postings = {}, defaultdict(list)
    for r in docs.collect():
        w = WORD.findall((r["text"] or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[r["doc_id"]] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    for i, s in sets.items():
        for t in s:
            postings[t].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for t in s for j in postings[t] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {i for i in sets if find(i) == i}
    got = {r["doc_id"] for r in p.near_duplicates(spark, docs, SF).select("doc_id").collect()}
    assert got == want and len(want) < len(sets)


def test_mixing(spark, some):
    docs = some.collect()
    size, by_source = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs}, defaultdict(list)
    for r in docs:
        by_source[r["source"]].append(r["doc_id"])
    sources = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    weight, own = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}, {s: sum(size[i] for i in by_source[s]) for s in sources}
    target, full, left = {}, set(), 1.5 * sum(own.values())
    while True:
        rest = [s for s in sources if s not in full]
        level = (left - sum(2 * own[s] for s in full)) / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] > 2 * own[s]]
        if not over:
            target = {s: 2 * own[s] if s in full else level * weight[s] for s in sources}
            break
        full |= set(over)
    want = Counter()
    for s in sources:
        passes = math.floor(target[s] / own[s]) if own[s] else 0
        budget, upto = target[s] - passes * own[s], 0
        for i in sorted(by_source[s], key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            upto += size[i]
            want[i] = passes + (upto <= budget)
    got = Counter(r["doc_id"] for r in p.mixing(spark, some, SF).select("doc_id").collect())
    assert got == +want


def test_packing(spark, some):
    from tokenizers import Tokenizer

    from helixframe.llm.packing import tokenizer_path

    tokenizer, pieces, full = Tokenizer.from_file(tokenizer_path()), defaultdict(list), Counter()
    for r in p.packing(spark, some, SF).collect():
        pieces[r["doc_id"]].append((r["start"], list(r["ids"])))
        full[r["sequence_id"]] += r["length"]
    for r in some.collect():
        assert [x for _, ids in sorted(pieces[r["doc_id"]]) for x in ids] == [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
    assert max(full.values()) <= 2048 and sum(full.values()) > 0.95 * 2048 * (len(full) - some.rdd.getNumPartitions())


def test_every_stage_on_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).count() == 0


ODD = "gone string, _of string, _passes int, _cut int, _id long, _h string, _gone string, n_lines int, n_deleted int, mix_size int, source_size int, target int, times int, id int, component_id int, class int, h int, key string"


@pytest.mark.parametrize(("name", "stage"), p.STAGES)
def test_every_stage_on_odd_rows(spark, name, stage):
    """Nulls, repeats, ties, texts and lines of megabytes, and columns with the names that operators use themselves."""
    long = "der Hund und die Katze sind nicht da. " * 60_000
    base = [(1, "Und der die das ist nicht.", "de", "a", 5), (2, None, None, None, None), (None, "the of and to in is", "en", None, None), (None, None, None, None, None), (1, "Und der die das ist nicht.", "de", "a", 5), (4, "", "en", "", 0), (5, long, "de", "a", len(long)), (6, "the cat is in the house and the dog is not\n" * 20_000, "en", "b", 0), (7, "12 34", None, "a", 5)]
    own = len(ODD.split(","))
    docs = spark.createDataFrame([(*r, *(str(k) if " string" in c else k for c in ODD.split(","))) for k, r in enumerate(base)], f"doc_id long, text string, lang string, source string, n_chars long, {ODD}")
    out = stage(spark, docs, SF)
    if name == "packing":
        assert out.count() >= len(base)
        return
    assert out.columns == docs.columns
    found = out.select("doc_id", *out.columns[5:]).collect()
    extra = {tuple(r)[1:] for r in found}
    assert extra <= {tuple(r)[5:] for r in docs.collect()} and all(len(x) == own for x in extra) and len(found) >= 2
