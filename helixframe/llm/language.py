"""Language identification by mixtures: proportions of languages from letter n-gram likelihoods.

Training counts hashed letter trigrams by language. A document is a mixture of the learned languages; expectation
maximisation estimates its proportions, first over all languages and then over the leading ones; the set of languages is
the one with the highest log-likelihood less a penalty for each language beyond the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.shingles import enter, release, slices
from helixframe.llm.storage import documents, materialize

BINS = 1 << 14
ROUNDS = 12
#: Bytes of text worked on at once (a longer text is still read whole).
PART = 1 << 19
#: So many languages may be learned; the model has BINS numbers for each, on the driver and in each task.
MOST_LANGS = 500
#: The prior behind a score: as if so many trigrams more were spread over all languages evenly.
PRIOR = 2.0
#: A language that would hold less than this share is not considered.
LEAST_SHARE = 0.02
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point: its lower case (the first code point of it), or 0 if it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            table[c] = ord(ch.lower()[0])
    return table


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bin, count) of the distinct hashed trigrams of each text: letters in lower case, other runs as one space, one at both ends."""
    rows, bins, counts = [], [], []
    table = _letters()
    for i, text in enumerate(texts):
        if not text:
            continue
        x = table[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        x = np.concatenate(([np.uint32(0)], x, [np.uint32(0)]))
        x = x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))]
        if len(x) < 3:
            continue
        h = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA6B) ^ x[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
        n = np.bincount(h >> np.uint32(18), minlength=BINS)
        at = n.nonzero()[0]
        rows.append(np.full(len(at), i))
        bins.append(at)
        counts.append(n[at])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, bins, counts))


def _parts(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of about PART bytes at a time, so that a batch of long texts takes no more memory than one of short ones."""
    for a, b in slices(pc.fill_null(texts, ""), PART):
        yield a, texts.slice(a, b - a).to_pylist()


def train(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Trigram counts of all labelled rows: (lang, bin, n), at most BINS rows a language. Counts are summed in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("language")
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, texts in _parts(batch.column(1)):
                rows, bins, counts = trigrams(texts)
                of = np.array(langs[a : a + len(texts)], object)[rows]
                for lang in set(of):
                    mine = of == lang
                    sums[lang] = sums.get(lang, 0) + np.bincount(bins[mine], weights=counts[mine], minlength=BINS)
        for lang, n in sums.items():
            at = n.nonzero()[0]
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at].astype(np.int64))], ["lang", "bin", "n"])
        release()

    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return labelled.mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


class Mixture:
    """Likelihoods of bins by language, from the rows of train(). Bounded by BINS numbers a language, whatever the corpus."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + 0.5
        self.p = (smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32) if langs else np.zeros((BINS, 0), np.float32)

    @classmethod
    def collect(cls, trained: DataFrame) -> Mixture:
        """Raises ValueError where there are more than MOST_LANGS languages, before anything is collected."""
        trained = materialize(trained, "trigram-counts")
        if len(trained.select("lang").distinct().limit(MOST_LANGS + 1).collect()) > MOST_LANGS:
            raise ValueError(f"more than {MOST_LANGS} values of lang")
        rows = trained.toPandas()
        langs = sorted(rows["lang"].unique())
        counts = np.zeros((len(langs), BINS))
        counts[rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), rows["bin"].to_numpy(int)] = rows["n"]
        return cls(langs, counts)

    def _fit(self, p: np.ndarray, c: np.ndarray, starts: np.ndarray, row: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log-likelihood of each document after ROUNDS rounds from w; a language with weight 0 stays out."""
        total = np.add.reduceat(c, starts)[:, None]
        for _ in range(ROUNDS):
            mixed = np.einsum("nl,nl->n", p, w[row])
            w = w * np.add.reduceat(p * (c / mixed)[:, None], starts) / total
        return w, np.add.reduceat(c * np.log(np.einsum("nl,nl->n", p, w[row])), starts, dtype=np.float64)

    def score(self, share: float, n: int) -> float:
        """The expected proportion of a language that holds share of n trigrams, given the prior: near share for long texts, and near 1 / languages for a letter or two."""
        return (share * n + PRIOR / len(self.langs)) / (n + PRIOR)

    def infer(self, texts: list[str | None]) -> list[list[tuple[str, float]]]:
        return [found for found, _ in self.infer_counted(texts)]

    def infer_counted(self, texts: list[str | None]) -> list[tuple[list[tuple[str, float]], int]]:
        """For each text the languages chosen with their proportions, largest first (none if it has no letter or nothing was learned), and its number of trigrams."""
        found: list[tuple[list[tuple[str, float]], int]] = [([], 0) for _ in texts]
        row, bins, count = trigrams(texts)
        if not len(row) or not self.langs:
            return found
        ids, starts, row = np.unique(row, return_index=True, return_inverse=True)
        c, p = count.astype(np.float32), self.p[bins]
        single = np.add.reduceat(c[:, None] * np.log(p), starts, dtype=np.float64)
        best = single.argmax(1)
        top = single.max(1)
        chosen = {int(i): [(int(best[i]), 1.0)] for i in range(len(ids))}
        if len(self.langs) > 1:
            w, _ = self._fit(p, c, starts, row, np.full((len(ids), len(self.langs)), 1 / len(self.langs), np.float32))
            order = np.argsort(-w, 1, kind="stable")
            penalty = 0.5 * np.log(np.add.reduceat(c, starts)) + 3.0
            for k in range(2, len(self.langs) + 1):
                # Only documents in which the k-th language may hold enough go on.
                open_ = np.flatnonzero(np.take_along_axis(w, order[:, k - 1 : k], 1)[:, 0] >= LEAST_SHARE)
                if not len(open_):
                    break
                mine = np.isin(row, open_)
                sub, at = np.unique(row[mine], return_inverse=True)[1], np.flatnonzero(np.diff(row[mine], prepend=-1))
                start = np.zeros((len(open_), len(self.langs)), np.float32)
                np.put_along_axis(start, order[open_, :k], 1 / k, 1)
                fit, ll = self._fit(p[mine], c[mine], at, sub, start)
                ll -= (k - 1) * penalty[open_]
                for j in np.flatnonzero(ll > top[open_]):
                    i = int(open_[j])
                    top[i] = ll[j]
                    chosen[i] = [(int(x), float(fit[j, x])) for x in np.argsort(-fit[j], kind="stable")[:k]]
        n = np.add.reduceat(count, starts)
        for i, doc in enumerate(ids):
            found[doc] = ([(self.langs[x], min(1.0, v)) for x, v in chosen[i]], int(n[i]))
        return found


def identify(docs: DataFrame, model: Mixture, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, langs, shares), one row per input row: the language with the largest proportion, its Mixture.score(), and the whole set with its proportions.

    Without letters, text or learned languages: 'und' with score 0 and an empty set. Ties go to the language first in order.
    Rows with equal or null ids are rows of their own. Texts of any length are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("language")
        for batch in batches:
            found = [x for _, texts in _parts(batch.column(1)) for x in model.infer_counted(texts)]
            sets = [s for s, _ in found]
            first = [(s[0][0], model.score(s[0][1], n)) if s else (UNKNOWN, 0.0) for s, n in found]
            yield pa.record_batch(
                [batch.column(0), pa.array([f[0] for f in first], pa.string()), pa.array([f[1] for f in first], pa.float64()), pa.array([[x for x, _ in s] for s in sets], pa.list_(pa.string())), pa.array([[v for _, v in s] for s in sets], pa.list_(pa.float64()))],
                ["id", "lang_pred", "score", "langs", "shares"],
            )
        release()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, langs array<string>, shares array<double>")


def keep_identified(docs: DataFrame, model: Mixture, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs in which one language holds least or more of the text, with all their columns.

    Texts without letters go, and so do those that no language dominates. A model that learned nothing rejects only texts
    without letters.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("language")
        for batch in batches:
            keep = []
            for _, part in _parts(batch.column(at)):
                if model.langs:
                    keep += [bool(s) and s[0][1] >= least for s in model.infer(part)]
                else:
                    keep += [any(c.isalpha() for c in t or "") for t in part]
            yield batch.filter(pa.array(keep, pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out; a null or repeated doc_id is a row like any other."""
    docs = documents(spark, sf_dir)
    model = Mixture.collect(train(docs.where(~held_out())))
    found = identify(docs, model)
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score", F.concat_ws(",", "langs").alias("lang_set"))
