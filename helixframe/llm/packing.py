"""Packing token streams into sequences by order-preserving dynamic programming.

Documents follow one another in the order of their input partition. A stretch of documents is cut into windows of at
most `length` tokens; a window may end after a document, at no cost, or after a sentence, at the cost of `truncation`.
The cuts chosen have the least sum of padding and truncation costs. With f(j) the least cost of all windows up to
boundary j at token t(j),

    f(j) = length - t(j) + min over i with t(j) - t(i) <= length of f(i) + cost(i) + t(i),

and the minimum over the sliding window of i is kept in a monotone queue, so a stretch of n boundaries takes O(n) steps.
A sentence longer than a window also gets boundaries after every `length` tokens within it.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.shingles import enter, release, slices, word_spans
from helixframe.llm.storage import documents

LENGTH = 2048
TRUNCATION = 16
END_ID = 1
#: A stretch is closed after the first document with which it holds so many tokens; a bound on memory, at the price of one window's padding.
STRETCH = 1 << 20
#: Bytes of text tokenized at once (a longer text is still tokenized whole); the arrays beside it take some 50 bytes for each.
PART = 1 << 18
#: Words whose ids a worker remembers from task to task, in arrays of some 35 MB; beyond it, those not asked for since are forgotten.
KNOWN_WORDS = 1 << 20
STOPS, QUOTES = np.frombuffer(b".!?", np.uint8), np.frombuffer(b"\"'", np.uint8)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTable:
    """Ids of words by a 64-bit hash of their bytes, in arrays of a fixed size: an open-addressing table, and all ids end to end."""

    def __init__(self, most: int, kind: type):
        self.most, self.mask, self.kind = most, np.uint64((1 << (2 * most - 1).bit_length()) - 1), kind
        self.clear()

    def clear(self) -> None:
        self.slot = np.full(int(self.mask) + 1, -1, np.int32)
        self.key, self.warm, self.ids, self.start = np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, self.kind), np.zeros(1, np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for those that are not held."""
        out, left, at = np.full(len(key), -1, np.int64), np.arange(len(key)), key & self.mask
        while len(left):
            there = self.slot[at]
            same = (there >= 0) & (self.key[there] == key[left]) if len(self.key) else np.zeros(len(left), bool)
            out[left[same]] = there[same]
            on = (there >= 0) & ~same
            left, at = left[on], (at[on] + np.uint64(1)) & self.mask
        return out

    def add(self, key: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Take in words that are not held, each once, the most at most. Beyond it, only those asked for since the last time stay."""
        if len(key) > self.most:
            raise ValueError("more words at once than the table holds")
        if len(self.key) + len(key) > self.most:
            keep = np.flatnonzero(self.warm)
            keep = keep[: max(0, min(self.most // 2, self.most - len(key)))]
            kept = (self.key[keep], *self.ids_of(keep))
            self.clear()
            if len(keep):
                self._put(*kept)
        self._put(key, ids, sizes)

    def _put(self, key: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        number, left, at = np.arange(len(self.key), len(self.key) + len(key), dtype=np.int32), np.arange(len(key)), key & self.mask
        self.key, self.warm = np.concatenate((self.key, key)), np.concatenate((self.warm, np.zeros(len(key), bool)))
        self.ids, self.start = np.concatenate((self.ids, ids)), np.concatenate((self.start, self.start[-1] + np.cumsum(sizes)))
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = number[left[free]]  # of several, one stays
            on = self.slot[at] != number[left]
            left, at = left[on], (at[on] + np.uint64(1)) & self.mask

    def ids_of(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words with these numbers, end to end, and how many each has."""
        sizes = self.start[number + 1] - self.start[number]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.start[number] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


class WordTokenizer:
    """Ids of texts: for tokenizers made as word_bpe_49k.json is, each distinct word is encoded once in a while; for others, every text as it is.

    Such a tokenizer lower-cases, splits at white space and drops it, and cuts words into the pieces of PIECES, the last id
    of each having MARK; this is read from its file. Words are runs of anything but ASCII white space. Unknown words are encoded
    many at a time, as one text; where a word's ids end is told from the ids that end a piece and the number of pieces in the
    word. Words in which case or composition of letters may change the pieces, or which may hold a special token, are
    encoded by themselves, as are all where this doesn't add up. Words are told apart by a 64-bit hash.
    """

    #: The pieces into which word_bpe_49k.json splits a lower-cased text: fixed values of that file.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    MARK = "</w>"
    STOP = r"[.!?][\"']?$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        most = max(vocabulary.values(), default=0)
        self.by_word = self._splits_words()
        self.table = WordTable(KNOWN_WORDS if self.by_word else 1, np.uint16 if most < 1 << 16 else np.uint32)
        self.ends = np.zeros(most + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(self.MARK) or i >= self.tokenizer.get_vocab_size(with_added_tokens=False)]] = True

    def _splits_words(self) -> bool:
        made = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])]
        splits = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        return steps == ["NFC", "Replace", "Lowercase"] and splits[0].get("pattern") == {"Regex": self.SPLIT} and splits[0].get("behavior") == "Removed" and splits[0].get("invert") is True and made["model"].get("end_of_word_suffix") == self.MARK

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.table.kind) for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, key: np.ndarray, words: pa.Array) -> None:
        special = np.asarray(pc.match_substring(words, "<"), bool)
        ascii_ = np.asarray(pc.string_is_ascii(words), bool)
        other = np.flatnonzero(~ascii_ & ~special)
        ascii_[other] = [w.strip(punctuation).lower().isalpha() for w in words.take(pa.array(other)).to_pylist()]
        plain, others = np.flatnonzero(ascii_ & ~special), np.flatnonzero(special | ~ascii_)
        named = words.take(pa.array(plain))
        pieces = np.asarray(pc.count_substring_regex(pc.utf8_lower(named), self.PIECES), np.int64)
        names = named.to_pylist()
        found, sizes = [], []
        joined = [(a, min(a + 500, len(names))) for a in range(0, len(names), 500)]
        for (a, b), ids in zip(joined, self._encode([" ".join(names[a:b]) for a, b in joined]), strict=True):
            last = np.flatnonzero(self.ends[ids])
            upto = np.cumsum(pieces[a:b])
            if len(last) == upto[-1]:
                sizes.append(np.diff(np.concatenate(([0], last + 1))[upto], prepend=0))
                found.append(ids)
            else:
                found += (each := self._encode(names[a:b]))
                sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
        found += (each := self._encode(words.take(pa.array(others)).to_pylist()))
        sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
        self.table.add(key[np.concatenate((plain, others))], np.concatenate([*found, np.zeros(0, self.table.kind)]), np.concatenate(sizes))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts, one after the other: ids; the first id of each text (one more at the end); ends of sentences as numbers of ids; the text of each such end."""
        if not self.by_word:
            return self._encode_texts(texts.to_pylist())
        key, row, start, end, data = word_spans(texts)
        number = self.table.find(key)
        if len(unknown := np.flatnonzero(number < 0)):
            fresh, first = np.unique(key[unknown], return_index=True)
            if len(fresh) > self.table.most:  # more words at once than the table holds
                return self._encode_texts(texts.to_pylist())
            first = unknown[first]
            size = end[first] - start[first]
            upto = np.concatenate(([0], np.cumsum(size)))
            raw = data[np.repeat(start[first] - upto[:-1], size) + np.arange(upto[-1])]
            words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(raw.tobytes())).cast(pa.string())
            self._learn(fresh, words)
            number = self.table.find(key)
            if (number < 0).any():  # words that were known have been forgotten for others
                return self._encode_texts(texts.to_pylist())
        self.table.warm[number] = True
        ids, sizes = self.table.ids_of(number)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
        before = data[np.maximum(end - 2, start)] if len(end) else last
        is_stop = np.isin(last, STOPS) | (np.isin(last, QUOTES) & np.isin(before, STOPS))
        stops = np.flatnonzero(is_stop)
        return ids, ends[np.searchsorted(row, np.arange(len(texts) + 1))], ends[stops + 1], row[stops]

    def _encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, stops, rows = [], [], []
        for k, (text, x) in enumerate(zip(texts, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True)):
            until = np.array([e for _, e in x.offsets], np.int64)
            at = np.array([m.end() for m in re.finditer(r"[.!?][\"']?(?=[ \t-\r]|$)", text)], np.int64)
            ids.append(np.array(x.ids, np.uint32))
            stops.append(np.unique(np.searchsorted(until, at, "right")))
            rows.append(np.full(len(stops[-1]), k))
        first = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64)))
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        return np.concatenate([np.zeros(0, np.uint32), *ids]), first, join(s + f for s, f in zip(stops, first, strict=False)), join(rows)


@lru_cache(2)
def _tokenizer(path: str) -> WordTokenizer:
    """A worker's tokenizer. Spark runs a task for each core, so it gets no threads of its own; each would keep memory."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    made = WordTokenizer(path)
    release()
    return made


def choose_cuts(ends: np.ndarray, costs: np.ndarray, length: int = LENGTH) -> list[int]:
    """The boundaries at which windows end, as places in ends, with the least cost.

    ends: increasing numbers of tokens, with gaps of length at most, the last of which is the end of all; costs: of a cut
    there. A window of a power of two tokens needs no padding; this is counted for the last window, where others are full
    but for a few tokens. Of equal costs, the later start of a window is taken.
    """
    n = len(ends)
    t, cost = [0, *ends.tolist()], [0, *costs.tolist()]
    best, back = [0.0] * (n + 1), [0] * (n + 1)
    queue, value = deque([0]), [0.0] * (n + 1)
    for j in range(1, n + 1):
        low = t[j] - length
        while t[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        if j == n:  # windows of a power of two tokens at the very end
            ranked = []
            for x in range(n - 1, -1, -1):
                if (size := t[n] - t[x]) > length:
                    break
                ranked.append((best[x] + cost[x] + (0 if size & (size - 1) == 0 else length - size), x))
            best[n], i = min(ranked, key=lambda r: r[0])
        else:
            best[j] = value[i] + length - t[j]
        back[j] = i
        value[j] = best[j] + cost[j] + t[j]
        while queue and value[queue[-1]] >= value[j]:
            queue.pop()
        queue.append(j)
    cuts, j = [], n
    while j:
        cuts.append(j - 1)
        j = back[j]
    return cuts[::-1]


def boundaries(doc_ends: np.ndarray, sentence_ends: np.ndarray, length: int, truncation: float) -> tuple[np.ndarray, np.ndarray]:
    """Ends and costs for choose_cuts(): after documents, after sentences, and within sentences that are longer than a window."""
    ends = np.union1d(doc_ends, sentence_ends)
    gaps = np.diff(ends, prepend=0)
    if (gaps > length).any():
        extra = [np.arange(e - g + length, e, length) for e, g in zip(ends[gaps > length], gaps[gaps > length], strict=True)]
        ends = np.union1d(ends, np.concatenate(extra))
    costs = np.full(len(ends), float(truncation))
    costs[np.searchsorted(ends, doc_ends)] = 0
    return ends, costs


class Stretch:
    """Documents waiting for their cuts."""

    def __init__(self, length: int, truncation: float):
        self.length, self.truncation = length, truncation
        self.sequence = 0
        self.clear()

    def clear(self) -> None:
        self.docs, self.ids, self.sentences, self.total = [], [], [], 0

    def add(self, doc, ids: np.ndarray, sentences: np.ndarray) -> None:
        self.docs.append(doc)
        self.ids.append(ids)
        self.sentences.append(sentences + self.total)
        self.total += len(ids)

    def pieces(self) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc, start, doc_tokens, sequence, offset) of all pieces, the ids of all, end to end, and where each piece begins in them (one more at the end); the stretch is empty afterwards."""
        if not self.docs:
            return [], *(np.zeros(0, np.int64),) * 4, np.zeros(0, np.uint32), np.zeros(1, np.int64)
        docs, sentences, sizes = self.docs, np.concatenate(self.sentences), np.fromiter(map(len, self.ids), np.int64, len(self.ids))
        ids = np.concatenate(self.ids)
        self.clear()
        doc_ends = np.cumsum(sizes)
        ends, costs = boundaries(doc_ends, sentences, self.length, self.truncation)
        cuts = ends[choose_cuts(ends, costs, self.length)]
        bounds = np.concatenate(([0], np.union1d(doc_ends, cuts)))
        starts = bounds[:-1]
        doc = np.searchsorted(doc_ends, starts, "right")
        window = np.searchsorted(cuts, starts, "right")
        opened = np.concatenate(([0], cuts))[window]
        first = self.sequence
        self.sequence += len(cuts)
        return [docs[d] for d in doc.tolist()], starts - doc_ends[doc] + sizes[doc], sizes[doc], first + window, starts - opened, ids, bounds


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, truncation: float = TRUNCATION, tokenizer: str | None = None, end_id: int = END_ID, stretch: int = STRETCH, with_ids: bool = True) -> DataFrame:
    """Tokenize and pack; one row (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) per piece.

    Each document is its ids and then end_id, so a null or empty text is that one id. Input partitions are packed by
    themselves, in their order, without a shuffle: a partition's documents are never held together, only a stretch of
    them. sequence_id holds the partition in its upper bits. Rows with equal or null ids are documents of their own.
    tokenizer: path of a file that the tokenizers library reads; it is opened on the executors.
    """
    path = tokenizer or tokenizer_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("packing", _tokenizer.cache_clear)
        words, waiting = _tokenizer(path), Stretch(length, truncation)
        upper = TaskContext.get().partitionId() << 33

        def rows() -> pa.RecordBatch:
            doc, start, total, sequence, offset, ids, bounds = waiting.pieces()
            crc = [zlib.crc32(ids[a:b]) for a, b in pairwise(bounds.tolist())]
            columns = [pa.array(doc, id_type), *(pa.array(x, pa.int64()) for x in (start, np.diff(bounds), crc, total, upper | sequence, offset))]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32))))
            return pa.record_batch(columns, names + ["ids"] * with_ids)

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for a, b in slices(batch.column(1), PART):
                part = batch.slice(a, b - a)
                ids, first, stops, of = words.encode(pc.fill_null(part.column(1), ""))
                last = np.searchsorted(of, np.arange(len(part) + 1))
                for k, doc in enumerate(part.column(0).to_pylist()):
                    waiting.add(doc, np.append(ids[first[k] : first[k + 1]].astype(np.uint32), np.uint32(end_id)), stops[last[k] : last[k + 1]] - first[k])
                    if waiting.total >= stretch:
                        yield rows()
        yield rows()
        release()

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op5_pack_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of up to LENGTH tokens; see pack_documents() for nulls, ties and repeated rows."""
    return pack_documents(documents(spark, sf_dir), with_ids=False).withColumnRenamed("id", "doc_id")
