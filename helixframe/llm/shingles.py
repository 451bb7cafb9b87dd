"""Hashed word shingles of many texts at once."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at once (a longer text is still hashed whole), which bounds the arrays beside it.
PART = 1 << 20
_R = 0x9E3779B97F4A7C15


_caches: dict[str, Callable[[], None]] = {}


def enter(work: str, forget: Callable[[], None] | None = None) -> None:
    """Begin a task of some work in a worker: what other work keeps from task to task is forgotten, what this work keeps (and forget clears) stays."""
    for other in [w for w in _caches if w != work]:
        _caches.pop(other)()
        release()
    if forget is not None:
        _caches[work] = forget


def release() -> None:
    """Give memory that is not held any more back to the machine at the end of a task: workers live on, and other work follows."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # as in glibc
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of each number."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte, with A-Z as a-z; and which bytes end words."""
    value = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)
    value[65:91] = value[97:123]
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return value, space


@lru_cache(1)
def term_tables() -> tuple[np.ndarray, np.ndarray]:
    """As _tables(), for terms: words of letters, digits and all characters beyond ASCII."""
    inside = np.zeros(256, bool)
    inside[48:58] = inside[65:91] = inside[97:123] = inside[128:] = True
    return _tables()[0], ~inside


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_R ** i and its inverse for i < n, modulo 2 ** 64. As many as slices ask for are kept; those for a longer text are not."""
    held = len(_powers[0]) if _powers else 0
    if held >= n:
        return _powers[0][:n], _powers[1][:n]
    size = n if n > PART + 1 else min(max(n, 2 * held), PART + 1)
    made = []
    for base in (_R, pow(_R, -1, 2**64)):
        x = np.full(size, base, np.uint64)
        x[0] = 1
        made.append(np.multiply.accumulate(x))
    if size <= PART + 1:
        _powers[:] = made
    return made[0][:n], made[1][:n]


def slices(texts: pa.Array, part: int = PART) -> list[tuple[int, int]]:
    """Ranges of rows with about part bytes of text each, one row at least; null has none."""
    offsets = np.asarray(pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0))) if len(texts) else np.zeros(0, np.int64)
    out, a = [], 0
    while a < len(texts):
        before = offsets[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(offsets, before + part, "right")))
        out.append((a, b))
        a = b
    return out


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array, and where each row starts (one more at the end)."""
    wide = texts.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _starts(data: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes are of words, which of them begin one, and where rows begin."""
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    return inside, first, edges


def word_counts(texts: pa.Array, tables: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The number of words of each row, as word_spans() finds them."""
    data, offsets = as_bytes(texts)
    first = _starts(data, offsets, (tables or _tables())[1])[1]
    return np.diff(np.searchsorted(np.flatnonzero(first), offsets))


def word_spans(texts: pa.Array, tables: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words (runs of anything but ASCII white space): the hash (A-Z as a-z), the row, the first byte and the end in the bytes of all rows; and those bytes. tables: such as term_tables(), for other words."""
    data, offsets = as_bytes(texts)
    value, space = tables or _tables()
    if not len(data):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3, data
    inside, first, edges = _starts(data, offsets, space)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = edges[edges > 0]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.where(inside, value[data] * up[: len(data)], np.uint64(0)), dtype=np.uint64)))
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return hashes, np.searchsorted(offsets, starts, "right") - 1, starts, ends, data


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of word_spans()."""
    return word_spans(texts)[:2]


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each row; a row with fewer words than size has them all as one, a row without words none."""
    out: list[np.ndarray] = []
    texts = pc.fill_null(texts, "")
    factors = [np.uint64(pow(_R, 2 * j + 3, 2**64) | 1) for j in range(size)]
    for a, b in slices(texts):
        h, row = words(texts.slice(a, b - a))
        n = max(0, len(h) - size + 1)
        sh = np.zeros(n, np.uint64)
        for j, f in enumerate(factors):
            sh += h[j : n + j] * f
        sh = mix(sh)
        begin = np.searchsorted(row, np.arange(b - a + 1))
        for k in range(b - a):
            i, j = int(begin[k]), int(begin[k + 1])
            if j - i >= size:
                out.append(np.unique(sh[i : j - size + 1]))
            elif j > i:
                whole = sum((int(x) * int(f) for x, f in zip(h[i:j], factors, strict=False)), j - i) % 2**64
                out.append(mix(np.array([whole], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
