"""Words of many texts at once, in numpy.

Everything works on the UTF-8 bytes of a batch of texts.  A word is a maximal
run of bytes of a class (a 256-entry table), so the regular expressions
``[^\\x20\\x09-\\x0D]+`` and ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` are both exact:
their complements hold ASCII only, and no byte of a longer UTF-8 sequence is ASCII.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_SPACE = np.ones(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
SPACED = _SPACE  # [^\x20\x09-\x0D]+
_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x41:0x5B] = _ALNUM[0x61:0x7B] = True
_ALNUM[0x80:] = True
LOWERED = _ALNUM.copy()  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lowered

FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32

_R = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, vectorised."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: A random word for each byte and the powers of an odd base with their inverses.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _R)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def lean(run):
    """An Arrow function that gives freed memory back when its task ends: workers are kept, and idle ones count too."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    _TABLES.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Words(NamedTuple):
    raw: np.ndarray  # bytes of all texts, one after another
    text_at: np.ndarray  # n + 1 offsets of texts in raw
    start: np.ndarray  # of each word in raw
    end: np.ndarray
    first: np.ndarray  # n + 1 offsets of texts in the words


def batch_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets; a null text counts as empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words_of(texts: pa.Array, inside: np.ndarray = SPACED, fold: bool = False) -> Words:
    raw, at = batch_bytes(texts)
    if fold:
        raw = FOLD[raw]
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(raw, at, none, none, np.zeros(len(at), np.int64))
    flag = np.zeros(n + 2, np.int8)
    flag[1:-1] = inside[raw]
    # texts touch each other in raw: a word ends where its text ends
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    step = np.diff(flag)
    start, end = step == 1, step == -1
    both = edge[(flag[edge] == 1) & (flag[edge + 1] == 1)]
    start[both] = end[both] = True
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    return Words(raw, at, s, e, np.searchsorted(s, at))


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes; it depends on nothing else."""
    out = np.zeros(len(w.start), np.uint64)
    step = 1 << 18
    i = 0
    with np.errstate(over="ignore"):
        while i < len(w.start):  # small blocks stay in the cache
            j = max(i + 1, int(np.searchsorted(w.start, w.start[i] + step)))
            lo, hi = int(w.start[i]), int(w.end[j - 1])
            n = hi - lo
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[w.raw[lo:hi]] * _pow(n)[0][:n], out=sums[1:])
            s, e = w.start[i:j] - lo, w.end[i:j] - lo
            out[i:j] = mix((sums[e] - sums[s]) * _pow(n)[1][s] + (e - s).astype(np.uint64) * _R)
            i = j
    return out


_TABLES: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES or len(_TABLES[0]) < n:
        size = max(n, 1 << 19)
        _TABLES[:] = [_powers(_BASE, size), _powers(_INVERSE, size)]
    return _TABLES[0], _TABLES[1]


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Of each k words in a row (across text ends too: the caller leaves those out)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out *= np.uint64(_BASE)
            out += h[i : i + n]
        return mix(out)


def slices(n_bytes: np.ndarray, most: int = 1 << 20):
    """Index ranges of texts of together about ``most`` bytes, at least one text each."""
    ends = np.cumsum(n_bytes)
    i = 0
    while i < len(n_bytes):
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + most, "right")))
        yield i, j
        i = j
