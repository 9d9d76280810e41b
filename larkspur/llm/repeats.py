"""Quality rules: repetition inside a text, by suffix arrays.

The suffixes of all words of a text are ranked by prefix doubling (each round sorts
only suffixes that are not yet told apart, for many texts at once).  The longest
common prefixes of neighbours come from the ranks of all rounds.  A position whose
longest repeat is l words begins an interval of that length; the intervals that
cannot be extended to the left are the maximal repeats.  A text fails if the union
of the repeats of ``min_words`` or more covers too much of it, or if one repeat is
too long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._words import Words, batch_bytes, lean, slices, word_hashes, words_of

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_LEAD = np.ones(256, np.int64)  # bytes that begin a code point
_LEAD[0x80:0xC0] = 0

SCHEMA = ("__n_words long, __word_chars long, __n_symbols long, __n_dup_lines long, __n_repeat_words long, "
          "__covered long, __longest long, __n_repeats long")


def _rounds(h: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """ranks[k][i]: equal for two positions exactly if 2**k words from there agree, ends of texts included."""
    n = len(h)
    _, first = np.unique(h, return_inverse=True)
    key = text.astype(np.int64) * (int(first.max()) + 1) + first
    # a rank is the number of suffixes before its group, so ranks keep the order of suffixes
    _, group, sizes = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.cumsum(sizes) - sizes
    ranks, step = [starts[group]], 1
    last = np.r_[np.flatnonzero(np.diff(text)), n - 1]
    end = np.repeat(last, np.diff(np.r_[-1, last]))  # last position of each position's text
    open_ = np.flatnonzero(sizes[group] > 1)
    while len(open_):
        r = ranks[-1]
        there = open_ + step
        ahead = np.where(there <= end[open_], r[np.minimum(there, n - 1)] + 1, 0)
        order = np.lexsort((ahead, r[open_]))
        a, b = r[open_][order], ahead[order]
        old = np.r_[True, a[1:] != a[:-1]]
        new = old | np.r_[True, b[1:] != b[:-1]]
        at = np.arange(len(a))
        begin = np.maximum.accumulate(np.where(old, at, 0))
        mine = np.maximum.accumulate(np.where(new, at, 0))
        out = r.copy()
        out[open_[order]] = a + (mine - begin)
        ranks.append(out)
        group = np.cumsum(new) - 1
        open_ = np.sort(open_[order][np.bincount(group)[group] > 1])
        step *= 2
    return ranks


def _longest(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each position, the words of the longest repeat that begins there (0: none)."""
    n = len(h)
    ranks = _rounds(h, text)
    last = np.r_[np.flatnonzero(np.diff(text)), n - 1]
    end = np.repeat(last, np.diff(np.r_[-1, last])) + 1
    best = np.zeros(n, np.int64)
    order = np.argsort(ranks[-1])
    i, j = order[:-1], order[1:]
    same = ranks[0][i] == ranks[0][j]
    i, j = i[same], j[same]
    off = np.zeros(len(i), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        p, q = i + off, j + off
        ok = (p + (1 << k) <= end[i]) & (q + (1 << k) <= end[j])
        at = np.flatnonzero(ok)
        hit = at[ranks[k][p[at]] == ranks[k][q[at]]]
        off[hit] += 1 << k
    np.maximum.at(best, i, off)
    np.maximum.at(best, j, off)
    return best


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(values)]
    return sums[first[1:]] - sums[first[:-1]]


def _covered(best: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Marks the words inside any repeat of least words or more."""
    n = len(best)
    at = np.flatnonzero(best >= least)
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + best[at], -1)
    return np.cumsum(delta[:-1]) > 0


def measure(texts: pa.Array, min_words: int) -> dict[str, np.ndarray]:
    w: Words = words_of(texts)
    h = word_hashes(w)
    n = np.diff(w.first)
    text = np.repeat(np.arange(len(n)), n)
    lead = np.r_[0, np.cumsum(_LEAD[w.raw])]
    out = {"__n_words": n, "__word_chars": _per_text(lead[w.end] - lead[w.start], w.first)}
    out["__n_symbols"] = _per_text(_SYMBOL[w.raw], w.text_at)
    out["__n_dup_lines"] = _dup_lines(texts, w)
    best = _longest(h, text) if len(h) else np.zeros(0, np.int64)
    out["__n_repeat_words"] = _per_text(_covered(best, w.first, 3), w.first)
    out["__covered"] = _per_text(_covered(best, w.first, min_words), w.first)
    # maximal repeats: those that the position to the left does not contain
    left = np.r_[0, best[:-1]]
    if len(best):
        left[w.first[:-1][n > 0]] = 0
    out["__n_repeats"] = _per_text((best >= min_words) & (left != best + 1), w.first)
    most = np.zeros(len(n), np.int64)
    np.maximum.at(most, text, best)
    out["__longest"] = most
    return out


def _dup_lines(texts: pa.Array, w: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    n = len(w.first) - 1
    raw, at = w.raw, w.text_at
    if not len(w.start):
        return np.zeros(n, np.int64)
    cut = np.flatnonzero(raw == 10)
    # lines with a word: those in which some word starts
    line_of_word = np.searchsorted(cut, w.start) + np.repeat(np.arange(n), np.diff(w.first)) * (len(cut) + 1)
    firsts = np.r_[True, line_of_word[1:] != line_of_word[:-1]]
    s = w.start[firsts]
    text = np.repeat(np.arange(n), np.diff(w.first))[firsts]
    k = np.searchsorted(cut, s)
    lo = np.maximum(np.where(k > 0, cut[np.maximum(k - 1, 0)] + 1, 0) if len(cut) else 0, at[text])
    hi = np.minimum(np.where(k < len(cut), cut[np.minimum(k, len(cut) - 1)], len(raw)) if len(cut) else len(raw), at[text + 1])
    lines = Words(raw, at, np.broadcast_to(lo, s.shape).astype(np.int64), np.broadcast_to(hi, s.shape).astype(np.int64), None)
    h = word_hashes(lines)
    order = np.lexsort((h, text))
    a, b = text[order], h[order]
    dup = np.r_[False, (a[1:] == a[:-1]) & (b[1:] == b[:-1])]
    return np.bincount(a[dup], minlength=n)


def repetition(docs: DataFrame, text: str = "text", min_words: int = 8, max_covered: float = 0.3, max_repeat: int = 60, min_total: int = 50, max_windows: float = 0.5) -> DataFrame:
    """All rows and columns of docs with the measures of SCHEMA, __base_failed and __kept.

    A null or empty text has no words and fails the base rules.  Long texts are
    measured whole.  Rows do not depend on each other; columns of docs with the
    names that are added are replaced.
    """
    mine = [c.split()[0] for c in SCHEMA.split(", ")] + ["__base_failed", "__kept"]
    docs = docs.drop(*mine)
    from pyspark.sql.types import BooleanType, StructField, StructType, _parse_datatype_string

    added = _parse_datatype_string(SCHEMA)
    schema = StructType([*docs.schema.fields, *added.fields, StructField("__base_failed", BooleanType()), StructField("__kept", BooleanType())])
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            col = batch.column(at)
            sizes = np.diff(batch_bytes(col)[1])
            for i, j in slices(sizes, 1 << 20):
                part = batch.slice(i, j - i)
                m = measure(part.column(at), min_words)
                n = np.maximum(m["__n_words"], 1)
                failed = (m["__n_words"] < min_total) | (m["__n_repeat_words"] > max_windows * m["__n_words"])
                kept = ~failed & (m["__covered"] <= max_covered * n) & (m["__longest"] <= max_repeat)
                cols = [pa.array(m[f.name], pa.int64()) for f in added.fields] + [pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*batch.schema.names, *mine])

    return docs.mapInArrow(lean(run), schema)


__all__ = ["measure", "repetition"]
