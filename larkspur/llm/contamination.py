"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores the postings of all words of the training texts, once: the
index is partitioned by documents, a row for each ``CHUNK_BYTES`` of text with the
sorted terms, how often each stands there and its positions.  Partitioned by terms, the
list of a word that every text has would be one task's; here it is spread over all.
``search`` takes each query window's terms from the rarest (by postings in the whole
index) to the most frequent: rows of the index that lack one of them are left out at
the first that is missing, then the position lists, each adjusted by the term's offset,
are intersected in the same order.  With ``slop`` = 0 that finds exact phrases; with a
larger one, proximity matches, in which each term may stand up to ``slop`` words beside
its place.

The benchmark is a stated query set: blocks of bounded size are searched for in the
stored index, one after another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from ._store import drop, small_batches, stage
from ._words import LOWERED, batch_bytes, gram_hashes, lean, slices, word_hashes, words_of

WINDOW = 13
BLOCK_BYTES = 4 << 20
#: Text of a row of the index; a longer text is a row by itself.
CHUNK_BYTES = 1 << 19


class Block:
    """Windows of some items: hashed terms, and the items of each distinct window."""

    def __init__(self, ids: list, texts: list, window: int):
        """Items may repeat; equal windows of several items are searched for once."""
        w = words_of(pa.array(texts, pa.string()), LOWERED, fold=True)
        self.h = word_hashes(w)
        self.ids = ids
        starts, sizes, items = [], [], []
        for k, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
            m = min(window, b - a)
            if m:
                s = np.arange(a, b - m + 1)
                starts.append(s)
                sizes.append(np.full(len(s), m))
                items.append(np.full(len(s), k))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        starts, sizes, items = cat(starts), cat(sizes), cat(items)
        key = np.zeros(len(starts), np.uint64)
        for m in np.unique(sizes):
            at = sizes == m
            key[at] = gram_hashes(self.h, int(m))[starts[at]] + np.uint64(m)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        self.starts, self.sizes = starts[first], sizes[first]
        order = np.argsort(which, kind="stable")
        self.items = items[order]
        self.item_at = np.r_[0, np.cumsum(np.bincount(which, minlength=len(first)))]
        self.terms, self.term = np.unique(self.h, return_inverse=True)
        self.order = np.zeros((len(self.starts), 0), np.uint8 if window < 256 else np.uint32)

    def rank(self, postings: np.ndarray, step: int = 1 << 16) -> None:
        """Offsets of each window's terms, those with the fewest postings first; past a short window's end its last term stands again."""
        longest = int(self.sizes.max()) if len(self.sizes) else 0
        self.order = np.zeros((len(self.starts), longest), self.order.dtype)
        for i in range(0, len(self.starts), step):
            offset = np.minimum(np.arange(longest), self.sizes[i : i + step, None] - 1)
            rare = np.argsort(postings[self.term[self.starts[i : i + step, None] + offset]], 1, kind="stable")
            self.order[i : i + step] = np.take_along_axis(offset, rare, 1)

    def nth(self, alive: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Offset and number of the j-th rarest term of some windows."""
        offset = self.order[alive, j].astype(np.int64)
        return offset, self.term[self.starts[alive] + offset]


def blocks(bench: DataFrame, item: str, text: str, window: int, most: int = BLOCK_BYTES) -> Iterator[Block]:
    ids, texts, n = [], [], 0
    for r in bench.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null").toLocalIterator():
        ids.append(r["i"] or "")
        texts.append(r["t"])
        n += len(r["t"])
        if n >= most:
            yield Block(ids, texts, window)
            ids, texts, n = [], [], 0
    if ids:
        yield Block(ids, texts, window)


def build_index(docs: DataFrame, text: str, row_id: str) -> DataFrame:
    """ids (of the rows), texts (SHA-256 of each), n_words, and terms, counts, positions (packed numpy arrays).

    Positions count words through all texts of a row of the index, with a hole between two texts.
    """
    id_type = docs.schema[row_id].dataType
    schema = StructType([StructField("ids", ArrayType(id_type)), StructField("texts", ArrayType(BinaryType())), StructField("n_words", ArrayType(LongType())), *[StructField(c, BinaryType()) for c in ("terms", "counts", "positions")]])

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch_bytes(batch.column(1))[1])
            for i, j in slices(sizes, CHUNK_BYTES):
                ids, texts = batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)
                w = words_of(texts, LOWERED, fold=True)
                h = word_hashes(w)
                n = np.diff(w.first)
                order = np.argsort(h, kind="stable")
                begin = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, np.int64)
                pos = (order + np.repeat(np.arange(len(n)), n)[order]).astype(np.uint32)
                raw, at = batch_bytes(texts)
                raw = memoryview(raw)
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids.to_pylist()], pa.list_(ids.type)),
                    pa.array([[hashlib.sha256(raw[a:b]).digest() for a, b in zip(at[:-1], at[1:], strict=True)]], pa.list_(pa.binary())),
                    pa.array([n.tolist()], pa.list_(pa.int64())),
                    *[pa.array([x.tobytes()], pa.binary()) for x in (h[order[begin]], np.diff(np.r_[begin, len(h)]).astype(np.uint32), pos)],
                ], names=["ids", "texts", "n_words", "terms", "counts", "positions"])

    return docs.select(row_id, text).mapInArrow(lean(run), schema)


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Postings of each term in the whole index; as many numbers as the block has terms."""

    def run(batches):
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for t, c in zip(batch.column(0), batch.column(1), strict=True):
                have, n = np.frombuffer(t.as_py(), np.uint64), np.frombuffer(c.as_py(), np.uint32)
                at, there = _found(have, terms)
                total[there] += n[at[there]]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["t", "n"])

    out = np.zeros(len(terms), np.int64)
    for r in index.select("terms", "counts").mapInArrow(lean(run), "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():
        out[r["t"]] = r["n"]
    return out


def _found(have: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of terms would stand in the sorted have, and whether it does."""
    at = np.searchsorted(have, terms)
    return at, (at < len(have)) & (have[np.minimum(at, len(have) - 1)] == terms) if len(have) else np.zeros(len(terms), bool)


def _near(keys: np.ndarray, want: np.ndarray, slop: int) -> np.ndarray:
    """Whether a sorted list has a number within slop of each wanted one; the upper half of a number names its list."""
    if not len(keys):
        return np.zeros(len(want), bool)
    k = np.searchsorted(keys, want - slop)
    return (k < len(keys)) & (keys[np.minimum(k, len(keys) - 1)] <= want + slop)


def intersect(b: Block, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, position) of all matches in one row of the index."""
    local, there = _found(terms, b.terms)
    alive, longest = np.arange(len(b.starts)), b.order.shape[1]
    for j in range(longest):
        alive = alive[there[b.nth(alive, j)[1]]]
    if not len(alive):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.r_[0, np.cumsum(counts)].astype(np.int64)
    keys = (np.repeat(np.arange(len(terms)), counts) << 33) + positions.astype(np.int64) + 64
    offset, term = b.nth(alive, 0)
    n = counts[local[term]].astype(np.int64)
    win = np.repeat(np.arange(len(alive)), n)
    k = np.arange(len(win)) - np.repeat(np.cumsum(n) - n, n)
    start = positions[begin[local[term]][win] + k].astype(np.int64) - offset[win]
    ok = start >= 0
    win, start = win[ok], start[ok]
    for j in range(1, longest):
        offset, term = b.nth(alive[win], j)
        ok = _near(keys, (local[term] << 33) + start + offset + 64, slop)
        win, start = win[ok], start[ok]
        if not len(win):
            break
    return alive[win], start


def search(index: DataFrame, b: Block, row_id_type, slop: int = 0) -> DataFrame:
    """One row per text: id, text (SHA-256), n_words, n_hit (words inside a match) and items (sorted)."""
    schema = StructType([StructField("id", row_id_type), StructField("text", BinaryType()), StructField("n_words", LongType()), StructField("spans", ArrayType(LongType())), StructField("items", ArrayType(StringType()))])

    def run(batches):
        for batch in batches:
            for r in range(len(batch)):
                ids, texts, n_words, terms, counts, positions = (batch.column(c)[r] for c in range(6))
                n = np.array(n_words.as_py(), np.int64)
                win, start = intersect(b, np.frombuffer(terms.as_py(), np.uint64), np.frombuffer(counts.as_py(), np.uint32), np.frombuffer(positions.as_py(), np.uint32), slop)
                base = np.cumsum(n + 1) - (n + 1)  # where each text's positions begin
                doc = np.searchsorted(base, start, "right") - 1
                spans, items = [[] for _ in n], [[] for _ in n]
                order = np.lexsort((start, doc))
                for d in np.unique(doc):
                    mine = order[np.searchsorted(doc[order], d) : np.searchsorted(doc[order], d, "right")]
                    lo = start[mine] - base[d]
                    spans[d] = _union(np.maximum(lo - slop, 0), np.minimum(lo + b.sizes[win[mine]] + slop, n[d]))
                    items[d] = sorted({b.ids[k] for x in np.unique(win[mine]) for k in b.items[b.item_at[x] : b.item_at[x + 1]]})
                yield pa.RecordBatch.from_arrays([ids.values, texts.values, pa.array(n), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["id", "text", "n_words", "spans", "items"])

    return index.mapInArrow(lean(run), schema)


def _union(lo: np.ndarray, hi: np.ndarray) -> list:
    """Begin and end of each piece, one after another."""
    order = np.argsort(lo)
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.r_[True, lo[1:] > hi[:-1]]
    begin = lo[new]
    end = hi[np.r_[np.flatnonzero(new)[1:] - 1, len(hi) - 1]]
    return np.stack([begin, end], 1).ravel().tolist()


def contamination(docs: DataFrame, bench: DataFrame, text: str = "text", row_id: str = "doc_id", item: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """One row per row of docs: id, text (SHA-256 of it), n_words, n_hit, spans (begin and end of each hit piece), items (ids as strings, distinct, sorted).

    Null texts have no words.  Items without words ask for nothing; an item shorter
    than the window is one window.  A null item id counts as the empty string.
    Repeated rows of docs give repeated rows.  Other columns are not read.
    """
    id_type, spark, found, more = docs.schema[row_id].dataType, docs.sparkSession, None, []
    with small_batches(spark):
        index = stage(build_index(docs, text, row_id), "postings")
    with small_batches(spark, 8):  # of rows of the index
        for b in blocks(bench, item, item_text, window):
            b.rank(term_counts(index, b.terms))
            hits = search(index, b, id_type, slop)
            if found is None:
                found = stage(hits, "hits")
            else:
                hits = stage(hits.where(F.size("spans") > 0).select("text", "spans", "items"), "hits")
                more.append(hits.dropDuplicates(["text"]))
        if found is None:  # no item with words
            found = stage(search(index, Block([], [], window), id_type), "hits")
    drop(index)
    return _finish(_merged(found, more) if more else found)


def _merged(first: DataFrame, more: list[DataFrame]) -> DataFrame:
    """What later blocks found in a text joins what the first one found; equal texts have equal pieces."""
    rest = more[0]
    for m in more[1:]:
        rest = rest.unionByName(m)
    rest = rest.groupBy("text").agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"))
    both = lambda a, b: F.concat(a, F.coalesce(b, F.slice(a, 1, 0)))
    rows = first.join(rest, "text", "left").select("id", "text", "n_words", both(F.col("spans"), F.col("s")).alias("spans"), both(F.col("items"), F.col("i")).alias("items"))

    def run(batches):
        for batch in batches:
            spans = [_union(np.array(x[::2]), np.array(x[1::2])) if x else [] for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, pa.list_(pa.int64())), batch.column(4)], names=batch.schema.names)

    return rows.mapInArrow(lean(run), rows.schema)


def _finish(hits: DataFrame) -> DataFrame:
    # one block's pieces do not overlap
    pieces = F.transform(F.sequence(F.lit(0), (F.size("spans") / 2).cast("int") - 1), lambda k: F.get("spans", 2 * k + 1) - F.get("spans", 2 * k))
    n_hit = F.when(F.size("spans") > 0, F.aggregate(pieces, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))
    return hits.select("id", "text", "n_words", n_hit.alias("n_hit"), "spans", F.array_sort(F.array_distinct("items")).alias("items"))
