"""Substring dedup: repeated spans of words, by a compacted de Bruijn graph.

1. Anchors.  Of the k-mers (k = 8 words) in every window of 35 words, those with the
   smallest hash are anchors; equal windows have equal anchors at equal offsets.
   Only windows with an anchor that stands in a second place can repeat.
2. Graph.  Repeated anchors are the nodes; the words from one anchor of a text through
   the next are its edge.  A link does not branch if all places of the first anchor go
   on with one edge, and all places of the second are reached by it.  Spark joins link
   nodes and, by pointer doubling, compact each path of such links to its head.
3. Coordinates.  A place of a head is a place of the whole path: all its windows
   repeat.  Windows with a repeated anchor outside of such spans (where paths branch)
   are compared with each other by the hash of all their words.

Words of repeated windows are removed.  Texts with a copy repeat as a whole; they are
told apart by 128 bits, other values by 64.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._exchange import places, repeated
from ._store import drop, parts, stage
from ._words import Words, batch_bytes, gram_hashes, lean, slices, word_hashes, words_of

WINDOW, K = 35, 8


def _slide(g: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w in a row."""
    n = len(g) - w + 1
    if n <= 0:
        return g[:0]
    have, m = 1, g
    while 2 * have <= w:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    return np.minimum(m[:n], m[w - have : w - have + n])


class Texts:
    """The windows and anchors of a batch of texts."""

    def __init__(self, texts: pa.Array, window: int = WINDOW, k: int = K):
        self.w: Words = words_of(texts)
        self.h = word_hashes(self.w)
        self.n = np.diff(self.w.first)
        self.window, self.k = window, k
        span = window - k + 1
        low = _slide(gram_hashes(self.h, k), span)
        self.text = np.repeat(np.arange(len(self.n)), self.n)
        inside = np.zeros(len(low), bool)
        if len(low):
            inside[:] = self.text[: len(low)] == self.text[window - 1 :]
        self.low, self.inside = low, inside  # of windows, by their first word
        # anchors: k-mers that are the smallest of some window around them
        g = gram_hashes(self.h, k)
        anchor = np.zeros(len(g), bool)
        if len(low):
            # with windows that cross texts left out, ``high`` is the largest low of the windows around a k-mer
            lows = np.where(inside, low, 0)
            padded = np.r_[np.zeros(span - 1, np.uint64), lows, np.zeros(span - 1, np.uint64)]
            high = ~_slide(~padded, span)
            anchor = (g <= high[: len(g)]) & (high[: len(g)] > 0)
        self.g = g
        self.anchors = np.flatnonzero(anchor)

    def local(self, at: np.ndarray) -> np.ndarray:
        return at - self.w.first[self.text[at]]


def _keys(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.names.index(name)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _pieces(batch: pa.RecordBatch, name: str = "text", most: int = 1 << 20):
    col = batch.column(batch.schema.names.index(name))
    for i, j in slices(np.diff(batch_bytes(col)[1]), most):
        yield batch.slice(i, j - i)


def _anchor_entries(batch: pa.RecordBatch):
    for part in _pieces(batch):
        t = Texts(part.column(part.schema.names.index("text")))
        a = t.anchors
        yield t.g[a], _keys(part, "k1")[t.text[a]], t.local(a).astype(np.uint32)


def kept_digest(w: Words, gone: np.ndarray) -> tuple[np.ndarray, list]:
    """Words removed from each text, and the SHA-256 of the others joined by one space."""
    n = len(w.first) - 1
    text = np.repeat(np.arange(n), np.diff(w.first))
    keep = np.flatnonzero(~gone)
    raw, mask = w.raw.copy(), np.zeros(len(w.raw) + 1, np.int8)
    np.add.at(mask, w.start[keep], 1)
    np.add.at(mask, w.end[keep], -1)
    mask = np.cumsum(mask, dtype=np.int8)[:-1].astype(bool)
    apart = keep[:-1][text[keep[1:]] == text[keep[:-1]]] if len(keep) else keep  # another kept word of the text follows
    raw[w.end[apart]] = 0x20
    mask[w.end[apart]] = True
    out = raw[mask].tobytes()
    at = np.r_[0, np.cumsum(mask)][w.text_at]
    removed = np.diff(w.first) - np.bincount(text[keep], minlength=n)
    return removed, [hashlib.sha256(out[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]


_RESULT = "k1 long, id {id}, n_words long, n_removed long, kept_sha256 string"


def _first_pass(id_type: str):
    """Rows of docs: those without a repeated anchor, or with a copy, are done; others (and one of the copies) go on with their graph."""
    schema = _RESULT.format(id=id_type) + ", text string, flagged binary, nodes binary, nexts binary, edges binary, prevs binary, gaps binary"

    def run(batches):
        for batch in batches:
            for part in _pieces(batch):
                names = part.schema.names
                col = lambda c: part.column(names.index(c))  # noqa: B023, E731
                t = Texts(col("text"))
                n = len(part)
                # whole texts with a copy go
                dups = col("dups").to_pylist()
                k2 = col("k2").to_pylist()
                copied = np.array([bool(d) and k in d for d, k in zip(dups, k2, strict=True)], bool) & (t.n >= t.window)
                gone = copied[t.text] if len(t.text) else np.zeros(0, bool)
                removed, digest = kept_digest(t.w, gone)
                flagged, packs, go_on = [], [[] for _ in range(5)], []
                at = col("at").to_pylist()
                for i in range(n):
                    here = places(at[i])
                    go_on.append(len(here) > 0)
                    flagged.append(here.astype(np.uint32).tobytes() if len(here) else None)
                    for p, x in zip(packs, _edges(t, i, here) if len(here) else [None] * 5, strict=True):
                        p.append(x)
                go = np.array(go_on, bool)
                done = ~go | copied
                num = lambda x: pa.array([int(v) if d else None for v, d in zip(x, done, strict=True)], pa.int64())  # noqa: B023, E731
                texts = [x if g else None for x, g in zip(col("text").to_pylist(), go, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    col("k1"), col("id"), num(t.n), num(removed), pa.array([d if k else None for d, k in zip(digest, done, strict=True)], pa.string()),
                    pa.array(texts, pa.string()), pa.array(flagged, pa.binary()), *[pa.array(p, pa.binary()) for p in packs],
                ], names=["k1", "id", "n_words", "n_removed", "kept_sha256", "text", "flagged", "nodes", "nexts", "edges", "prevs", "gaps"])

    return run, schema


def _edges(t: Texts, i: int, here: np.ndarray) -> list[bytes]:
    """For the repeated anchors of text i: node, next node (0: not repeated), the edge to and from its neighbours (0: none), and the words to the next."""
    a0, a1 = np.searchsorted(t.anchors, [t.w.first[i], t.w.first[i + 1]])
    at = t.anchors[a0:a1]
    v = t.g[at]
    is_rep = np.isin(at - t.w.first[i], here)
    sums = np.zeros(0, np.uint64)
    if len(at) > 1:
        gaps = np.diff(at)
        # the edge's words are the first anchor's, those between, and the second anchor's: hashes of k-mers along the way fix them all
        run = np.r_[np.uint64(0), np.cumsum(t.g[at[0] : at[-1] + 1] * np.uint64(0x9E3779B97F4A7C15) ^ t.g[at[0] : at[-1] + 1] >> np.uint64(29))]
        sums = (run[at[1:] + 1 - at[0]] - run[at[:-1] - at[0]]) * np.uint64(2) | np.uint64(1)
        sums ^= (v[:-1] >> np.uint64(3)) << np.uint64(1)
    else:
        gaps = np.zeros(0, np.int64)
    zero = np.zeros(1, np.uint64)
    nxt = np.where(np.r_[is_rep[1:], False], np.r_[v[1:], zero], 0) if len(v) else v
    out = (v, nxt.astype(np.uint64), np.r_[sums, zero], np.r_[zero, sums], np.r_[gaps, 0].astype(np.uint32))
    return [x[is_rep].tobytes() for x in out]


def _edge_rows(batches):
    for batch in batches:
        cols = [[], [], [], [], [], [], []]
        for k, *packs in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
            flagged, nodes, nexts, edges, prevs, gaps = packs
            if not nodes:
                continue
            arrays = [np.frombuffer(nodes, np.int64), np.frombuffer(nexts, np.int64), np.frombuffer(edges, np.int64), np.frombuffer(prevs, np.int64), np.frombuffer(gaps, np.uint32).astype(np.int64)]
            pos = np.frombuffer(flagged, np.uint32).astype(np.int64)
            cols[0].append(np.full(len(pos), k))
            cols[1].append(pos)
            for c, x in zip(cols[2:], arrays, strict=True):
                c.append(x)
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["key", "pos", "v", "nxt", "e", "p", "gap"])


def compact(edges: DataFrame) -> DataFrame:
    """edges: key, pos, v, nxt, e, p, gap.  Heads of nonbranching paths: v and words (from the head's first word to the last node's last)."""
    node = edges.groupBy("v").agg(F.min("e").alias("e"), F.max("e").alias("e2"), F.min("p").alias("p"), F.max("p").alias("p2"), F.max("nxt").alias("nxt"), F.max("gap").alias("gap"))
    node = stage(node, "graph-nodes")
    one_out = node.where("e = e2 and e <> 0 and nxt <> 0").select(F.col("v").alias("u"), F.col("nxt").alias("v"), "e", "gap")
    one_in = node.where("p = p2 and p <> 0").select("v", "p")
    links = stage(one_out.join(one_in, "v").where("e = p").select("u", "v", "gap"), "graph-links")
    # each linked node points to its predecessor; heads point to themselves
    heads = links.select(F.col("u").alias("v")).join(links.select("v"), "v", "left_anti").distinct()
    points = stage(links.select("v", F.col("u").alias("to"), "gap").unionByName(heads.select("v", F.col("v").alias("to"), F.lit(0).cast("long").alias("gap"))), "graph-points")
    drop(node)
    while True:
        there = points.select(F.col("v").alias("to"), F.col("to").alias("to2"), F.col("gap").alias("gap2"))
        far = points.join(there, "to").select("v", F.col("to2").alias("to"), (F.col("gap") + F.col("gap2")).alias("gap"), (F.col("to") != F.col("to2")).alias("moved"))
        far = stage(far, "graph-points")
        drop(points)
        points = far
        if not far.where("moved").limit(1).count():
            break
        points = far.drop("moved")
        points._larkspur_path = far._larkspur_path
    drop(links)
    return points.groupBy(F.col("to").alias("v")).agg((F.max("gap") + K).alias("words"))


def _window_entries(batch: pa.RecordBatch):
    """Windows with a repeated anchor that no path of the text covers."""
    for part in _pieces(batch):
        names = part.schema.names
        col = lambda c: part.column(names.index(c)).to_pylist()  # noqa: B023, E731
        t = Texts(part.column(names.index("text")))
        rest = _rest(t, col("flagged"), col("spans"))
        whole = gram_hashes(t.h, t.window)
        yield whole[rest], _keys(part, "k1")[t.text[rest]], t.local(rest).astype(np.uint32)


def _rest(t: Texts, flagged: list, spans: list) -> np.ndarray:
    out = []
    for i, (f, s) in enumerate(zip(flagged, spans, strict=True)):
        first, n = int(t.w.first[i]), int(t.n[i]) - t.window + 1
        if n <= 0 or not f:
            continue
        vals = np.unique(t.g[first + np.frombuffer(f, np.uint32).astype(np.int64)])
        low = t.low[first : first + n]
        k = np.minimum(np.searchsorted(vals, low), len(vals) - 1)
        ok = vals[k] == low
        for x in s or []:
            ok[x["pos"] : max(x["pos"], x["pos"] + x["words"] - t.window + 1)] = False
        out.append(first + np.flatnonzero(ok))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _last_pass(id_type: str):
    schema = _RESULT.format(id=id_type)

    def run(batches):
        for batch in batches:
            for part in _pieces(batch):
                names = part.schema.names
                col = lambda c: part.column(names.index(c))  # noqa: B023, E731
                w = words_of(col("text"))
                delta = np.zeros(len(w.start) + 1, np.int64)
                for i, (s, a) in enumerate(zip(col("spans").to_pylist(), col("at").to_pylist(), strict=True)):
                    first = int(w.first[i])
                    for x in s or []:
                        if x["words"] >= WINDOW:
                            delta[first + x["pos"]] += 1
                            delta[first + x["pos"] + x["words"]] -= 1
                    if a:
                        at = first + places(a)
                        delta[at] += 1
                        np.subtract.at(delta, at + WINDOW, 1)
                removed, digest = kept_digest(w, np.cumsum(delta[:-1]) > 0)
                yield pa.RecordBatch.from_arrays([col("k1"), col("id"), pa.array(np.diff(w.first)), pa.array(removed), pa.array(digest, pa.string())], names=["k1", "id", "n_words", "n_removed", "kept_sha256"])

    return run, schema


def remove_repeats(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space).

    A null text has no words; texts of fewer than 35 words lose nothing; repeated rows
    are copies of each other and lose every word from 35 on.  Null ids stay null.
    Other columns are not read.
    """
    id_type = docs.schema[row_id].dataType.simpleString()
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(row_id).alias("id"), whole.alias("text"), F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit(1), whole).alias("k2"))
    copies = rows.select("k1", "k2", F.octet_length("text").cast("long").alias("n")).groupBy("k1", "k2").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    copies = stage(copies, "copies")
    total = copies.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    spark = docs.sparkSession
    buckets = max(parts(spark), total >> 24)
    anchors = repeated(rows.select("k1", "text"), _anchor_entries, buckets)
    dups = copies.where("rows > 1").groupBy(F.col("k1").alias("key")).agg(F.collect_list("k2").alias("dups"))
    told = stage(anchors.join(dups, "key", "full_outer"), "anchors")
    # the second key lets a hot text's rows be split
    told2 = told.select(F.col("key").alias("k1"), F.pmod("key", F.lit(7)).alias("m"), "at", "dups")
    run, schema = _first_pass(id_type)
    first = stage(rows.withColumn("m", F.pmod("k1", F.lit(7))).join(told2, ["k1", "m"], "left").select("k1", "k2", "id", "text", "at", "dups").mapInArrow(lean(run), schema), "first-pass")
    drop(told, copies)
    # of a text with copies each row goes on; they are one place all the same, since places are told apart by text
    graph = first.where("nodes is not null")
    edges = graph.select("k1", "flagged", "nodes", "nexts", "edges", "prevs", "gaps").mapInArrow(_edge_rows, "key long, pos long, v long, nxt long, e long, p long, gap long")
    edges = stage(edges, "edges")
    heads = compact(edges).where(F.col("words") >= WINDOW)
    spans = edges.withColumn("m", F.pmod("v", F.lit(7))).select("v", "m", "key", "pos").join(heads.withColumn("m", F.pmod("v", F.lit(7))), ["v", "m"])
    spans = stage(spans.groupBy("key").agg(F.collect_set(F.struct("pos", "words")).alias("spans")), "spans")
    drop(edges)
    open_ = graph.select("k1", "id", "text", "flagged", F.col("n_words").isNotNull().alias("done"))
    keyed = lambda t: t.withColumnRenamed("key", "k1").withColumn("m", F.pmod("k1", F.lit(7)))
    open_ = open_.withColumn("m", F.pmod("k1", F.lit(7))).join(keyed(spans), ["k1", "m"], "left")
    hits = repeated(open_.select("k1", "text", "flagged", "spans"), _window_entries, buckets)
    hits = stage(hits, "windows")
    run, schema = _last_pass(id_type)
    last = open_.where("not done").join(keyed(hits), ["k1", "m"], "left").select("k1", "id", "text", "spans", "at").mapInArrow(lean(run), schema)
    out = first.where("n_words is not null").select("k1", "id", "n_words", "n_removed", "kept_sha256").unionByName(last)
    return out.drop("k1")
