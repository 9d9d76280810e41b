"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in windows of ``WINDOW``; both directions
begin each window with a zero state.  It labels every position of every window, and
the mean of the position probabilities is the text's.  It is trained in numpy by
backpropagation through time (Adam) on windows of a bounded sample of labelled rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ._words import batch_bytes, lean, slices

WINDOW = 64
HIDDEN = 8
UNKNOWN = "und"


class Model(NamedTuple):
    """Arrays are feature-major; axis 0 of the first three holds the two directions."""

    table: np.ndarray  # 2, 3H, 256: what a byte adds to gates z, r and candidate
    u: np.ndarray  # 2, 3H, H
    b: np.ndarray  # 2, H: inside the candidate, before the reset gate
    out: np.ndarray  # C, 2H
    bias: np.ndarray  # C
    langs: list


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    x *= 2
    _sigmoid(x)
    x *= 2
    x -= 1
    return x


def _forward(m: Model, x: np.ndarray, keep: bool = False):
    """x: T, N bytes.  States 2, T, H, N (the backward direction's in its own order of time)."""
    t, n = x.shape
    h3, hid = m.u.shape[1], m.u.shape[2]
    states = np.empty((2, t, hid, n), np.float32)
    saved = []
    for d in (0, 1):
        h = np.zeros((hid, n), np.float32)
        table = np.ascontiguousarray(m.table[d])
        b = m.b[d][:, None]
        for s in range(t):
            g = np.take(table, x[s] if d == 0 else x[t - 1 - s], axis=1)
            a = m.u[d] @ h
            zr = _sigmoid(g[: 2 * hid] + a[: 2 * hid])
            z, r = zr[:hid], zr[hid:]
            inner = a[2 * hid :] + b
            c = _tanh(g[2 * hid :] + r * inner)
            new = c + z * (h - c)
            if keep:
                saved.append((h, zr, inner, c))
            h = states[d, s] = new
    return (states, saved) if keep else states


def _probabilities(m: Model, states: np.ndarray) -> np.ndarray:
    """C, T, N."""
    t, hid, n = states.shape[1:]
    fwd = np.tensordot(m.out[:, :hid], states[0], (1, 1))  # C, T, N
    bwd = np.tensordot(m.out[:, hid:], states[1], (1, 1))[:, ::-1]
    o = fwd + bwd
    o += m.bias[:, None, None]
    o -= o.max(0)
    np.exp(o, out=o)
    o /= o.sum(0)
    return o


def train(x: np.ndarray, mask: np.ndarray, y: np.ndarray, langs: list, steps: int = 500, batch: int = 256, rate: float = 0.02, seed: int = 11) -> Model:
    """x, mask: N, T; y: N.  Windows are drawn evenly over the languages."""
    rng = np.random.default_rng(seed)
    c, h = len(langs), HIDDEN
    p = {
        "table": rng.normal(0, 0.3, (2, 3 * h, 256)), "u": rng.normal(0, 1 / np.sqrt(h), (2, 3 * h, h)), "b": np.zeros((2, h)),
        "out": rng.normal(0, 1 / np.sqrt(2 * h), (c, 2 * h)), "bias": np.zeros(c),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    of = [np.flatnonzero(y == k) for k in range(c)]
    for step in range(1, steps + 1):
        at = np.concatenate([rng.choice(o, max(1, batch // c)) for o in of if len(o)])
        g = _gradients(Model(**p, langs=langs), x[at].T, mask[at].T, y[at])
        lr = rate * min(1, step / 20) * (0.05 + 0.95 * (1 - step / steps))
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        for k, v in g.items():
            v = v * min(1.0, 1.0 / max(norm, 1e-9))
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.01 * (v * v - second[k])
            p[k] -= lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Model(**p, langs=langs)


def _gradients(m: Model, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean cross-entropy over all positions, back through time in both directions."""
    t, n = x.shape
    hid = m.u.shape[2]
    states, saved = _forward(m, x, keep=True)
    o = _probabilities(m, states)
    o[y, :, np.arange(n)] -= 1
    o *= mask[None] / max(1, mask.sum())
    both = np.concatenate([states[0], states[1][::-1]], 1)  # T, 2H, N
    g = {"table": np.zeros_like(m.table), "u": np.zeros_like(m.u), "b": np.zeros_like(m.b), "bias": o.sum((1, 2))}
    g["out"] = np.tensordot(o, both, ((1, 2), (0, 2)))
    back = np.tensordot(m.out, o, (0, 0))  # 2H, T, N
    for d in (0, 1):
        dh = np.zeros((hid, n), np.float32)
        deep = []
        for s in range(t - 1, -1, -1):
            h, zr, inner, c = saved[d * t + s]
            z, r = zr[:hid], zr[hid:]
            dh = dh + back[d * hid : (d + 1) * hid, s if d == 0 else t - 1 - s]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * inner * r * (1 - r)
            di = dc * r
            g["b"][d] += di.sum(1)
            g["u"][d] += np.concatenate([dz, dr, di]) @ h.T
            deep.append(np.concatenate([dz, dr, dc]))
            dh = dh * z + m.u[d].T @ np.concatenate([dz, dr, di])
        # what each byte's column of the table gets: positions sorted by byte
        cols = np.concatenate(deep, 1)
        bytes_ = np.concatenate([x[s] if d == 0 else x[t - 1 - s] for s in range(t - 1, -1, -1)])
        order = np.argsort(bytes_, kind="stable")
        ids, begin = np.unique(bytes_[order], return_index=True)
        g["table"][d][:, ids] = np.add.reduceat(cols[:, order], begin, 1)
    return g


def windows(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (N, WINDOW), valid length of each window, and the text of each window."""
    n = np.diff(at)
    per = -(-n // WINDOW)
    text = np.repeat(np.arange(len(n)), per)
    k = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    start = at[:-1][text] + k * WINDOW
    size = np.minimum(at[1:][text] - start, WINDOW)
    padded = np.r_[raw, np.zeros(WINDOW, np.uint8)]
    x = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[start] if len(start) else np.zeros((0, WINDOW), np.uint8)
    return x, size, text


def pooled(m: Model, texts: pa.Array, block: int = 2048) -> np.ndarray:
    """Mean probabilities (texts, languages) over all positions; 0 for texts without bytes."""
    raw, at = batch_bytes(texts)
    x, size, text = windows(raw, at)
    out = np.zeros((len(at) - 1, len(m.langs)))
    for i in range(0, len(x), block):
        part, n = x[i : i + block], size[i : i + block]
        valid = np.arange(WINDOW) < n[:, None]  # behind a text's end stand zeros, as in training
        prob = _probabilities(m, _forward(m, np.ascontiguousarray(np.where(valid, part, 0).T)))
        prob *= valid.T[None]
        np.add.at(out, text[i : i + block], prob.sum(1).T)
    return out / np.maximum(np.diff(at), 1)[:, None]


def sample(docs: DataFrame, text: str, lang: str, row_id: str, per_lang: int) -> list:
    """About per_lang labelled rows of each language, those with the smallest hashes of ids and texts: at most 2 * per_lang * languages rows."""
    crc = F.crc32(F.coalesce(F.col(row_id).cast("string"), F.lit("")).cast("binary"))
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.pmod(crc, F.lit(4)) != 2)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(row_id).cast("string"), F.col(text)).alias("h"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return []
    odds = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, 1.5 * per_lang / n))])
    drawn = known.where((F.col("h") / float(1 << 63) + 1) / 2 <= F.element_at(odds, F.col("lang")))
    return drawn.orderBy("h", "lang", "text").limit(2 * per_lang * len(counts)).collect()


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", row_id: str = "doc_id", per_lang: int = 250, per_text: int = 8, **how) -> Model | None:
    """Learns from at most 2 * per_lang rows a language (the documented bound) and per_text windows of each."""
    rows = sample(docs, text, lang, row_id, per_lang)
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    xs, sizes, ys = [], [], []
    for r in rows:
        raw = np.frombuffer(r["text"].encode(), np.uint8)
        x, size, _ = windows(raw, np.array([0, len(raw)]))
        pick = np.unique(np.linspace(0, len(x) - 1, min(per_text, len(x))).astype(int)) if len(x) else []
        for k in pick:
            xs.append(np.where(np.arange(WINDOW) < size[k], x[k], 0))
            sizes.append(size[k])
            ys.append(langs.index(r["lang"]))
    if not xs:
        return None
    mask = (np.arange(WINDOW) < np.array(sizes)[:, None]).astype(np.float32)
    return train(np.array(xs, np.uint8), mask, np.array(ys), langs, **how)


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All rows and columns of docs with __lang_pred and __score (0 to 1).

    ``und`` with score 0 where the text is null or has no letter, or nothing could be
    learned.  Texts are read whole.  Equal texts get equal results.  Columns of docs
    with the added names are replaced.
    """
    docs = docs.drop("__lang_pred", "__score")
    at = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField("__lang_pred", StringType()), StructField("__score", DoubleType())])

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch_bytes(batch.column(at))[1])
            for i, j in slices(sizes, 1 << 18):
                part = batch.slice(i, j - i)
                col = part.column(at)
                known = np.array(pc.match_substring_regex(col.fill_null(""), r"\p{L}").to_pylist(), bool)
                if model is None:
                    known[:] = False
                p = np.zeros((len(part), 1)) if model is None else pooled(model, col)
                best = p.argmax(1)
                names = [(model.langs[b] if k else UNKNOWN) for b, k in zip(best, known, strict=True)]
                score = np.where(known, np.clip(p.max(1).round(6), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score)], names=[*batch.schema.names, "__lang_pred", "__score"])

    return docs.mapInArrow(lean(run), schema)
