"""Which hashed values stand in more than one place, over a whole corpus.

Rows of one value each would cost several times their size in a shuffle.  Here a
task packs the values of some thousand texts into one binary per bucket of the
values' upper bits; a bucket's task sorts what it gets and answers with the places of
values that stand in several.  A value that a task already sees twice is known to
repeat: its places are answered at once and one entry of it is sent, so a value that
a third of all texts share sends one entry a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._words import give_back, lean

SENT = "bucket int, known boolean, vals binary, keys binary, which binary, at binary, owners binary"
#: Entries that a task packs at once.
CHUNK = 150_000


def pack(chunks: Iterator[tuple], buckets: int) -> Iterator[pa.RecordBatch]:
    """chunks: (value, key, place) arrays of any size, or (value, key, place, owner); packed CHUNK entries at a time."""
    held: list = []
    n = 0
    for c in chunks:
        held.append(c)
        n += len(c[0])
        if n >= CHUNK:
            yield _packed(held, buckets)
            held, n = [], 0
    if n:
        yield _packed(held, buckets)


def _packed(held: list, buckets: int) -> pa.RecordBatch:
    val, key, at = (np.concatenate([h[i] for h in held]) for i in range(3))
    owner = np.concatenate([h[3] for h in held]) if len(held[0]) > 3 else None
    order = np.lexsort((at, key, val))
    val, key, at = val[order], key[order], at[order]
    new = np.r_[True, (val[1:] != val[:-1]) | (key[1:] != key[:-1]) | (at[1:] != at[:-1])]
    val, key, at = val[new], key[new], at[new]
    owner = owner[order][new] if owner is not None else None
    first, several = _several(val, owner)
    # what is known here goes back by key, spread over the buckets like all else
    place = (key[several] % np.uint64(buckets)).astype(np.int64)
    rows = _rows(place, True, None, key[several], at[several] + np.uint32(1))
    sent = ~several | first
    bucket = ((val[sent] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    # of a value known to repeat one entry is sent, twice over, with no place to answer to
    at_sent = np.where(several[sent], 0, at[sent] + np.uint32(1))
    rows += _rows(bucket, False, val[sent], key[sent], at_sent, owner[sent] if owner is not None else None)
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
    kinds = (pa.int32(), pa.bool_(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "known", "vals", "keys", "which", "at", "owners"])


def _several(val: np.ndarray, owner: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """For sorted values: the first entry of each, and those of values that several entries (or owners) have."""
    first = np.r_[True, val[1:] != val[:-1]]
    group = np.cumsum(first) - 1
    if owner is None:
        return first, np.bincount(group)[group] > 1
    begin = np.flatnonzero(first)
    return first, (np.minimum.reduceat(owner, begin) != np.maximum.reduceat(owner, begin))[group]


def _short(x: np.ndarray) -> bytes:
    """Two bytes a number where these do."""
    return x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32).tobytes()


def _long(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, np.uint16 if len(b) == 2 * n else np.uint32).astype(np.uint32)


def _rows(bucket: np.ndarray, known: bool, val, key: np.ndarray, at: np.ndarray, owner=None) -> list:
    order = np.argsort(bucket, kind="stable")
    b, k, a = bucket[order], key[order], at[order]
    v = val[order] if val is not None else None
    cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else []
    ends = np.r_[cut[1:], len(b)] if len(b) else []
    out = []
    for i, j in zip(cut, ends, strict=True):
        keys, at_key, which = np.unique(k[i:j], return_index=True, return_inverse=True)
        owners = owner[order[i:j][at_key]].tobytes() if owner is not None else b""
        out.append((int(b[i]), known, v[i:j].tobytes() if v is not None else b"", keys.tobytes(), _short(which), _short(a[i:j]), owners))
    return out


def _unpacked(table: pa.Table) -> list:
    """known, values, keys, places (from 1; 0: of no one) and owners (of a key that is its own: the key) of each row."""
    out = []
    for known, vals, keys, which, at, owners in zip(*(table.column(c).to_pylist() for c in ("known", "vals", "keys", "which", "at", "owners")), strict=True):
        keys = np.frombuffer(keys, np.uint64)
        n = len(which) // (2 if len(keys) <= 1 << 16 else 4)
        which = _long(which, n)
        mine = np.frombuffer(owners, np.uint64) if owners else keys
        out.append((known, np.frombuffer(vals, np.uint64), keys[which], _long(at, n), mine[which], bool(owners)))
    return out


def answer(table: pa.Table, groups: int) -> pa.Table:
    """Packed keys and places of a bucket's repeated values, a row for each group of keys."""
    keys, ats = [], []
    rows = _unpacked(table)
    pick = [r[1:] for r in rows if not r[0]]
    if pick:
        val, key, at, owner = (np.concatenate([p[i] for p in pick]) for i in range(4))
        owned = any(p[4] for p in pick)
        order = np.lexsort((at, key, val))
        val, key, at, owner = val[order], key[order], at[order], owner[order]
        first = np.r_[True, val[1:] != val[:-1]]
        new = first | np.r_[True, (key[1:] != key[:-1]) | (at[1:] != at[:-1])]
        group = np.cumsum(first) - 1
        twice = np.bincount(group, weights=at == 0)[group] > 0
        twice |= _several(val, owner)[1] if owned else np.bincount(group, weights=new)[group] > 1
        ok = twice & new & (at > 0)
        keys.append(key[ok])
        ats.append(at[ok] - np.uint32(1))
    for known, _, k, a, _, _ in rows:
        if known:
            keys.append(k)
            ats.append(a - np.uint32(1))
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    at = np.concatenate(ats) if ats else np.zeros(0, np.uint32)
    rows = _rows((key % np.uint64(groups)).astype(np.int64), True, None, key, at)
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
    return pa.table({n: pa.array(list(cols[i]), k) for n, i, k in (("group", 0, pa.int32()), ("keys", 3, pa.binary()), ("which", 4, pa.binary()), ("at", 5, pa.binary()))})


def gather(table: pa.Table) -> pa.Table:
    """key and at (packed uint32 places, sorted and distinct) of each key of a group."""
    keys, ats = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for k, which, at in zip(*(table.column(c).to_pylist() for c in ("keys", "which", "at")), strict=True):
        k = np.frombuffer(k, np.uint64)
        n = len(which) // (2 if len(k) <= 1 << 16 else 4)
        keys.append(k[_long(which, n)])
        ats.append(_long(at, n))
    key, at = np.concatenate(keys), np.concatenate(ats)
    order = np.lexsort((at, key))
    key, at = key[order], at[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (at[1:] != at[:-1])] if len(key) else np.zeros(0, bool)
    key, at = key[new], at[new]
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    offsets = np.r_[cut, len(key)].astype(np.int32) * 4
    blob = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(at.tobytes())])
    return pa.table({"key": pa.array(key[cut].view(np.int64)), "at": blob})


def repeated(rows: DataFrame, entries: Callable[[pa.RecordBatch], Iterator[tuple]], buckets: int) -> DataFrame:
    """key (long) and at (packed uint32 places): where the values of entries(batch) repeat; a row for each key that has such.

    A value repeats if it has two places; where entries name owners, if two owners have it.
    """

    def run(batches):
        yield from pack((e for b in batches for e in entries(b)), buckets)

    sent = rows.mapInArrow(lean(run), SENT)
    def answered(t: pa.Table) -> pa.Table:
        out = answer(t, buckets)
        give_back()
        return out

    found = sent.groupBy("bucket").applyInArrow(answered, "group int, keys binary, which binary, at binary")
    return found.groupBy("group").applyInArrow(gather, "key long, at binary")


def places(blob: bytes | None) -> np.ndarray:
    """The places of a row of repeated()."""
    return np.frombuffer(blob, np.uint32).astype(np.int64) if blob else np.zeros(0, np.int64)
