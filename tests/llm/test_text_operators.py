"""Repetition, contamination, substring dedup, near duplicates, archives and language against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import archives, contamination, jaccard, language_id, repeats, substrings
from larkspur.llm._words import LOWERED, SPACED, word_hashes, words_of

SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ODD = [None, "", "a", " \n\n ", "a b c a b c", "x\ny\nx\n x\nx", "é ü x y", "A-b_C9 \x00z\x7f", "word " * 30_000]


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("inside,fold,rule", [(SPACED, False, SPACE), (LOWERED, True, ALNUM)])
def test_words(inside, fold, rule):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("aB é\n\t9-_.中") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    w = words_of(pa.array(texts, pa.string()), inside, fold)
    raw, h, at = w.raw.tobytes(), word_hashes(w), 0
    seen = {}
    for t in texts:
        want = re.findall(rule, low(t) if fold else t or "")
        n = len(want)
        assert [raw[s:e].decode() for s, e in zip(w.start[at : at + n], w.end[at : at + n], strict=True)] == want
        for x, y in zip(want, h[at : at + n], strict=True):
            assert seen.setdefault(x, y) == y
        at += n
    assert at == len(w.start) and len(set(seen.values())) == len(seen)


def longest_repeats(ws):
    n = len(ws)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and ws[i + k] == ws[j + k]:
                k += 1
            best[i] = max(best[i], k)
    return best


def covered(best, least):
    mark = [0] * len(best)
    for i, b in enumerate(best):
        if b >= least:
            mark[i : i + b] = [1] * b
    return sum(mark)


def test_repetition_measures():
    rng = random.Random(1)
    texts = ODD[:-1] + ["".join(rng.choice(["a ", "b ", "é\n", "c", "# ", "d\t", "ab ", "\n", "a b c d "]) for _ in range(rng.randint(0, 70))) for _ in range(150)]
    m = repeats.measure(pa.array(texts, pa.string()), 4)
    for i, t in enumerate(texts):
        ws = re.findall(SPACE, t or "")
        best = longest_repeats(ws)
        lines = [x for x in (t or "").split("\n") if re.search(SPACE, x)]
        windows = Counter(tuple(ws[k : k + 3]) for k in range(len(ws) - 2))
        mark = [0] * len(ws)
        for k in range(len(ws) - 2):
            if windows[tuple(ws[k : k + 3])] > 1:
                mark[k : k + 3] = [1, 1, 1]
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), sum(mark), covered(best, 4), max(best, default=0))
        assert tuple(int(m[f"__{k}"][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered", "longest")) == want, repr(t)


def test_repetition_verdicts(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    clean = " ".join(rng.sample(words, 300))
    part = rng.sample(words, 80)
    rows = [(1, clean), (2, "short"), (3, "same words " * 60), (4, " ".join(rng.sample(words, 200) + part + rng.sample(words, 200) + part)), (5, None), (6, clean)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__kept", F.lit("clash"))
    got = {r["doc_id"]: (r["__base_failed"], r["__kept"]) for r in repeats.repetition(df).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False), 4: (False, False), 5: (True, False), 6: (False, True)}
    assert repeats.repetition(df.limit(0)).collect() == []


def contaminated(rows, items):
    find = lambda t: re.findall(ALNUM, low(t))
    windows = {}
    for i, t in items:
        w = find(t)
        m = min(13, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add(i or "")
    out = []
    for d, t in rows:
        w, got = find(t), set()
        hit = [0] * len(w)
        for m in {len(k) for k in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    got |= windows[tuple(w[k : k + m])]
                    hit[k : k + m] = [1] * m
        out.append((d, len(w), sum(hit), sorted(got)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [contamination.BLOCK_BYTES, 300])
def test_contamination(spark, monkeypatch, block):
    monkeypatch.setattr(contamination.blocks, "__defaults__", (block,))
    rng = random.Random(3)
    words = [f"t{i}" for i in range(60)]
    items = [(str(i), " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([0, 1, 2, 5, 13, 14, 30, 30])] + [("8", None), (None, "q r s"), ("9", "Q-R s")]
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "t1 q r s")]
    for i in range(100, 160):
        t = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            p = rng.choice(items)[1] or ""
            t += p.upper().split()[rng.randint(0, 3) :] + [rng.choice(words) for _ in range(5)]
        rows.append((i, rng.choice([" ", "--", "\n"]).join(t)))
    rows.append(rows[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit(1))
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = sorted(((r["id"], r["n_words"], r["n_hit"], r["items"]) for r in contamination.contamination(docs, bench).collect()), key=str)
    assert got == contaminated(rows, items)
    assert contamination.contamination(docs.limit(0), bench).collect() == []
    assert all(r["n_hit"] == 0 for r in contamination.contamination(docs, bench.limit(0)).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x a y b z c x"), (2, "a b c"), (3, "c q q q q a b")], "doc_id long, text string")
    bench = spark.createDataFrame([("i", "a b c")], "item_id string, text string")
    found = lambda slop: sorted(r["id"] for r in contamination.contamination(docs, bench, slop=slop).collect() if r["n_hit"])
    assert found(0) == [2] and found(2) == [1, 2]


def substring_rows(seed):
    rng = random.Random(seed)
    rnd = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    passages = [rnd(rng.choice([34, 35, 36, 50, 90, 200])) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "a"), (None, "x y"), (3, " ".join(["a", "b"] * 60)), (4, " ".join(["z"] * 100)), (4, " ".join(["z"] * 100))]
    for i in range(5, 90):
        t = []
        for _ in range(rng.randint(1, 5)):
            t += rnd(rng.choice([0, 3, 40]))
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = f"edit{rng.randrange(5)}"
            t += p[rng.randrange(10) if rng.random() < 0.3 else 0 :]
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(t)))
    return [*rows, (200, rows[20][1]), (201, rows[21][1]), (202, rows[21][1] + " tail")]


@pytest.mark.parametrize("seed", [5, 6])
def test_substring_dedup(spark, seed):
    rows = substring_rows(seed)
    words = [re.findall(SPACE, t or "") for _, t in rows]
    n = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = [0] * len(w)
        for k in range(len(w) - 34):
            if n[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [1] * 35
        want.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k1", F.lit("clash"))
    got = [tuple(r) for r in substrings.remove_repeats(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert substrings.remove_repeats(df.limit(0)).collect() == []


def shingles(t):
    w = re.findall(SPACE, low(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("seed,rare,common,turns", [(1, 24, 256, 2), (2, 0, 1000, 0), (3, 2, 6, 0)])
def test_near_duplicates(spark, seed, rare, common, turns):
    rng = random.Random(seed)
    rnd = lambda n: [f"w{rng.randrange(200)}" for _ in range(n)]
    often = rnd(60)
    rows = [(0, None), (1, ""), (2, "a"), (3, "A"), (4, "x y"), (5, "x y z"), (6, "x Y z"), (6, "x Y z"), (None, "x Y z"), (7, "")]
    base = [rnd(rng.choice([3, 6, 20, 60, 150])) + (often if rng.random() < 0.5 else []) for _ in range(15)]
    for i in range(10, 200):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            t[rng.randrange(len(t))] = f"e{rng.randrange(20)}"
        rows.append((i, " ".join(t + (often[: rng.randrange(60)] if rng.random() < 0.2 else []))))
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a = len(sets[i] & sets[j])
            if a and 100 * a >= 80 * (len(sets[i]) + len(sets[j]) - a):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    want = [(d, len(s), least[top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = [(r["id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, rare=rare, common=common, turns=turns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert jaccard.near_duplicates(df.limit(0)).collect() == []


def test_signatures_meet():
    """Any two lists that share ``least`` tokens share a key, whatever is rare."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        df = {t: int(rng.integers(1, 60)) for t in range(1, 41)}
        least = int(rng.integers(2, 9))
        common = 1 + rng.choice(40, least, replace=False)
        a, b = (np.unique(np.r_[common, 1 + rng.choice(40, int(rng.integers(0, 20)), replace=False)]).astype(np.uint64) for _ in range(2))
        found = [jaccard.signatures(x, np.array([df[int(t)] for t in x]), least, 24, 48) for x in (a, b)]
        keys = [set(zip(t1.tolist(), t2.tolist(), strict=True)) for _, t1, t2 in found]
        assert keys[0] & keys[1]


def test_archives(spark, tmp_path):
    big, other = "x" * 150, "é" * 60
    rows = [(3, "http://a/ b\n", big), (1, "http://a/1", big), (2, None, big), (7, "u", ""), (8, "u", ""), (9, "u", None), (10, "http://h/%20", other), (10, "http://h/%20", other), (None, "n", other), (11, "v", "WARC/1.1\r\n\r\n\r\n\r\nfiledesc://x 1\n" * 5), (12, "w", "a\r\n\r\nb" * 40_000), (13, "z", big[:99]), (14, "z", big[:99])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("head", F.lit(1))
    got = sorted(((r["page"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in archives.through_archives(pages).collect()), key=str)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want, first = [], {}
    for i, _, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        n, d = len((t or "").encode()), digest(t)
        again = n >= 100 and d in first
        first.setdefault(d, i)
        want.append((None if i is None else str(i), n, d, "revisit" if again else "response", str(first[d]) if again else None))
    assert got == sorted(want, key=str)
    assert archives.through_archives(pages.limit(0)).collect() == []


def test_arc_versions():
    told = {v: b"%d 0 larkspur\n" % v + " ".join(archives.FIELDS[v]).encode() + b"\n" for v in (1, 2)}
    v1 = b"filedesc://f 0.0.0.0 20200102030405 text/plain %d\n" % len(told[1]) + told[1]
    v2 = b"filedesc://g 0.0.0.0 20200102030405 text/plain 200 - - 0 - %d\n" % len(told[2]) + told[2]
    data = v1 + b"\nhttp://x 1.2.3.4 20200102030405 text/html 6\nab\n\ncd\n" + v2 + b"\nhttp://y 1.2.3.4 20200102030405 text/html 404 - - 0 f 0\n\n"
    got = [(f["URL"], f.get("Result-code"), block) for _, f, block in archives.arc_records(data)]
    assert got == [("http://x", None, b"ab\n\ncd"), ("http://y", "404", b"")]
    with pytest.raises(ValueError):
        list(archives.arc_records(v1 + b"\nhttp://x 1.2.3.4 20200102030405 text/html 500\nab"))
    with pytest.raises(ValueError):
        list(archives.arc_records(v1 + b"\nhttp://x only three 3\nab\n"))


def test_gradients():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (6, 7)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    mask = np.ones((6, 7), np.float32)
    mask[2, 4:] = 0
    p = {"table": (2, 9, 256), "u": (2, 9, 3), "b": (2, 3), "out": (3, 6), "bias": (3,)}
    m = language_id.Model(**{k: rng.normal(0, 0.5, s).astype(np.float64) for k, s in p.items()}, langs=[0, 1, 2])
    g = language_id._gradients(m, x.T, mask.T, y)

    def loss(m):
        o = language_id._probabilities(m, language_id._forward(m, x.T))
        return float(-(np.log(o[y, :, np.arange(6)]) * mask).sum() / mask.sum())

    for k in p:
        at = tuple(rng.integers(0, s) for s in p[k]) if k != "table" else (1, 2, int(x[0, 3]))
        up, down = getattr(m, k).copy(), getattr(m, k).copy()
        up[at] += 1e-2
        down[at] -= 1e-2
        assert abs(g[k][at] - (loss(m._replace(**{k: up})) - loss(m._replace(**{k: down}))) / 2e-2) < 2e-4, k


def test_language_id(spark):
    rng = random.Random(4)
    speak = {"xx": ["alpha", "beta", "gamma", "delta"], "yy": ["öst", "ünd", "ßer", "äch"]}
    rows = [(i, " ".join(rng.choice(speak[g]) for _ in range(rng.randint(5, 80))), g) for i in range(300) for g in [rng.choice(["xx", "yy"])]]
    rows += [(1000, None, "xx"), (1001, "", None), (1002, "123 456 !!", "yy"), (1003, "alpha", None), (1003, "alpha", None), (None, "öst ünd", None), (1004, "alpha beta " * 20_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("__score", F.lit("clash"))
    model = language_id.fit(df, per_lang=60, steps=120)
    got = language_id.identify(df, model).collect()
    pred = {(r["doc_id"], r["text"]): (r["__lang_pred"], r["__score"]) for r in got}
    assert len(got) == len(rows) and all(0 <= r["__score"] <= 1 for r in got)
    assert pred[1000, None] == pred[1001, ""] == pred[1002, "123 456 !!"] == ("und", 0.0)
    assert pred[1003, "alpha"][0] == "xx" and pred[None, "öst ünd"][0] == "yy" and pred[1004, "alpha beta " * 20_000][0] == "xx"
    right = [r["__lang_pred"] == r["lang"] for r in got if r["lang"] and r["text"] and r["doc_id"] < 300]
    assert np.mean(right) > 0.98
    assert {r["__lang_pred"] for r in language_id.identify(df, language_id.fit(df.limit(0))).collect()} == {"und"}
