"""Chat formatting, license scans, sharding and mixing on small tables."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from larkspur.llm import chat, licenses, mixing, sharding

SAID = "</s>[INST] ok [/INST]"


def chats(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df.withColumn("formatted", F.lit(1)).withColumn("t", F.lit("x")))
    return {r["conv_id"]: r for r in out.withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("learnt", chat.learnt_text(F.col("formatted"), F.col("loss"))).collect()}


def test_chat_round_trip(spark):
    odd = ["", "a\\b", "\\", "\\\\n", "<|turn|>", "<|turn|", "|>", SAID, "<<SYS>>x<</SYS>>", "[\\INST]", "<|part|><|end|>\n", "é\n\n", "<\\/s>", "[INST", "$1 \\$ ^"]
    rows = []
    for c, t in enumerate(odd):
        rows += [(c, 0, "user", t), (c, 1, "assistant", t + t), (c, 2, "assistant", t), (c, 3, "user", None)]
    rows += [(None, 2, None, "z"), (None, 1, "a\nb\\n", "y"), (None, 1, "a\nb\\n", "y")]
    got = chats(spark, rows)
    for c, t in enumerate(odd):
        assert [tuple(x) for x in got[c]["back"]] == [("user", t), ("assistant", t + t), ("assistant", t), ("user", "")]
        assert got[c]["learnt"] == t + t + t and got[c]["n_blocks"] == 3
        whole = got[c]["formatted"]
        assert whole.count("<|turn|>") == 3 and "[INST]" not in whole and "</s>" not in whole
        spans = [whole[s["start"] : s["start"] + s["length"]] for s in got[c]["loss"]]
        assert len(spans) == 2
    assert [tuple(x) for x in got[None]["back"]] == [("a\nb\\n", "y"), ("a\nb\\n", "y"), ("", "z")]
    assert chats(spark, []) == {}


def test_license_scan(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    rows = [("/a/LICENSE", f"Header. {gpl} " + "word " * 90), ("/a/b/x.py", "nothing here"), ("/a/b/c/y.py", f"code code\n{mit}\nmore"), ("/a/b/c/d.txt", mit), ("/a/b/c/e/z.py", ""), ("/q/none.py", None), (None, "x"), ("/a/b/x.py", "nothing here"), ("/q/long.py", "the license " * 4000)]
    df = spark.createDataFrame(rows, "path string, text string").withColumn("license", F.lit("old"))
    got = sorted(((r["path"], r["license"], r["license_how"], r["license_dir"]) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted([("/a/LICENSE", "GPL-3.0", "own", None), ("/a/b/x.py", "GPL-3.0", "inherited", "/a"), ("/a/b/x.py", "GPL-3.0", "inherited", "/a"), ("/a/b/c/y.py", "MIT", "own", None), ("/a/b/c/d.txt", "MIT", "own", None), ("/a/b/c/e/z.py", "MIT", "inherited", "/a/b/c"), ("/q/none.py", None, "none", None), (None, None, "none", None), ("/q/long.py", None, "none", None)], key=str)
    assert licenses.scan(df.limit(0)).collect() == []
    plan = licenses.scan(spark.range(1).select(F.lit("p").alias("path"), F.lit("x").alias("text")))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "Python" not in plan and "Arrow" not in plan


def test_license_texts_and_headers(spark):
    texts = dict(licenses.license_texts())
    rows = [(n, f"/{n}/LICENSE", f"Copyright 2020 Ada Example\n\n{x}") for n, x in texts.items()]
    rows.append(("BSD-2-Clause", "/src/a.c", "/* " + texts["BSD-2-Clause"].replace("\n", "\n * ") + " */\n" + "int a; foo bar();\n" * 200))
    apache = "# Licensed under the Apache License, Version 2.0 (the \"License\");\r\n# you may not use this file except in compliance with the License.\r\n# You may obtain a copy of the License at\r\n#\r\n#  http://www.apache.org/licenses/LICENSE-2.0\r\nimport os"
    agpl = "/*\n * Foo is free software: you can redistribute it and/or modify it under\n * the terms of the GNU Affero General Public License as published by the Free\n * Software Foundation, either version 3 of the License, or (at your option)\n * any later version.\n */\nint x;"
    rows += [("Apache-2.0", "/src/b.py", apache), ("AGPL-3.0", "/src/c.c", agpl), ("GPL-2.0", "/src/d.c", "// Copyright Foo\n// SPDX-License-Identifier: GPL-2.0-or-later\n#include <x>"), ("MIT", "/MIT/src/e.c", "int y;")]
    got = {r["path"]: (r["want"], r["license"], r["license_how"]) for r in licenses.scan(spark.createDataFrame(rows, "want string, path string, text string")).collect()}
    assert got == {p: (n, n, "inherited" if p == "/MIT/src/e.c" else "own") for n, p, _ in rows}


def shard_rows(n):
    rows = [(i, "x" * (i * 7919 % 900) + str(i), "c") for i in range(n)]
    rows += [(10_000 + i, "copy " * 40, "c") for i in range(n // 3)] + [(None, None, "c"), (5, "", "c"), (5, "", "c"), (77_777, "y" * 60_000, "c")]
    return rows


def test_sharding(spark):
    rows = shard_rows(1500)
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.shard(df, shards=8).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((a, b) for a, b, _ in rows)
    sizes, slots, places = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        sizes[r["shard"]] += len((r["text"] or "").encode()) + 1
        slots[r["shard"]].append(r["slot"])
        places[r["text"] or ""].add(r["shard"])
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # equal texts stay together, but for the group that no shard has room for
    assert all(len(p) == 1 for t, p in places.items() if not t.startswith("copy"))


def test_sharding_of_little(spark):
    for rows in ([], [(1, "a")], [(1, None), (2, None)]):
        got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == len(rows) and all(0 <= r["shard"] < 16 for r in got)
    with pytest.raises(ValueError):
        sharding.shard(spark.createDataFrame([], "doc_id long, text string"), shards=0)


def test_sharding_one_key_is_a_third(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, F.lit("hot " * 20)).otherwise(F.concat(F.lit("t" * 60), F.col("id"))).alias("text"))
    sizes = [r["b"] for r in sharding.shard(df).groupBy("shard").agg(F.sum(F.length("text") + 1).alias("b")).collect()]
    assert len(sizes) == 16 and max(sizes) < 1.03 * min(sizes)


def test_targets():
    t = mixing.targets({"a": 100, "b": 1000, "c": 10, "d": 0}, {"a": 3, "b": 1, "c": 2, "d": 3})
    assert t["a"] == 200 and t["c"] == 20 and t["d"] == 0 and abs(sum(t.values()) - 1.5 * 1110) < 1e-6
    assert mixing.targets({}, {}) == {}


def test_tree_keeps_quotas():
    import numpy as np

    q = np.array([5, 0, 1000, 77])
    m = mixing.quotas_by_shard(q, 16, 3)
    assert (m.sum(1) == q).all() and m.sum(0).max() - m.sum(0).min() <= 1 and (m >= 0).all()
    assert (m == mixing.quotas_by_shard(q, 16, 3)).all() and not (m == mixing.quotas_by_shard(q, 16, 4)).all()


def test_mixing(spark):
    rows = [(i, "w " * (1 + i * 37 % 60), f"s{i % 4}") for i in range(600)] + [(9000 + i, "n n n", None) for i in range(20)] + [(1, None, "s0"), (2, "", "s1"), (3, "dup dup", "s2"), (3, "dup dup", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("__size", F.lit("clash"))
    p = mixing.plan(df)
    got = p.collect()
    assert len(got) == len(rows)
    taken, goal = defaultdict(int), {}
    for r in got:
        assert 0 <= r["__copies"] <= 2 and len(r["__shards"] or []) == r["__copies"]
        taken[r["source"]] += r["__copies"] * r["__size"]
        goal[r["source"]] = r["__target"]
    assert all(abs(taken[s] - goal[s]) <= 0.02 * goal[s] + 3 for s in goal)
    assert Counter((r["doc_id"], r["__copies"]) for r in got) == Counter((r["doc_id"], r["__copies"]) for r in mixing.plan(df.repartition(7)).collect())
    mixed = mixing.mix(df)
    assert mixed.count() == sum(r["__copies"] for r in got) and mixed.columns == ["doc_id", "text", "source"]
    assert mixing.plan(df.limit(0)).collect() == []


def test_mixing_of_equal_rows(spark):
    """A third of all rows are one row: a part of them is taken, and of each source the quota to the word."""
    rows = [(7, "w " * 10, "hot")] * 3000 + [(i, "v " * 5, "b") for i in range(1000)] + [(None, "u " * 20_000, "c"), (None, None, "c"), (1, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {"b": 5000, "c": 20_000, "hot": 30_000, None: 0}
    want = mixing.targets(sizes, dict(zip(sizes, (3, 1, 2, 3), strict=True)))
    for part in (df, df.repartition(9)):
        got = mixing.plan(part).groupBy("source").agg(F.sum(F.col("__size") * F.col("__copies")).alias("t"), F.first("__target").alias("g"), F.count("*").alias("n")).collect()
        assert {r["source"]: r["g"] for r in got} == pytest.approx(want) and sum(r["n"] for r in got) == len(rows)
        taken = {r["source"]: r["t"] for r in got}
        assert abs(taken["hot"] - want["hot"]) <= 10 and abs(taken["b"] - want["b"]) <= 5 and abs(taken["c"] - want["c"]) <= 20_000
    assert mixing.mix(df).where("source = 'hot'").count() == taken["hot"] // 10


def test_mixing_of_many_sources(spark):
    """Targets in rounds equal those of plain Python, and draws follow the tree."""
    rows = [(i, "w " * (1 + i * i % 211), f"s{i * i % 97:03d}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan(df, shards=5, blocks=8).collect()
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["__size"]
        taken[r["source"]] += r["__size"] * r["__copies"]
    order = sorted(sizes)
    want = mixing.targets({s: sizes[s] for s in order}, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    most = {s: max(r["__size"] for r in got if r["source"] == s) for s in order}
    assert {r["source"]: r["__target"] for r in got} == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) <= most[s] for s in order)
    assert all(r["__copies"] <= 2 and set(r["__shards"]) <= set(range(5)) for r in got)


def test_tree_inside_groups():
    import numpy as np

    q = np.array([5, 9, 1000, 77])
    m = mixing.quotas_by_shard(q, np.array([500, 91, 500]), 3)
    assert (m.sum(1) == q).all() and (m.sum(0) == [500, 91, 500]).all() and (m >= 0).all()


def test_digest_of_chat_matches_rows(spark):
    got = chats(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "a")])[1]
    told = "".join(f"{x['role']}\n{x['text']}\n" for x in got["back"])
    assert hashlib.sha256(told.encode()).hexdigest() == hashlib.sha256(b"user\nq\nassistant\na\n").hexdigest()
