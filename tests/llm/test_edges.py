"""Very long texts, hot rows, nulls, empty tables and clashing names; and what only whole tables show."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from larkspur.llm import chat, contamination, jaccard, language_id, queries, repeats, sharding, substrings
from larkspur.llm._store import table

SF = "/root/testdata/sf0.01"


def test_language_of_documents_held_out(spark):
    out = queries.op10_bigru_language(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    got = out.where("held_out and lang is not null and lang_pred <> 'und'").agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()
    assert got[0] > 150 and got[1] >= 0.97


def test_language_edges(spark):
    words = {"aa": "la lo lu ", "bb": "kri kra kru "}
    rows = [(None, words[k] * (2 + i % 5), k) for k in words for i in range(60)] + [(1, "la lo lu " * 60_000, None), (2, None, "aa"), (3, "12 - 3", "bb"), (4, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("__score", F.lit("old")).withColumn("text2", F.col("text"))
    model = language_id.fit(df, steps=60)
    out = language_id.identify(df, model)
    got = {r["doc_id"]: (r["__lang_pred"], r["__score"]) for r in out.where("doc_id is not null").collect()}
    assert got[1][0] == "aa" and 0 < got[1][1] <= 1 and got[2] == got[3] == got[4] == ("und", 0.0)
    assert out.columns == ["doc_id", "text", "lang", "text2", "__lang_pred", "__score"]
    # rows without ids are drawn by their texts
    assert model.langs == ["aa", "bb"]
    assert language_id.fit(df.limit(0)) is None and language_id.identify(df.limit(0), model).collect() == []
    assert {r["__lang_pred"] for r in language_id.identify(df, None).collect()} == {"und"}


def test_repeats_that_only_the_method_rejects(spark):
    rng = random.Random(3)
    some = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    one, big = some(70), some(55)
    texts = {
        "clean": some(300), "longest": some(300) + one + some(200) + one, "covered": some(200) + big + some(2) + big,
        "base": some(20) + one[:40] + some(3) + one[:40], "little": some(49),
    }
    rows = [(k, " ".join(v)) for k, v in texts.items()]
    got = {r["doc_id"]: r for r in repeats.repetition(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert {k: (r["__base_failed"], r["__kept"]) for k, r in got.items()} == {"clean": (False, True), "longest": (False, False), "covered": (False, False), "base": (True, False), "little": (True, False)}
    assert got["longest"]["__longest"] == 70 and got["covered"]["__longest"] == 55 and got["clean"]["__covered"] == 0


def test_very_long_texts(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    near = [*base[:30_000], "edit", *base[30_000:]]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base[40_000:40_060])), (4, " ".join(reversed(base)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in jaccard.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    gone = {r["id"]: (r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(df).collect()}
    assert gone == {1: (60_000, 60_000), 2: (60_001, 60_000), 3: (60, 60), 4: (60_000, 0)}
    bench = spark.createDataFrame([("q", " ".join(base[59_980:59_995]))], "item_id string, text string")
    hit = {r["id"]: r["n_hit"] for r in contamination.contamination(df, bench).collect()}
    assert hit == {1: 15, 2: 15, 3: 0, 4: 0}


def test_long_conversation(spark):
    n = 6000
    df = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 3 = 0, 'user', 'assistant') AS role", "'<|end|>é' || id AS text")
    out = chat.format_chats(df).withColumn("t", chat.read_turns(F.col("formatted"))).withColumn("learnt", chat.learnt_text(F.col("formatted"), F.col("loss"))).first()
    texts = [("assistant" if i % 3 else "user", f"<|end|>é{i}") for i in range(n)]
    assert [tuple(x) for x in out["t"]] == texts and out["learnt"] == "".join(t for r, t in texts if r == "assistant")
    assert out["n_blocks"] == n // 3 * 2


def test_splitters_against_brute_force(spark):
    """Without groups larger than the tolerance, shards are ranges of the hash whose bytes are exact to the tolerance."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("é"), F.col("id").cast("string")), (F.col("id") % 40 + 1).cast("int")).alias("text"))
    out = sharding.shard(df, shards=7, tolerance=0.02).select(F.xxhash64("text").alias("h"), (F.octet_length("text") + 1).alias("size"), "shard")
    rows = sorted((r["h"], r["size"], r["shard"]) for r in out.collect())
    share, below, at = sum(r[1] for r in rows) / 7, 0, []
    assert [r[2] for r in rows] == sorted(r[2] for r in rows)
    for i, r in enumerate(rows):
        if i and r[2] != rows[i - 1][2]:
            at.append(below)
        below += r[1]
    assert len(at) == 6 and all(abs(b - (i + 1) * share) <= share * 0.02 for i, b in enumerate(at))


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    long = " ".join(f"w{i * i % 977}" for i in range(30_000))
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twenty-one twenty-two twenty-three twenty-four twenty-five"
    return [
        (1, near, "en", "s", 1), (1, near, "en", "s", 1), (1, near + " six", "en", "s", 1), (None, near + " seven", None, None, None), (2, long, "en", "s", 1), (3, None, None, None, None),
        (4, "", "en", None, 0), (None, None, None, None, None), (5, "another text that is alone", "en", "t", 3), (5, "and one more with the same id", "en", "t", 3), (None, "far away from all of the others", "en", "", 2),
    ]


@pytest.mark.parametrize("name,f", P.STAGES)
def test_stage_edges(spark, name, f):
    """Nulls, repeated rows and ids, a very long text, columns with clashing names, and no rows."""
    df = spark.createDataFrame(odd_rows(), COLUMNS)
    for c in ("k1", "comp", "sha", "m", "__size", "s", "shard", "id"):
        df = df.withColumn(c, F.lit("clash"))
    out = f(spark, df, SF)
    got = out.collect()
    assert out.columns == (P.COLUMNS if name != "sharding" else [*P.COLUMNS, "shard", "slot"])
    assert f(spark, df.limit(0), SF).collect() == []
    ids = sorted((r["doc_id"] or -1) for r in got)
    if name == "sharding":
        assert len(got) == len(odd_rows())
    if name == "decontamination":
        assert len(got) == len(odd_rows())
    if name == "ngram_jaccard":  # the rows of one component become one, texts without words stay
        assert ids == [-1, -1, 1, 2, 3, 4, 5, 5]
    if name == "mixing":
        assert all(r["text"] is None or isinstance(r["text"], str) for r in got) and 2 in ids


def test_near_copies_without_ids(spark):
    """Of near copies whose ids are all null, or all the same, one stays."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text + " more"), (None, "other " + text), (8, "x " + " ".join(f"v{i}" for i in range(60))), (8, "y " + " ".join(f"v{i}" for i in range(60)))]
    df = spark.createDataFrame([(a, b, "en", "s", 1) for a, b in rows], COLUMNS)
    got = P.drop_near_duplicates(spark, df, SF).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["8", "None"]
    again = P.drop_near_duplicates(spark, df.repartition(3), SF).collect()
    digest = lambda rs: sorted(hashlib.sha256(r["text"].encode()).hexdigest() for r in rs)
    assert digest(got) == digest(again)
