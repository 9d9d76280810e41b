"""The stages of the pipeline, on a small table with planted cases."""

import duckdb
import pytest

import corpus_pipeline as P
from larkspur.llm import queries as Q
from larkspur.llm._store import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    df = Q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(Q.oracle_sql()[name]).select(*cols).fetchall()
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(want, key=repr)


def test_stages(spark):
    docs = table(spark, SF, "documents")
    seen = {None: docs.count()}
    for name, f in P.STAGES[:-1]:
        docs = P.stage(f(spark, docs, SF), name)
        assert docs.columns == P.COLUMNS
        seen[name] = docs.count()
        if name == "language_id":
            assert seen[name] >= 0.97 * seen[None]
        if name == "ngram_jaccard":
            left = Q.jaccard.near_duplicates(docs)
            assert left.select("component_id").distinct().count() == left.count()
        if name == "decontamination":
            hits = Q.contamination.contamination(docs, table(spark, SF, "benchmark"))
            assert hits.where("n_hit > 0 and 20 * n_hit >= n_words").count() == 0
    out = P.run(spark, SF)
    assert out.columns == [*P.COLUMNS, "shard", "slot"] and out.count() == seen["mixing"]


def test_repeated_rows_and_nulls(spark):
    rows = [(1, "one two three four five six", "en", "s", 1)] * 3 + [(2, "one two three four five six", None, None, None), (None, "other words of a null id here", "en", "s", 1), (5, None, "en", "s", 0), (6, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in P.drop_near_duplicates(spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, rows[0][1]), (None, rows[4][1]), (5, None), (6, "")], key=str)
    assert P.shard(spark, P.mix_sources(spark, P.drop_contaminated(spark, docs.limit(0), SF), SF), SF).collect() == []


def test_no_language_learned(spark):
    rows = [(1, "clean words", None, "s", 11), (2, "12 34", None, "s", 5), (3, None, None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in P.identify_language(spark, docs, SF).collect()] == [1]
