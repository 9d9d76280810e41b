"""Full-text search against sqlite3's FTS5 (membership and ranks), and its own rules."""

import math
import random
import sqlite3

import pytest

from larkspur import Engine
from larkspur.errors import ConstraintFault, EngineError, MatchFault, Unsupported
from larkspur.fts.index import FtsIndex
from larkspur.fts.porter import stem
from larkspur.fts.query import Node, Phrase, parse

WORDS = "swift swiftly view views viewing table tables the a of data database running runs run café naïve layout Layouts controller x1 x2 12 nation nationalize".split()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    return [(i, text(rng.randint(0, 4)), text(rng.randint(1, 30))) for i in range(1, 61)]


def lite(corpus, tokenize):
    db = sqlite3.connect(":memory:")
    db.execute(f"CREATE VIRTUAL TABLE f USING fts5(title, body, tokenize='{tokenize}')")
    db.executemany("INSERT INTO f(rowid, title, body) VALUES (?,?,?)", corpus)
    return db


def ours(spark, corpus, tokenize, path=None):
    docs = spark.createDataFrame(corpus, "docid long, title string, body string")
    e = Engine(spark)
    e.register_fts(FtsIndex(spark, "f", ["title", "body"], tokenize).build(docs, path))
    return e


QUERIES = ["swift", "view", "swift AND data", "swift data", "swift OR run", "swift NOT data", "(swift OR run) NOT (data OR view)", '"the data"', '"a of the"', "vie*", '"the dat"*', "title:swift", "{title body}:view", "title:(swift OR data) AND body:run", "cafe", "naive OR 12", "layout", "zebra", "swift AND zebra", "body:x1 NOT title:x1"]


@pytest.mark.parametrize("tokenize", ["unicode61", "porter unicode61"])
def test_like_fts5(spark, corpus, tokenize, tmp_path):
    db, e = lite(corpus, tokenize), ours(spark, corpus, tokenize, f"file://{tmp_path}")
    for q in QUERIES:
        want = [r[0] for r in db.execute("SELECT rowid FROM f WHERE f MATCH ? ORDER BY rowid", (q,))]
        assert [r[0] for r in e.prepare("SELECT rowid FROM f WHERE f MATCH ? ORDER BY rowid").all((q,))] == want, q
    for q in ("swift", "swift OR data", "run view", '"the data" OR layout', "vie* OR 12"):
        want = db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ? ORDER BY rank, rowid LIMIT 10", (q,)).fetchall()
        got = e.prepare("SELECT rowid, rank FROM f WHERE f MATCH ? ORDER BY rank, rowid LIMIT 10").all((q,))
        assert [r[0] for r in got] == [r[0] for r in want], q
        assert all(math.isclose(a[1], b[1], rel_tol=1e-9) for a, b in zip(got, want, strict=True)), q
    q = "swift OR data"
    want = db.execute("SELECT rowid, bm25(f, 5.0, 0.5) FROM f WHERE f MATCH ? ORDER BY rowid", (q,)).fetchall()
    got = e.prepare("SELECT rowid, bm25(f, 5.0, 0.5) s FROM f WHERE f MATCH ? ORDER BY rowid").all((q,))
    assert all(a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-9) for a, b in zip(got, want, strict=True))


def test_column_filter_keeps_corpus_frequency(spark):
    """Under a column filter the document frequency counts all columns."""
    e = ours(spark, [(1, "swift", "x"), (2, "y", "swift"), (3, "z", "swift"), *[(i, "q", "r") for i in range(4, 12)]], "unicode61")
    (row,) = e.prepare("SELECT rowid, rank FROM f WHERE f MATCH 'title:swift'").all()
    n, df, mean, length = 11, 3, 2.0, 2
    assert math.isclose(row[1], -math.log((n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / mean)), rel_tol=1e-12)


def test_trigram(spark):
    e = ours(spark, [(1, "Running", ""), (2, "ab", ""), (3, "unRUNable", "")], "trigram")
    assert [r[0] for r in e.prepare("SELECT rowid FROM f WHERE f MATCH 'runn' ORDER BY rowid").all()] == [1]
    assert [r[0] for r in e.prepare("SELECT rowid FROM f WHERE f MATCH 'RUN' ORDER BY rowid").all()] == [1, 3]
    assert e.prepare("SELECT rowid FROM f WHERE f MATCH 'ab'").all() == []


def test_query_language():
    assert parse("a b OR c NOT d") == Node("OR", Node("AND", Phrase("a", False), Phrase("b", False)), Node("NOT", Phrase("c", False), Phrase("d", False)))
    assert parse('t:"x y"*') == Phrase("x y", True, ("t",))
    assert parse("and") == Phrase("and", False) and parse("") is None
    for bad in ("(", "a AND", "OR a", "{a b", "a )", "^"):
        with pytest.raises(MatchFault):
            parse(bad)


def test_faults(spark, corpus):
    e = ours(spark, corpus, "unicode61")
    for q in ("nope:x", "(a"):
        with pytest.raises(MatchFault):
            e.prepare("SELECT rowid FROM f WHERE f MATCH ?").all((q,))
    with pytest.raises(MatchFault):
        e.sql("SELECT rowid FROM f WHERE f MATCH 'a' OR rowid = 1")
    with pytest.raises(MatchFault):
        e.sql("SELECT bm25(f, 1.0) a, bm25(f, 2.0) b FROM f WHERE f MATCH 'a'")
    with pytest.raises(Unsupported):
        FtsIndex(spark, "g", ["a"], "icu")


def test_managed_index(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    e.run("CREATE VIRTUAL TABLE f USING fts5(title, body, tokenize='porter unicode61')")
    e.run("INSERT INTO f(rowid, title, body) VALUES (1, 'Running tests', 'all of them'), (7, 'other', 'the runner runs')")
    e.run("INSERT INTO f(title, body) VALUES ('third', 'run')")
    find = lambda q: [r[0] for r in e.prepare("SELECT rowid FROM f WHERE f MATCH ? ORDER BY rowid").all((q,))]
    assert find("run") == [1, 7, 8]
    with pytest.raises(ConstraintFault):
        e.run("INSERT INTO f(rowid, title) VALUES (7, 'again')")
    e.run("DELETE FROM f WHERE rowid = 7")
    assert find("run") == [1, 8]
    e.run("INSERT INTO f(f, rowid, title, body) VALUES ('delete', 1, 'Running tests', 'all of them')")
    assert find("run") == [8]
    e.run("INSERT INTO f(f) VALUES ('delete-all')")
    assert find("run") == []
    with pytest.raises(Unsupported):
        e.run("INSERT INTO f(f) VALUES ('rebuild')")


def test_triggers_keep_an_index(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    for s in ("CREATE TABLE d (id INTEGER PRIMARY KEY, t TEXT)", "CREATE VIRTUAL TABLE f USING fts5(t)", "CREATE TRIGGER i AFTER INSERT ON d BEGIN INSERT INTO f(rowid, t) VALUES (NEW.id, NEW.t); END", "CREATE TRIGGER x AFTER DELETE ON d BEGIN DELETE FROM f WHERE rowid = OLD.id; END", "INSERT INTO d(t) VALUES ('one two'), ('two three')", "DELETE FROM d WHERE id = 1"):
        e.run(s)
    rows = e.prepare("SELECT d.id, d.t FROM f JOIN d ON f.rowid = d.id WHERE f MATCH 'two'").all()
    assert [tuple(r) for r in rows] == [(2, "two three")]


def test_stems():
    assert [stem(w) for w in "caresses ponies cats agreed plastered motoring conflated hopping filing happy relational rational vietnamization triplicate formalize revival adoption controll".split()] == "caress poni cat agre plaster motor conflat hop file happi relat ration vietnam triplic formal reviv adopt control".split()


def test_options_and_reads(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    for bad in ("f USING fts5(a, prefix='2 x')", "f USING fts5(a, prefix='0')", "f USING fts5(a, detail=some)", "f USING fts5(prefix='2')", "f USING fts5(a, nope=1)", "f USING rtree(a)"):
        with pytest.raises(EngineError):
            e.run(f"CREATE VIRTUAL TABLE {bad}")
    e.run("CREATE TABLE d (id INTEGER PRIMARY KEY, a TEXT, b TEXT)")
    e.run("INSERT INTO d VALUES (1, 'one two two', 'three'), (2, NULL, 'two'), (3, '', '')")
    e.run("CREATE VIRTUAL TABLE f USING fts5(a, b, content='d', content_rowid='id', prefix='2 3', columnsize=0)")
    e.run("CREATE VIRTUAL TABLE g USING fts5(a, content='', contentless_delete=1, detail=none)")
    e.run("INSERT INTO f(rowid, a, b) SELECT id, a, b FROM d")
    e.run("INSERT INTO g(a) SELECT b FROM d ORDER BY id DESC")
    assert [r[0] for r in e.prepare("SELECT rowid FROM g WHERE g MATCH 'two OR three' ORDER BY rowid").all()] == [2, 3]
    with pytest.raises(MatchFault):
        e.prepare("SELECT rowid FROM g WHERE g MATCH '\"two three\"'").all()
    index = e.open_fts(e.catalog.fts["f"])
    assert [index.document_stats(i) for i in (1, 2, 3, 4)] == [[3, 1], [0, 1], [0, 0], None]
    assert sorted((r["docid"], r["col"], r["tf"], r["at"]) for r in index.term_postings("two").collect()) == [(1, 0, 2, [1, 2]), (2, 1, 1, [0])]
    assert index.frequency("two") == 2 and index.stats() == (3, 5 / 3) and index.next_docid() == 4
    assert index.matches(1, "two NOT b:two") and not index.matches(2, "a:two") and index.score(2, "one") is None
    want = {r["docid"]: r["score"] for r in index.match("two", (2.0, 0.5)).collect()}
    assert index.score(1, "two", (2.0, 0.5)) == want[1] and want[1] < want[2]
