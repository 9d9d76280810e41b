import io
import sqlite3

import pytest

from larkspur import Engine
from larkspur.cli import main
from larkspur.errors import EngineError
from larkspur.search import DENORMALISED, PLATFORMS, SQL, WEIGHTS, Params, frame, search, search_framed, unframe
from larkspur.sources.keyvalue import KeyValue
from larkspur.sources.sqlite import Derived, Lookup, Manifest, declared_type, import_sqlite
from larkspur.streaming.ingest import into_fts, into_table


def test_key_value(spark, tmp_path, monkeypatch):
    kv = KeyValue(spark, f"file://{tmp_path}")
    kv.put([(b"b", b"2"), (b"a", b"1"), (b"\xff", b"9"), (b"b", b"3")])
    kv.delete([b"a"])
    kv = KeyValue(spark, f"file://{tmp_path}")
    assert kv.get(b"b") == b"3" and kv.get(b"a") is None
    kv.put([(b"ab", b"x")])
    assert [k for k, _ in kv.scan()] == [b"ab", b"b", b"\xff"]
    assert [k for k, _ in kv.scan(b"b", b"\xff")] == [b"b"] and next(kv.scan(reverse=True))[0] == b"\xff"
    with pytest.raises(EngineError):
        kv.put([(b"\0a", b"")])
    monkeypatch.setattr("larkspur.sources.keyvalue.MOST_PARTS", 4)
    for i in range(5):
        kv.put([(b"n%d" % i, b"%d" % i), (b"b", b"%d" % i)])
        kv.delete([b"n%d" % (i - 1)])
    assert list(kv.scan(b"b", b"o")) == [(b"b", b"4"), (b"n4", b"4")] and len(kv.parts()) <= 4


INTS = ("id", "is_deprecated", "is_beta", "is_release_notes", "url_depth", *[f"min_{p}_num" for p in PLATFORMS])


def documents():
    cols = ["id", "key", "title", "role", "role_heading", "abstract_text", "declaration_text", "headings", "platforms_json", *[f"min_{p}_num" for p in PLATFORMS], *[f"min_{p}" for p in PLATFORMS], "framework", "source_type", "source_metadata", "is_deprecated", "is_beta", "is_release_notes", "kind", "language", "url_depth"]
    rows = []
    for i in range(1, 41):
        least = [None if (i + k) % 4 == 0 else (i * (k + 2)) % 17 for k in range(5)]
        about = (None, "{}", '{"year":"%d","track":"Design"}' % (2018 + i % 4), '{"year":%d,"track":"design tools"}' % (2018 + i % 4))[i % 4]
        title = {9: "View", 10: "VIEW", 11: "viewer", 12: "A view of it"}.get(i, f"Sheet number {i}")
        rows.append((i, "view" if i == 13 else f"kit{i % 3}/view{i}", title, ("symbol", "Article", None)[i % 3], "Class" if i % 5 else None, f"Shows view {i} " + "view text " * (i % 5), f"func view{i}()", "more views", "[]", *least, *[None if v is None else f"{v}.0" for v in least], f"kit{i % 4}" if i % 6 else None, ("docs", "video", None)[i % 3], about, i % 2, i % 3 % 2, 0, ("class", "func")[i % 2], ("swift", "objc", None)[i % 3], i % 4))
    return cols, rows


@pytest.fixture
def sqlite_file(tmp_path):
    path = tmp_path / "in.db"
    db = sqlite3.connect(path)
    cols, rows = documents()
    kinds = {c: "INT" for c in INTS} | {"id": "INTEGER PRIMARY KEY", "is_deprecated": "BOOLEAN_INT"}
    db.execute(f"CREATE TABLE documents ({', '.join(c + ' ' + kinds.get(c, 'VARCHAR(20)') for c in cols)})")
    db.executemany(f"INSERT INTO documents VALUES ({','.join('?' * len(cols))})", rows)
    db.execute("CREATE UNIQUE INDEX dk ON documents(key, id)")
    db.execute("CREATE TABLE roots (slug TEXT PRIMARY KEY, display_name TEXT)")
    db.executemany("INSERT INTO roots VALUES (?,?)", [("kit1", "Kit One"), ("kit2", None)])
    db.commit()
    db.close()
    return str(path)


_own = lambda n: DENORMALISED[n].replace("d.", "")
MANIFEST = Manifest(
    derived={"documents": [Derived(n, t, _own(n)) for n, t in (("title_lc", "TEXT"), ("key_lc", "TEXT"), ("year_num", "INTEGER"), ("track_lc", "TEXT"))]},
    lookups={"documents": [Lookup("root_display", "TEXT", "roots", "framework", "slug", "display_name", "framework"), Lookup("root_slug", "TEXT", "roots", "framework", "slug", "slug", "framework")]},
)
REQUESTS = [
    Params("view", "view", 50), Params("view", "View", 7), Params("view OR number", "a VIEW", 50), Params("view", "KIT1/view4", 50), Params("view*", "", 50, framework="kit1"),
    Params("view", "view", 50, source_type="docs"), Params("view", "view", 50, sources_json='["docs", 3, null]'), Params("view", "view", 50, kind="CLASS"), Params("view", "view", 50, kind="article"),
    Params("view", "view", 50, language="swift"), Params("view", "view", 50, language="both"), Params("view", "view", 50, year=2020), Params("view", "view", 50, track_like="design%"),
    Params("view", "view", 50, track_like=""), Params("view", "view", 50, deprecated_mode="exclude"), Params("view", "view", 50, deprecated_mode="only", year=2019),
    *[Params("view", "view", 50, **{f"min_{p}": 6}) for p in PLATFORMS], Params("nothing", "view"),
]


def test_import_search_and_framing(spark, tmp_path, sqlite_file):
    e = Engine(spark, f"file://{tmp_path}/e")
    assert sorted(import_sqlite(e, sqlite_file, MANIFEST)) == ["documents", "roots"]
    cols, rows = documents()
    assert [tuple(r) for r in e.prepare(f"SELECT {', '.join(cols)} FROM documents ORDER BY id").all()] == rows
    assert e.catalog.tables["documents"].indexes["dk"] == [["key", "id"], True]
    # the same statements on sqlite3, whose full-text module has the same tokens and scores
    lite = sqlite3.connect(sqlite_file)
    fts = f"CREATE VIRTUAL TABLE documents_fts USING fts5({', '.join(WEIGHTS)}, tokenize='porter unicode61')"
    fill = f"INSERT INTO documents_fts(rowid, {', '.join(WEIGHTS)}) SELECT id, title, abstract_text, declaration_text, headings, key FROM documents"
    for s in (fts, fill):
        lite.execute(s)
        e.run(s)
    near = lambda rows: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows]
    for k, p in enumerate(REQUESTS):
        want = lite.execute(SQL, p.bind()).fetchall()
        assert near(map(tuple, search(e, p).collect())) == near(want), p
        if k % 3 == 0:
            assert near(map(tuple, search(e, p, denormalised=True).collect())) == near(want), p
    assert len(search(e, REQUESTS[0]).columns) == 24
    with pytest.raises(EngineError):
        search(e, Params("view", deprecated_mode="maybe"))
    n, got = unframe(search_framed(e, Params("view", "view", limit=5)))
    assert n == 24 and len(got) == 5 and got[0][1] == "View"


def test_frame_bytes():
    rows = [(None, 1, -2.5, "é", b"\0")]
    data = frame(rows, 5)
    assert data[:8] == b"\5\0\0\0\1\0\0\0" and unframe(data) == (5, rows)


def test_declared_types():
    assert [declared_type(d) for d in ("BIGINT", "VARCHAR(3)", "", "BLOB", "DOUBLE", "NUMERIC", None)] == ["INTEGER", "TEXT", "BLOB", "BLOB", "REAL", "TEXT", "BLOB"]


def test_command_line(spark, tmp_path, sqlite_file):
    root = f"file://{tmp_path}/c"

    def run(*args):
        out = io.StringIO()
        return main(list(args), spark, out), out.getvalue()

    assert run("create", root)[0] == 0
    assert run("put", root, "k", "v")[0] == 0 and run("get", root, "k") == (0, "v\n") and run("get", root, "z")[0] == 1
    assert run("scan", root)[1] == "k\tv\n"
    assert "documents" in run("import", root, sqlite_file)[1]
    assert run("tables", root)[1] == "documents\nroots\n" and "roots\t2" in run("stats", root)[1] and run("check", root) == (0, "ok\n")
    assert run("query", root, "SELECT slug FROM roots ORDER BY slug")[1] == '["kit1"]\n["kit2"]\n'
    assert run("run", root, "DELETE FROM roots WHERE slug = 'kit2'")[1] == "1\n"
    assert run("query", root, "SELECT nope FROM roots")[0] == 2
    assert run("snapshot", root, f"file://{tmp_path}/copy")[0] == 0 and "slug TEXT" in run("schema", root)[1]


def test_streams(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s")
    e.run("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT)")
    e.run("CREATE VIRTUAL TABLE f USING fts5(body)")
    src = f"{tmp_path}/in"
    for batch in ([(1, "a b"), (2, "c")], [(3, "b d")]):
        spark.createDataFrame(batch, "id long, v string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id long, v string").parquet(src)
        into_table(stream, e, "t", f"{tmp_path}/k1", "ON CONFLICT(id) DO NOTHING").awaitTermination()
        into_fts(stream.selectExpr("id AS rowid", "v AS body"), e, "f", f"{tmp_path}/k2").awaitTermination()
    assert e.row_count("t") == 3
    assert [r[0] for r in e.prepare("SELECT rowid FROM f WHERE f MATCH 'b' ORDER BY rowid").all()] == [1, 3]
