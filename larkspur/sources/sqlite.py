"""Importing SQLite files: tables, indexes, full-text indexes and build-time denormalisation.

SQLite files are read by the driver (there is no distributed reader of them), batch by
batch: each is written to the tables' folder, so the driver never holds more than one.
"""

from __future__ import annotations

import sqlite3
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import functions as F

from ..errors import EngineError, TypeFault

BATCH = 50_000
#: Where a row stood in the file.
PLACE = "__place"
_ARROW = {"INTEGER": pa.int64(), "REAL": pa.float64(), "TEXT": pa.string(), "BLOB": pa.binary()}


@dataclass
class Lookup:
    """column = value of another table's column, found by a key; fallback where there is none."""

    column: str
    type: str
    table: str
    key: str  # of this table
    other_key: str
    value: str
    fallback: str | None = None  # a column of this table


@dataclass
class Derived:
    """column = an expression of the row, in the engine's dialect."""

    column: str
    type: str
    expression: str


@dataclass
class Manifest:
    tables: list | None = None
    fts: dict = field(default_factory=dict)  # name: {"table", "columns", "tokenize", "docid"}
    derived: dict = field(default_factory=dict)  # table: [Derived]
    lookups: dict = field(default_factory=dict)  # table: [Lookup]


def declared_type(decl: str) -> str:
    """SQLite's affinity rules for a declared type; what is neither integer, real nor blob becomes TEXT."""
    d = (decl or "").upper()
    if "INT" in d:
        return "INTEGER"
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return "TEXT"
    if "BLOB" in d or not d:
        return "BLOB"
    return "REAL" if any(x in d for x in ("REAL", "FLOA", "DOUB")) else "TEXT"


def coerce(v, kind: str):
    """Exact conversions only; others are errors."""
    if v is None:
        return None
    if kind == "INTEGER" and isinstance(v, float) and v == int(v):
        return int(v)
    if kind == "REAL" and isinstance(v, int):
        return float(v)
    if kind == "TEXT" and isinstance(v, (int, float)):
        return str(v)
    if kind == "BLOB" and isinstance(v, str):
        return v.encode()
    if not isinstance(v, {"INTEGER": int, "REAL": float, "TEXT": str, "BLOB": bytes}[kind]):
        raise TypeFault(f"{v!r} is not {kind}")
    return v


def quote(n: str) -> str:
    return '"' + n.replace('"', '""') + '"'


def tables_of(db: sqlite3.Connection) -> list[str]:
    """User tables that are no parts of virtual ones."""
    rows = db.execute("SELECT name, sql FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%'").fetchall()
    virtual = [n for n, sql in rows if sql and sql.lstrip().upper().startswith("CREATE VIRTUAL")]
    return [n for n, _ in rows if n not in virtual and not any(n.startswith(v + "_") for v in virtual)]


def import_sqlite(engine, path: str, manifest: Manifest | None = None) -> list[str]:
    m = manifest or Manifest()
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        done = []
        for t in m.tables or tables_of(db):
            _table(engine, db, t, m)
            done.append(t)
        for t in done:
            _denormalise(engine, t, m)
        for name, f in m.fts.items():
            columns = ", ".join(f["columns"])
            engine.run(f"CREATE VIRTUAL TABLE {quote(name)} USING fts5({columns}, tokenize='{f.get('tokenize', 'unicode61')}')")
            docid = f.get("docid") or engine.catalog.tables[f["table"]].pk
            engine.run(f"INSERT INTO {quote(name)}(rowid, {columns}) SELECT {docid}, {columns} FROM {quote(f['table'])}")
        if wrong := engine.verify():
            raise EngineError("; ".join(wrong))
        return done
    finally:
        db.close()


def _table(engine, db: sqlite3.Connection, t: str, m: Manifest) -> None:
    info = db.execute(f"PRAGMA table_info({quote(t)})").fetchall()
    kinds = {n: declared_type(d) for _, n, d, *_ in info}
    keys = [n for _, n, _, _, _, pk in sorted(info, key=lambda r: r[5]) if pk]
    single = len(keys) == 1 and kinds[keys[0]] == "INTEGER"
    parts = []
    for _, n, _, not_null, _, _ in info:
        parts.append(f"{quote(n)} {kinds[n]}" + (" PRIMARY KEY" if single and n == keys[0] else "") + (" NOT NULL" if not_null else ""))
    parts += [f"{quote(x.column)} {x.type}" for x in [*m.derived.get(t, []), *m.lookups.get(t, [])]]
    if keys and not single:
        parts.append(f"PRIMARY KEY ({', '.join(map(quote, keys))})")
    engine.run(f"CREATE TABLE {quote(t)} ({', '.join(parts)})")
    names = list(kinds)
    cursor = db.execute(f"SELECT {', '.join(map(quote, names))} FROM {quote(t)} ORDER BY rowid" if single or not keys else f"SELECT {', '.join(map(quote, names))} FROM {quote(t)}")
    schema = pa.schema([(n, _ARROW[kinds[n]]) for n in names])
    staged, n = engine.files.new("import"), 0
    while rows := cursor.fetchmany(BATCH):
        cols = [pa.array([coerce(r[i], kinds[c]) for r in rows], _ARROW[kinds[c]]) for i, c in enumerate(names)]
        place = pa.array(range(n, n + len(rows)), pa.int64())
        part = engine.spark.createDataFrame(pa.Table.from_arrays([*cols, place], schema=schema.append(pa.field(PLACE, pa.int64()))))
        part.coalesce(1).write.mode("append").parquet(staged)
        n += len(rows)
    if n:
        engine.load(t, engine.spark.read.parquet(staged), PLACE)
        engine.files.delete([staged])
    for _, name, unique, origin, partial in db.execute(f"PRAGMA index_list({quote(t)})").fetchall():
        cols = [r[2] for r in db.execute(f"PRAGMA index_info({quote(name)})").fetchall()]
        if origin == "pk" or partial or None in cols:
            continue
        label = name if not name.startswith("sqlite_") else f"imported_{t}_{'_'.join(cols)}"
        engine.run(f"CREATE {'UNIQUE ' if unique else ''}INDEX {quote(label)} ON {quote(t)}({', '.join(map(quote, cols))})")


def _denormalise(engine, t: str, m: Manifest) -> None:
    """One rewrite of the table for all its derived and looked-up columns."""
    derived, lookups = m.derived.get(t, []), m.lookups.get(t, [])
    if not derived and not lookups:
        return
    sets = ", ".join(f"{quote(d.column)} = {d.expression}" for d in derived)
    if sets:
        engine.run(f"UPDATE {quote(t)} SET {sets}")

    def fill(e):
        w = e.writer
        info = w.info(t)
        rows = w.rows(info)
        for x in lookups:
            other = w.rows(w.info(x.table)).select(F.col(x.other_key).alias("__key"), F.col(x.value).alias("__value"))
            first = other.where("__key is not null").groupBy("__key").agg(F.first("__value").alias("__value"))
            rows = rows.join(first, F.col(f"`{x.key}`") == F.col("__key"), "left")
            value = F.coalesce("__value", F.col(f"`{x.fallback}`")) if x.fallback else F.col("__value")
            rows = rows.withColumn(x.column, value).drop("__key", "__value")
        w.put(info, rows)

    if lookups:
        engine.transaction(fill)
