"""The search-pages query: full-text matches joined with documents, filtered, tiered and ranked; and its response framing."""

from __future__ import annotations

import struct
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame

from .errors import EngineError
from .functions.values import fold

PLATFORMS = ("ios", "macos", "watchos", "tvos", "visionos")
#: What a request gets, in this order (fixed names): output name and column of documents; None: made by the query.
OUTPUT = (
    ("path", "key"), ("title", "title"), ("role", "role"), ("role_heading", "role_heading"), ("abstract", "abstract_text"), ("declaration", "declaration_text"), ("platforms", "platforms_json"),
    *((f"min_{p}", f"min_{p}") for p in PLATFORMS), ("framework", None), ("root_slug", None), ("source_type", "source_type"), ("source_metadata", "source_metadata"), ("url_depth", "url_depth"),
    ("is_release_notes", "is_release_notes"), ("is_deprecated", "is_deprecated"), ("is_beta", "is_beta"), ("doc_kind", "kind"), ("language", "language"), ("rank", None), ("tier", None),
)
#: Columns of the full-text table and their weights (fixed values).
WEIGHTS = {"title": 10.0, "abstract": 5.0, "declaration": 3.0, "headings": 2.0, "key": 1.0}
#: Columns that a denormalised documents table has besides, as expressions over documents d and roots r.
DENORMALISED = {
    "root_display": "COALESCE(r.display_name, d.framework)",
    "root_slug": "COALESCE(r.slug, d.framework)",
    "title_lc": "LOWER(d.title)",
    "key_lc": "LOWER(d.key)",
    "year_num": "CAST(json_extract(d.source_metadata, '$.year') AS INTEGER)",
    "track_lc": "LOWER(COALESCE(json_extract(d.source_metadata, '$.track'), ''))",
}


@dataclass
class Params:
    """A request; None means no filter.  raw is the user's own text, which decides the tier."""

    query: str
    raw: str = ""
    limit: int = 20
    framework: str | None = None
    source_type: str | None = None
    sources_json: str | None = None  # a JSON array of source types
    kind: str | None = None  # of role_heading, kind or role, in any case
    language: str | None = None  # "both": no filter
    year: int | None = None
    track_like: str | None = None  # a LIKE pattern
    deprecated_mode: str | None = "include"  # or "exclude" or "only"
    min_ios: int | None = None
    min_macos: int | None = None
    min_watchos: int | None = None
    min_tvos: int | None = None
    min_visionos: int | None = None

    def bind(self) -> dict:
        out = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "deprecated_mode"}
        mode = self.deprecated_mode or "include"
        if mode not in ("include", "exclude", "only"):
            raise EngineError(f"deprecated_mode {mode}")
        return out | {"exact": fold(self.raw), "dep_exclude": 1 if mode == "exclude" else None, "dep_only": 1 if mode == "only" else None}


def _select(denormalised: bool) -> str:
    made = {n: f"d.{n}" for n in DENORMALISED} if denormalised else DENORMALISED
    tests = [f"{made['title_lc']} = $exact", f"{made['key_lc']} = $exact", f"{made['title_lc']} LIKE $exact || '%'", f"INSTR({made['title_lc']}, $exact) > 0"]
    tier = "CASE " + " ".join(f"WHEN {t} THEN {n}" for t, n in zip(tests, (0, 0, 1, 2), strict=True)) + " ELSE 3 END"
    weights = ", ".join(str(w) for w in WEIGHTS.values())
    more = {"framework": made["root_display"], "root_slug": made["root_slug"], "rank": f"bm25(documents_fts, {weights})", "tier": tier}
    shown = ", ".join(f"{more[n] if c is None else 'd.' + c} AS {n}" for n, c in OUTPUT)
    where = ["documents_fts MATCH $query"]
    given = lambda p, test: where.append(f"(${p} IS NULL OR {test})")
    given("framework", "d.framework = $framework")
    given("source_type", "d.source_type = $source_type")
    given("sources_json", "d.source_type IN (SELECT value FROM json_each($sources_json))")
    given("kind", " OR ".join(f"LOWER(d.{c}) = LOWER($kind)" for c in ("role_heading", "kind", "role")))
    given("language", "$language = 'both' OR d.language = $language")
    given("year", f"{made['year_num']} = $year")
    given("track_like", f"{made['track_lc']} LIKE $track_like")
    given("dep_exclude", "d.is_deprecated = 0")
    given("dep_only", "d.is_deprecated = 1")
    for p in PLATFORMS:
        given(f"min_{p}", f"d.min_{p}_num IS NULL OR d.min_{p}_num <= $min_{p}")
    roots = "" if denormalised else " LEFT JOIN roots r ON r.slug = d.framework"
    return f"SELECT {shown} FROM documents_fts JOIN documents d ON documents_fts.rowid = d.id{roots} WHERE {' AND '.join(where)} ORDER BY tier, rank LIMIT $limit"


SQL, SQL_DENORMALISED = _select(False), _select(True)


def search(engine, p: Params, denormalised: bool = False) -> DataFrame:
    """denormalised: documents has the columns of DENORMALISED, and roots is not read; the rows are the same."""
    return engine.sql(SQL_DENORMALISED if denormalised else SQL, p.bind())


NULL, INTEGER, REAL, TEXT, BLOB = range(5)


def frame(rows: list, columns: int) -> bytes:
    """[u32 columns][u32 rows], then each cell: a tag byte and its value, little-endian; texts and blobs with a u32 length."""
    out = [struct.pack("<II", columns, len(rows))]
    for r in rows:
        for v in r:
            if v is None:
                out.append(bytes([NULL]))
            elif isinstance(v, (bool, int)):
                out.append(struct.pack("<Bq", INTEGER, v))
            elif isinstance(v, float):
                out.append(struct.pack("<Bd", REAL, v))
            else:
                raw, tag = (v.encode(), TEXT) if isinstance(v, str) else (bytes(v), BLOB)
                out.append(struct.pack("<BI", tag, len(raw)) + raw)
    return b"".join(out)


def unframe(data: bytes) -> tuple[int, list]:
    columns, n = struct.unpack_from("<II", data)
    at, rows = 8, []
    for _ in range(n):
        row = []
        for _ in range(columns):
            tag, at = data[at], at + 1
            if tag in (INTEGER, REAL):
                row.append(struct.unpack_from("<q" if tag == INTEGER else "<d", data, at)[0])
                at += 8
            elif tag == NULL:
                row.append(None)
            else:
                size = struct.unpack_from("<I", data, at)[0]
                raw, at = data[at + 4 : at + 4 + size], at + 4 + size
                row.append(raw.decode() if tag == TEXT else raw)
        rows.append(tuple(row))
    return columns, rows


def search_framed(engine, p: Params, denormalised: bool = False) -> bytes:
    df = search(engine, p, denormalised)
    return frame([tuple(r) for r in df.collect()], len(df.columns))
