"""Command line: create, put, get, delete, scan, stats, check, tables, schema, query, import, snapshot."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def main(argv: list | None = None, spark: SparkSession | None = None, out=None) -> int:
    out = out or sys.stdout
    p = argparse.ArgumentParser(prog="larkspur", description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)
    more = {"create": [], "put": ["key", "value"], "get": ["key"], "delete": ["key"], "scan": [], "stats": [], "check": [], "tables": [], "schema": [], "query": ["sql"], "run": ["sql"], "import": ["file"], "snapshot": ["target"]}
    for verb, args in more.items():
        s = sub.add_parser(verb)
        s.add_argument("root")
        for a in args:
            s.add_argument(a)
    a = p.parse_args(argv)
    from .engine import Engine
    from .errors import EngineError
    from .sources.keyvalue import KeyValue
    from .sources.sqlite import import_sqlite

    spark = spark or SparkSession.builder.appName("larkspur").getOrCreate()
    say = lambda *x, sep=" ": print(*x, sep=sep, file=out)
    try:
        if a.verb in ("put", "get", "delete", "scan"):
            kv = KeyValue(spark, f"{a.root}/kv")
            if a.verb == "put":
                kv.put([(a.key.encode(), a.value.encode())])
            elif a.verb == "delete":
                kv.delete([a.key.encode()])
            elif a.verb == "get":
                v = kv.get(a.key.encode())
                if v is None:
                    return 1
                say(v.decode("utf-8", "replace"))
            else:
                for k, v in kv.scan():
                    say(k.decode("utf-8", "replace"), v.decode("utf-8", "replace"), sep="\t")
            return 0
        e = Engine(spark, a.root)
        if a.verb == "tables":
            for t in e.tables():
                say(t)
        elif a.verb == "stats":
            for t in e.catalog.tables:
                say(t, e.row_count(t), sep="\t")
        elif a.verb == "schema":
            for t in e.catalog.tables.values():
                say(t.name, ", ".join(f"{c.name} {c.type}" for c in t.columns), sep="\t")
        elif a.verb == "check":
            wrong = e.verify()
            say("\n".join(wrong) or "ok")
            return int(bool(wrong))
        elif a.verb == "query":
            for r in e.prepare(a.sql).all():
                say(json.dumps([v.hex() if isinstance(v, bytes) else v for v in r], ensure_ascii=False))
        elif a.verb == "run":
            say(e.run(a.sql).changes)
        elif a.verb == "import":
            say(", ".join(import_sqlite(e, a.file)))
        elif a.verb == "snapshot":
            e.snapshot(a.target)
        return 0
    except EngineError as x:
        print(x, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
