"""SELECT statements as DataFrames.

A source's columns get names of their own (``t3_title``), so self-joins and nested
queries need no qualifiers in Spark.  Where the dialect's result depends on the order
of rows (ties, bare columns, JSON aggregates, the first row of a subquery), the row
ids of the sources, in FROM order, decide.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import MatchFault, NameFault, SyntaxFault, Unsupported
from ..functions import columns as C
from ..functions import values as V
from . import ast as A
from .lowering import NOT_CONSTANT, Lowerer, Scope, Typed, _kids, as_int, constant, number_of, text_of, to_class, unify

AGGREGATES = ("COUNT", "SUM", "JSON_GROUP_ARRAY", "JSON_GROUP_OBJECT")
_numbers = itertools.count()


@dataclass
class Source:
    """A table as queries see it: columns are (name, class, collation); rowid names the column that orders rows."""

    df: DataFrame
    columns: list
    rowid: str | None = None
    fts: Any = None


@dataclass
class Query:
    """A lowered query: DataFrame, output names, and each output's Typed (over the DataFrame's own names)."""

    df: DataFrame
    names: list
    types: list
    order: list = field(default_factory=list)  # columns of df that order its rows, if they were asked for


class Selector:
    def __init__(self, engine, params=(), new_old=None):
        self.engine, self.params, self.new_old = engine, params, new_old or {}
        self.keep_order = False

    def frame(self, ast) -> DataFrame:
        q = self.query(ast)
        return q.df.toDF(*q.names)

    def query(self, ast, outer: Scope | None = None) -> Query:
        return self.compound(ast) if isinstance(ast, A.Compound) else self.select(ast, outer)

    # --- sources

    def sources(self, s: A.Select, outer: Scope | None) -> tuple[DataFrame, Scope, list[Column], list, list]:
        if s.table is None:
            raise Unsupported("SELECT without FROM")
        refs = [(s.table, None, None)] + [(j.table, j.kind, j.on) for j in s.joins]
        scope = Scope(params=self.params, outer=outer, subquery=self.subquery, new_old=self.new_old)
        where, matches = self.take_matches(s.where, refs)
        ons = []
        for ref, kind, on in refs:
            rest, found = self.take_matches(on, refs)
            ons.append(rest)
            matches |= found
            if found and kind == "left":
                raise MatchFault("MATCH in the ON of a LEFT JOIN")
        df, order, parts = None, [], []
        for (ref, kind, _), on in zip(refs, ons, strict=True):
            src = self.engine.source(ref.name)
            qualifier = ref.alias or ref.name
            if any(q.lower() == qualifier.lower() for q, _, _ in scope.sources):
                raise NameFault(f"ambiguous table name: {qualifier}")
            tag = f"t{next(_numbers)}_"
            part = src.df
            if src.fts is not None:
                part = self.searched(src, qualifier, matches.pop(qualifier.lower(), None), s, scope)
            names = {c: f"{tag}{c}" for c in part.columns}
            part = part.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
            cols = {}
            for name, cls, collation in src.columns:
                col = F.col(f"`{names[name]}`")
                affinity = {"INT": "INTEGER", "REAL": "REAL", "TEXT": "TEXT", "BLOB": "BLOB", "BOOL": "INTEGER"}[cls]
                cols[name.lower()] = Typed(col, cls, affinity, collation)
            scope.sources.append((qualifier, cols, [c[0] for c in src.columns]))
            if src.rowid:
                order.append(F.col(f"`{names[src.rowid]}`"))
            parts.append(part)
            if df is None:
                df = part
            else:
                cond = Lowerer(scope).truth(on) if on is not None else F.lit(True)
                df = df.join(part, cond, kind)
        if matches:
            raise MatchFault(f"no full-text table named {next(iter(matches))} in FROM")
        if where is not None:
            df = df.where(Lowerer(scope).truth(where))
        return df, scope, order, refs, parts

    def take_matches(self, e: A.Expr | None, refs: list) -> tuple[A.Expr | None, dict]:
        """MATCH conjuncts, by table, and what is left of the condition."""
        if isinstance(e, A.Match):
            return None, {self.match_target(e, refs): e.query}
        if isinstance(e, A.Binary) and e.op == "AND":
            left, found = self.take_matches(e.left, refs)
            right, more = self.take_matches(e.right, refs)
            if set(found) & set(more):
                raise MatchFault("two MATCHes of one table")
            rest = left if right is None else right if left is None else A.Binary("AND", left, right)
            return rest, found | more
        return e, {}

    def match_target(self, e: A.Match, refs: list) -> str:
        names = [(r.alias or r.name).lower() for r, _, _ in refs]
        tables = [r.name.lower() for r, _, _ in refs]
        if e.table.lower() in names:
            return e.table.lower()
        if e.table.lower() in tables:
            return names[tables.index(e.table.lower())]
        raise MatchFault(f"MATCH needs a full-text table: {e.table}")

    def searched(self, src: Source, qualifier: str, query: A.Expr | None, s: A.Select, scope: Scope) -> DataFrame:
        """docid and score of a full-text source."""
        if query is None:
            return src.fts.documents().select(F.col("docid").alias("rowid"), F.lit(None).cast("double").alias("rank"))
        text = Lowerer(scope).value(query)
        if text is NOT_CONSTANT:
            raise MatchFault("a MATCH query must be constant")
        weights = self.weights(s, qualifier, src)
        scored = weights is not None or _mentions_rank(s, qualifier)
        found = src.fts.match(V.text(text) or "", weights or (), score=scored)
        rank = F.col("score") if scored else F.lit(None).cast("double")
        return found.select(F.col("docid").alias("rowid"), rank.alias("rank"))

    def weights(self, s: A.Select, qualifier: str, src: Source) -> tuple | None:
        calls = [c for c in _calls(s) if c.name == "BM25"]
        mine = [c for c in calls if c.args and isinstance(c.args[0], A.Column) and c.args[0].name.lower() in (qualifier.lower(), src.fts.name.lower())]
        out = None
        for c in mine:
            w = tuple(float(a.value) if isinstance(a, A.Literal) and isinstance(a.value, (int, float)) else 1.0 for a in c.args[1:])
            w += (1.0,) * (len(src.fts.columns) - len(w))
            if out is not None and out != w:
                raise MatchFault("one weight vector per full-text table and query")
            out = w
        return out

    # --- SELECT

    def select(self, s: A.Select, outer: Scope | None = None) -> Query:
        df, scope, order, refs, parts = self.sources(s, outer)
        items = self.expand(s.items, scope)
        self.bm25_slots(s, scope, refs)
        exprs = [i.expr for i in items] + [o.expr for o in s.order] + ([s.having] if s.having is not None else [])
        names = [i.alias or (i.expr.name if isinstance(i.expr, A.Column) else i.text) for i in items]
        if s.group or any(c.name in AGGREGATES for e in exprs for c in _walk(e)):
            df, scope, order = self.counted(s, scope, refs, parts, exprs) or self.aggregated(s, df, scope, order, exprs)
        low = Lowerer(scope)
        outs = [low.lower(i.expr) for i in items]
        aliases = {i.alias.lower(): t for i, t in zip(items, outs, strict=True) if i.alias}
        keys = []
        for o in s.order:
            alias = isinstance(o.expr, A.Column) and o.expr.table is None and aliases.get(o.expr.name.lower())
            keys.append((alias or low.lower(o.expr), o.desc))
        keys = [(t, d) for t, d in keys if t.const is NOT_CONSTANT]
        return self.shaped(df, names, outs, keys, order, s.distinct, self.bound(s.limit), self.bound(s.offset))

    def expand(self, items: list, scope: Scope) -> list:
        out = []
        for i in items:
            if i.expr is not None:
                out.append(i)
                continue
            of = [x for x in scope.sources if i.star_of is None or x[0].lower() == i.star_of.lower()]
            if not of:
                raise NameFault(f"no such table: {i.star_of}")
            out += [A.Item(A.Column(q, n), text=n) for q, _, names in of for n in names]
        return out

    def bm25_slots(self, s: A.Select, scope: Scope, refs: list) -> None:
        for c in _calls(s):
            if c.name == "BM25":
                if not c.args or not isinstance(c.args[0], A.Column):
                    raise MatchFault("bm25 needs a full-text table")
                name = c.args[0].name.lower()
                for (q, cols, _), (ref, _, _) in zip(scope.sources, refs, strict=True):
                    if name in (q.lower(), ref.name.lower()) and self.engine.source(ref.name).fts is not None:
                        scope.slots[c] = cols["rank"]
                        break
                else:
                    raise MatchFault(f"bm25 of {c.args[0].name}, which is no full-text table here")

    def bound(self, e: A.Expr | None) -> int | None:
        """The value of LIMIT or OFFSET; null and negative ones are as none."""
        if e is None:
            return None
        v = Lowerer(Scope(params=self.params, new_old=self.new_old)).value(e)
        if v is NOT_CONSTANT:
            raise SyntaxFault("LIMIT and OFFSET must be constant")
        v = V.integer(v)
        return None if v is None or v < 0 else v

    def shaped(self, df: DataFrame, names: list, outs: list, keys: list, order: list, distinct: bool, limit: int | None, offset: int | None) -> Query:
        cols = [(as_int(t).col if t.cls != "NULL" else F.lit(None).cast("string")) for t in outs]
        out_names = [f"o{i}" for i in range(len(cols))]
        sort = [C.fold(t.col) if t.collation == "NOCASE" and t.cls == "TEXT" else t.col for t, _ in keys]
        wanted = [c.alias(n) for c, n in zip(cols, out_names, strict=True)]
        sort_names = [f"s{i}" for i in range(len(sort))]
        row_names = [f"r{i}" for i in range(len(order))]
        if keys or (distinct and order) or limit is not None or offset or self.keep_order:
            df = df.select(*wanted, *[c.alias(n) for c, n in zip(sort, sort_names, strict=True)], *[c.alias(n) for c, n in zip(order, row_names, strict=True)])
        else:
            df = df.select(*wanted)
            row_names = []
        if distinct:
            folded = [C.fold(F.col(n)) if t.collation == "NOCASE" and t.cls == "TEXT" else F.col(n) for n, t in zip(out_names, outs, strict=True)]
            plain = not sort_names and not self.keep_order and all(t.collation != "NOCASE" for t in outs)
            if plain and limit is None and not offset:
                df, row_names = df.select(*out_names).distinct(), []
            else:  # the first row of each
                first = F.struct(*row_names) if row_names else F.lit(0)
                whole = F.min_by(F.struct(*df.columns), first).alias("w")
                df = df.groupBy(*[f.alias(f"g{i}") for i, f in enumerate(folded)]).agg(whole).select("w.*")
        by = [F.col(n).desc_nulls_last() if d else F.col(n).asc_nulls_first() for n, (_, d) in zip(sort_names, keys, strict=True)]
        by += [F.col(n).asc_nulls_first() for n in row_names]
        if limit is not None or offset or (sort_names and not self.keep_order):
            df = df.orderBy(*by) if by else df
        if offset:
            df = df.offset(offset)
        if limit is not None:
            df = df.limit(limit)
        types = [replace(as_int(t), col=F.col(n), const=NOT_CONSTANT) if t.cls != "JSON" else Typed(F.col(n), "TEXT") for n, t in zip(out_names, outs, strict=True)]
        return Query(df, names, types, by) if self.keep_order else Query(df.select(*out_names), names, types)

    # --- aggregates

    def counted(self, s: A.Select, scope: Scope, refs: list, parts: list, exprs: list) -> tuple[DataFrame, Scope, list] | None:
        """COUNT(*) of two tables joined by equalities and one inequality, without making the pairs.

        Places (keys and value) of both tables are counted and sorted, and each row is met by
        the running count of those below it.  None where the query is of another form.
        """
        nodes = [n for e in exprs for n in _nodes(e)]
        counts = [n for n in nodes if isinstance(n, A.Call) and n.name in AGGREGATES]
        if len(refs) != 2 or refs[1][1] != "inner" or s.group or s.order or scope.new_old or any(self.engine.source(r.name).fts is not None for r, _, _ in refs):
            return None
        if any(c.name != "COUNT" or c.args for c in counts) or any(isinstance(n, (A.Column, A.Subquery)) for n in nodes):
            return None
        low, keys, bounds, kept = Lowerer(scope), [], [], list(parts)
        for e in [*_conjuncts(refs[1][2]), *_conjuncts(s.where)]:
            if (at := _side(e, scope)) is not None:
                kept[at] = kept[at].where(low.truth(e))
                continue
            if not isinstance(e, A.Binary) or e.op not in ("=", "<", "<=", ">", ">="):
                return None
            left, right = _side(e.left, scope), _side(e.right, scope)
            if {left, right} != {0, 1} or (pair := low.plain_pair(low.lower(e.left), low.lower(e.right))) is None:
                return None
            by_side = pair if left == 0 else pair[::-1]
            if e.op == "=":
                keys.append(by_side)
            else:
                bounds.append((by_side, left if e.op[0] == "<" else right, e.op[1:] == "="))
        if len(bounds) != 1:
            return None
        values, below, equal = bounds[0]
        names = [f"k{j}" for j in range(len(keys))]
        rows = []
        for i, part in enumerate(kept):
            place = [k[i].alias(n) for k, n in zip([*keys, values], [*names, "v"], strict=True)]
            part = part.select(*place, F.lit(int(i == below)).cast("long").alias("lows"), F.lit(int(i != below)).cast("long").alias("highs"))
            for n in (*names, "v"):
                part = part.where(F.col(n).isNotNull())
            rows.append(part)
        places = rows[0].union(rows[1]).groupBy(*names, "v").agg(F.sum("lows").alias("lows"), F.sum("highs").alias("highs"))
        # a key's places lie in as many runs as they fill, so a frequent key is not one task's
        runs = places.repartitionByRange(*names, "v").withColumn("run", F.spark_partition_id())
        inside = Window.partitionBy("run", *names).orderBy("v").rowsBetween(Window.unboundedPreceding, 0 if equal else -1)
        met = F.col("highs") * F.coalesce(F.sum("lows").over(inside), F.lit(0))
        sums = runs.withColumn("met", met).groupBy("run", *names).agg(*[F.sum(n).alias(n) for n in ("met", "lows", "highs")])
        before = Window.partitionBy(*names).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
        met = F.col("met") + F.col("highs") * F.coalesce(F.sum("lows").over(before), F.lit(0))
        out = sums.select(met.alias("met")).agg(F.coalesce(F.sum("met"), F.lit(0)).alias("a0"))
        return out, Scope(params=self.params, slots={c: Typed(F.col("a0"), "INT") for c in counts}), []

    def aggregated(self, s: A.Select, df: DataFrame, scope: Scope, order: list, exprs: list) -> tuple[DataFrame, Scope, list]:
        low = Lowerer(scope)
        inner = Scope(params=self.params, slots=dict(scope.slots), new_old=self.new_old)
        rank = F.struct(*order) if order else None
        keys, aggs, key_of = [], [], {}
        first = lambda c: F.min_by(c, rank) if rank is not None else F.first(c)
        for i, g in enumerate(s.group):
            if any(c.name in AGGREGATES for c in _walk(g)):
                raise SyntaxFault("aggregates in GROUP BY")
            t = as_int(low.lower(g))
            nocase = t.collation == "NOCASE" and t.cls == "TEXT"
            keys.append((C.fold(t.col) if nocase else t.col).alias(f"k{i}"))
            if nocase:
                aggs.append(first(t.col).alias(f"v{i}"))
            slot = replace(t, col=F.col(f"v{i}" if nocase else f"k{i}"), const=NOT_CONSTANT)
            inner.slots[g] = slot
            if isinstance(g, A.Column):
                key_of[str(t.col)] = slot
        seen: dict = {}

        def bare(c: A.Column) -> Typed:
            t = as_int(scope.resolve(c))
            if str(t.col) in key_of:
                return key_of[str(t.col)]
            name = seen.get(str(t.col))
            if name is None:
                name = seen[str(t.col)] = f"b{len(seen)}"
                aggs.append(first(t.col).alias(name))
            return replace(t, col=F.col(name))

        for e in exprs:
            for c in _walk(e):
                if c.name in AGGREGATES and c not in inner.slots:
                    name = f"a{len(inner.slots)}"
                    col, cls = self.aggregate(c, low, rank)
                    aggs.append(col.alias(name))
                    inner.slots[c] = Typed(F.col(name), cls)
        for c, t in scope.slots.items():  # a score outside of aggregates is its group's first
            name = f"f{len(seen)}"
            seen[name] = name
            aggs.append(first(t.col).alias(name))
            inner.slots[c] = replace(t, col=F.col(name))
        inner.bare = bare
        outside = Lowerer(inner)
        for e in exprs:  # finds the bare columns
            if not (isinstance(e, A.Column) and e.table is None and e in [o.expr for o in s.order] and self.is_alias(e, s)):
                outside.lower(e)
        if rank is not None:
            aggs.append(F.min(rank).alias("first_row"))
        if keys and scope.outer is not None:
            raise Unsupported("GROUP BY in a correlated subquery")
        # without keys a plain select: it is analyzed late enough to see an outer query's columns
        out = df.groupBy(*keys).agg(*aggs) if keys else df.select(*(aggs or [F.count("*").alias("none")]))
        if s.having is not None:
            out = out.where(outside.truth(s.having))
        return out, inner, [F.col("first_row")] if rank is not None else []

    def is_alias(self, e: A.Column, s: A.Select) -> bool:
        return any(i.alias and i.alias.lower() == e.name.lower() for i in s.items)

    def aggregate(self, c: A.Call, low: Lowerer, rank: Column | None) -> tuple[Column, str]:
        if c.name == "COUNT":
            if c.star or not c.args:
                return F.count(F.lit(1)), "INT"
            return F.count(to_one(low.lower(c.args[0]))), "INT"
        if len(c.args) != (2 if c.name == "JSON_GROUP_OBJECT" else 1):
            raise SyntaxFault(f"wrong number of arguments to {c.name}")
        ts = [low.lower(a) for a in c.args]
        if c.name == "SUM":
            t = number_of(ts[0])
            if t.cls == "NULL":
                return F.sum(F.lit(None).cast("long")), "INT"
            return F.sum(t.col.cast("long" if t.cls == "INT" else "double")), t.cls
        parts = [low.json_value(t) for t in ts]
        if c.name == "JSON_GROUP_OBJECT":
            if ts[0].cls != "TEXT":
                raise SyntaxFault("labels of json_group_object must be TEXT")
            value, ends = F.concat(parts[0], F.lit(":"), parts[1]), ("{", "}")
        else:
            value, ends = parts[0], ("[", "]")
        rows = F.collect_list(F.struct(*([rank.alias("r")] if rank is not None else []), value.alias("v")))
        rows = F.array_sort(rows) if rank is not None else rows
        return F.concat(F.lit(ends[0]), F.array_join(F.transform(rows, lambda x: x["v"]), ","), F.lit(ends[1])), "TEXT"

    # --- subqueries and compounds

    def subquery(self, e: A.Subquery, scope: Scope) -> Typed:
        if scope.outer is not None:
            raise Unsupported("subqueries inside subqueries")
        s = e.select
        many = not (s.group or any(c.name in AGGREGATES for i in s.items if i.expr is not None for c in _walk(i.expr)))
        if s.group or (many and s.limit is None):
            s = replace(s, limit=A.Literal(1))  # the first row counts
        keep, self.keep_order = self.keep_order, False
        q = self.select(s, scope)
        self.keep_order = keep
        t = q.types[0]
        return Typed(q.df.select("o0").scalar(), t.cls)

    def compound(self, c: A.Compound) -> Query:
        keep, self.keep_order = self.keep_order, False
        arms = [self.select(a) for a in c.arms]
        self.keep_order = keep
        n = len(arms[0].names)
        if any(len(a.names) != n for a in arms):
            raise SyntaxFault("the arms of a UNION have different numbers of columns")
        classes = [unify([a.types[i] for a in arms]) for i in range(n)]
        frames = [a.df.select(*[to_class(t, k).alias(f"o{i}") if k != "NULL" else F.lit(None).cast("string").alias(f"o{i}") for i, (t, k) in enumerate(zip(a.types, classes, strict=True))]) for a in arms]
        folds = [t.collation == "NOCASE" and k == "TEXT" for t, k in zip(arms[0].types, classes, strict=True)]
        df = frames[0]
        for op, f in zip(c.ops, frames[1:], strict=True):
            df = df.union(f)
            if op == "union":
                if any(folds):
                    keys = [C.fold(F.col(f"o{i}")).alias(f"g{i}") if x else F.col(f"o{i}").alias(f"g{i}") for i, x in enumerate(folds)]
                    df = df.groupBy(*keys).agg(F.first(F.struct("*")).alias("w")).select("w.*")
                else:
                    df = df.distinct()
        names = arms[0].names
        types = [replace(t, col=F.col(f"o{i}"), cls=k, const=NOT_CONSTANT) for i, (t, k) in enumerate(zip(arms[0].types, classes, strict=True))]
        keys = []
        for o in c.order:
            if isinstance(o.expr, A.Literal) and isinstance(o.expr.value, int):
                if not 1 <= o.expr.value <= n:
                    raise SyntaxFault(f"ORDER BY position {o.expr.value} is out of range")
                keys.append((types[o.expr.value - 1], o.desc))
            elif isinstance(o.expr, A.Column) and o.expr.table is None:
                at = [i for i, x in enumerate(names) if x.lower() == o.expr.name.lower()]
                if not at:
                    raise NameFault(f"ORDER BY {o.expr.name} is no column of the result")
                keys.append((types[at[0]], o.desc))
            else:
                raise Unsupported("compound ORDER BY expression")
        return self.shaped(df, names, types, keys, [], False, self.bound(c.limit), self.bound(c.offset))


def to_one(t: Typed) -> Column:
    return t.col if t.cls != "NULL" else F.lit(None).cast("long")


def _walk(e):
    """Calls inside an expression, outside of subqueries."""
    if isinstance(e, A.Call):
        yield e
    if isinstance(e, A.Expr):
        for k in _kids(e):
            yield from _walk(k)


def _nodes(e: A.Expr):
    """An expression and all inside it, outside of subqueries."""
    yield e
    for k in _kids(e):
        yield from _nodes(k)


def _conjuncts(e: A.Expr | None):
    if isinstance(e, A.Binary) and e.op == "AND":
        yield from _conjuncts(e.left)
        yield from _conjuncts(e.right)
    elif e is not None:
        yield e


def _side(e: A.Expr, scope: Scope) -> int | None:
    """The number of the only source whose columns e has; None where it has subqueries, no columns or other ones."""
    found = set()
    for n in _nodes(e):
        if isinstance(n, (A.Subquery, A.Match)):
            return None
        if isinstance(n, A.Column):
            at = [i for i, (q, cols, _) in enumerate(scope.sources) if n.name.lower() in cols and (n.table is None or n.table.lower() == q.lower())]
            found.update(at or [None])
    return found.pop() if len(found) == 1 else None


def _calls(s: A.Select):
    for e in [i.expr for i in s.items] + [s.where, s.having, *s.group] + [o.expr for o in s.order] + [j.on for j in s.joins]:
        if e is not None:
            yield from _walk(e)


def _mentions_rank(s: A.Select, qualifier: str) -> bool:
    def has(e) -> bool:
        if isinstance(e, A.Column):
            return e.name.lower() == "rank" and (e.table is None or e.table.lower() == qualifier.lower())
        return isinstance(e, A.Expr) and any(has(k) for k in _kids(e))

    if any(i.expr is None for i in s.items):
        return True
    return any(has(e) for e in [i.expr for i in s.items] + [s.where, s.having, *s.group] + [o.expr for o in s.order] + [j.on for j in s.joins] if e is not None)


__all__ = ["Query", "Selector", "Source", "constant", "text_of"]
