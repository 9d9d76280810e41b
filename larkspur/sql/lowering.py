"""Expressions of the dialect as typed Spark Columns.

Every column has a declared class, so affinities and collations are known when the
plan is built: comparisons become plain Column operators wherever both sides have one
class, which lets filters reach the scan.  Constant subtrees are evaluated here, once.

A column has one class.  Where an expression could yield several (arms of CASE,
COALESCE, what a JSON path leads to), numbers of both kinds become REAL and any other
mixture TEXT.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import MatchFault, NameFault, ParameterFault, SyntaxFault, Unsupported
from ..functions import columns as C
from ..functions import jsons
from ..functions import values as V
from . import ast as A

NOT_CONSTANT = object()


@dataclass
class Typed:
    col: Column | None
    cls: str  # INT, REAL, TEXT, BLOB, NULL, BOOL or JSON (what a path leads to)
    affinity: str | None = None
    collation: str | None = None
    explicit: bool = False
    const: Any = NOT_CONSTANT
    number: Column | None = None  # of JSON
    is_text: Column | None = None
    parts: Column | None = None  # the struct that col, number and is_text are taken from

    def once(self, f: Callable[[Typed], Column]) -> Column:
        """f of this value; a JSON path is followed once for all that f asks of it."""
        if self.parts is None:
            return f(self)
        return C.let(self.parts, lambda s: f(replace(self, col=s["text"], number=s["number"], is_text=s["is_text"], parts=None)))


def constant(v: Any) -> Typed:
    v = int(v) if isinstance(v, bool) else v
    if v is None:
        return Typed(F.lit(None).cast("long"), "NULL", const=None)
    if isinstance(v, int):
        return Typed(F.lit(v).cast("long") if abs(v) < 1 << 31 else F.lit(v), "INT", const=v)
    if isinstance(v, float):
        return Typed(F.lit(v), "REAL", const=v)
    return Typed(F.lit(v) if isinstance(v, str) else F.lit(bytearray(v)), "TEXT" if isinstance(v, str) else "BLOB", const=v)


def as_int(t: Typed) -> Typed:
    return Typed(t.col.cast("long"), "INT") if t.cls == "BOOL" else t


def text_of(t: Typed) -> Column:
    if t.const is not NOT_CONSTANT:
        return F.lit(V.text(t.const)).cast("string")
    t = as_int(t)
    return {"INT": lambda c: c.cast("string"), "REAL": C.real_text, "NULL": lambda c: F.lit(None).cast("string"), "BLOB": lambda c: c.cast("string")}.get(t.cls, lambda c: c)(t.col)


def number_of(t: Typed) -> Typed:
    """INT or REAL: what arithmetic takes."""
    if t.const is not NOT_CONSTANT:
        return constant(V.number(t.const))
    t = as_int(t)
    if t.cls in ("INT", "REAL", "NULL"):
        return t
    c = t.col.cast("string") if t.cls == "BLOB" else t.col
    return Typed(t.once(lambda x: F.coalesce(x.number, C.prefix_real(x.col))) if t.cls == "JSON" else C.prefix_real(c), "REAL")


def truth_of(t: Typed) -> Column:
    if t.const is not NOT_CONSTANT:
        return F.lit(V.truth(t.const)).cast("boolean")
    if t.cls == "BOOL":
        return t.col
    if t.cls == "BLOB":
        return F.when(t.col.isNotNull(), F.lit(False))
    return number_of(t).col != 0


def unify(ts: list[Typed]) -> str:
    classes = {("INT" if t.cls == "BOOL" else "TEXT" if t.cls == "JSON" else t.cls) for t in ts} - {"NULL"}
    if not classes:
        return "NULL"
    if len(classes) == 1:
        return classes.pop()
    return "REAL" if classes == {"INT", "REAL"} else "TEXT"


def to_class(t: Typed, cls: str) -> Column:
    if t.cls == "NULL" or t.const is None:
        return F.lit(None).cast({"INT": "long", "REAL": "double", "TEXT": "string", "BLOB": "binary", "NULL": "long"}[cls])
    if cls == "TEXT":
        return text_of(t)
    t = as_int(t)
    return t.col.cast("double") if cls == "REAL" and t.cls == "INT" else t.col


@dataclass
class Scope:
    """What names mean: sources are (qualifier, {folded column name: Typed}, columns in order)."""

    sources: list = field(default_factory=list)
    params: tuple | dict = ()
    outer: Scope | None = None
    subquery: Callable | None = None
    slots: dict = field(default_factory=dict)  # aggregate calls and group keys, by their ast
    bare: Callable | None = None  # a column outside of aggregates
    scores: dict = field(default_factory=dict)  # full-text tables' scores, by table name
    new_old: dict = field(default_factory=dict)  # NEW and OLD of a trigger: {("new", column): value}

    def resolve(self, c: A.Column) -> Typed:
        if c.table and (key := (c.table.lower(), c.name.lower())) in self.new_old:
            return constant(self.new_old[key])
        name, found = c.name.lower(), []
        for qualifier, cols, _ in self.sources:
            if (c.table is None or c.table.lower() == qualifier.lower()) and name in cols:
                found.append(cols[name])
        if len(found) == 1:
            return found[0]
        label = f"{c.table}.{c.name}" if c.table else c.name
        if found:
            raise NameFault(f"ambiguous column: {label}")
        if self.outer is not None:
            t = self.outer.resolve(c)
            return t if t.const is not NOT_CONSTANT else replace(t, col=t.col.outer())
        raise NameFault(f"no such column: {label}")


class Lowerer:
    def __init__(self, scope: Scope):
        self.scope = scope

    # --- constants

    def value(self, e: A.Expr) -> Any:
        """The value of a subtree of literals and parameters, or NOT_CONSTANT."""
        if isinstance(e, A.Literal):
            return e.value
        if isinstance(e, A.Param):
            return self.param(e)
        if isinstance(e, A.Column) and e.table and (k := (e.table.lower(), e.name.lower())) in self.scope.new_old:
            return self.scope.new_old[k]
        if isinstance(e, (A.Column, A.Subquery, A.Match)) or e in self.scope.slots:
            return NOT_CONSTANT
        if isinstance(e, A.Call) and (e.name in ("COUNT", "SUM", "JSON_GROUP_ARRAY", "JSON_GROUP_OBJECT", "BM25", "DATETIME") or e.name not in _ARITY):
            return NOT_CONSTANT
        kids = _kids(e)
        got = [self.value(k) for k in kids]
        if any(v is NOT_CONSTANT for v in got):
            return NOT_CONSTANT
        return self.fold(e)

    def param(self, p: A.Param) -> Any:
        given = self.scope.params
        if isinstance(given, dict):
            if p.name is None or p.name not in given:
                raise ParameterFault(f"no value for parameter {p.name or p.index}")
            return _plain(given[p.name])
        if p.index > len(given):
            raise ParameterFault(f"no value for parameter {p.name or p.index}")
        return _plain(given[p.index - 1])

    def fold(self, e: A.Expr) -> Any:
        v = self.value
        flag = lambda b: None if b is None else int(b)
        if isinstance(e, A.Unary):
            return V.negate(v(e.arg)) if e.op == "-" else flag(None if (t := V.truth(v(e.arg))) is None else not t)
        if isinstance(e, A.Binary):
            a, b = v(e.left), v(e.right)
            if e.op in ("AND", "OR"):
                x, y = V.truth(a), V.truth(b)
                stop = e.op == "OR"
                return int(stop) if stop in (x, y) else None if None in (x, y) else int(not stop)
            if e.op in "+-*/%":
                return V.arithmetic(e.op, a, b)
            if e.op == "||":
                return None if a is None or b is None else V.text(a) + V.text(b)
            if e.op in ("->", "->>"):
                return jsons.FUNCTIONS[e.op](a, b)
            return flag(self.compare_values(e.op, e.left, e.right, a, b))
        if isinstance(e, A.IsNull):
            return int((v(e.arg) is None) != e.negated)
        if isinstance(e, A.Like):
            r = V.like(v(e.arg), v(e.pattern))
            return None if r is None else int(r != e.negated)
        if isinstance(e, A.In):
            hits = [self.compare_values("=", e.arg, i, v(e.arg), v(i)) for i in e.items]
            r = True if True in hits else None if None in hits else False
            return None if r is None else int(r != e.negated)
        if isinstance(e, A.InJsonEach):
            a, vs = v(e.arg), jsons.each(v(e.json))
            hits = [None if a is None or x is None else V.compare(a, x, self.collation(e.arg, e.arg) == "NOCASE") == 0 for x in vs]
            r = True if True in hits else None if None in hits else False
            return None if r is None else int(r != e.negated)
        if isinstance(e, A.Case):
            for cond, out in e.arms:
                if e.subject is None:
                    hit = V.truth(v(cond))
                else:
                    a, b = v(e.subject), v(cond)
                    hit = a is not None and b is not None and V.compare(a, b, self.collation(e.subject, cond) == "NOCASE") == 0
                if hit:
                    return v(out)
            return v(e.other) if e.other is not None else None
        if isinstance(e, A.Cast):
            return V.cast(v(e.arg), e.type)
        if isinstance(e, A.Collate):
            return v(e.arg)
        self.arity(e)
        args = [v(a) for a in e.args]
        return _SCALAR[e.name](*args)

    def compare_values(self, op: str, left: A.Expr, right: A.Expr, a: Any, b: Any) -> bool | None:
        if a is None or b is None:
            return None
        fa, fb = _affinity(left), _affinity(right)
        a, b = _apply(a, fa, fb), _apply(b, fb, fa)
        c = V.compare(a, b, self.collation(left, right) == "NOCASE")
        return {"=": c == 0, "<>": c != 0, "<": c < 0, "<=": c <= 0, ">": c > 0, ">=": c >= 0}[op]

    def collation(self, left: A.Expr, right: A.Expr) -> str:
        for e in (left, right):
            if isinstance(e, A.Collate):
                return e.name
        return "BINARY"

    def arity(self, e: A.Call) -> None:
        if e.name not in _ARITY:
            raise NameFault(f"no such function: {e.name}")
        lo, hi = _ARITY[e.name]
        if not lo <= len(e.args) <= hi:
            raise SyntaxFault(f"wrong number of arguments to {e.name}")

    # --- columns

    def lower(self, e: A.Expr) -> Typed:
        if e in self.scope.slots:
            return self.scope.slots[e]
        v = self.value(e)
        if v is not NOT_CONSTANT:
            t = constant(v)
            t.affinity = _affinity(e)
            if isinstance(e, A.Collate):
                t.collation, t.explicit = e.name, True
            return t
        return getattr(self, "_" + type(e).__name__.lower())(e)

    def truth(self, e: A.Expr) -> Column:
        return truth_of(self.lower(e))

    def _column(self, e: A.Column) -> Typed:
        return self.scope.bare(e) if self.scope.bare else self.scope.resolve(e)

    def _collate(self, e: A.Collate) -> Typed:
        return replace(self.lower(e.arg), collation=e.name, explicit=True)

    def _unary(self, e: A.Unary) -> Typed:
        if e.op == "NOT":
            return Typed(~self.truth(e.arg), "BOOL")
        t = number_of(self.lower(e.arg))
        return Typed(F.lit(0.0) - t.col if t.cls == "REAL" else -t.col, t.cls)

    def _binary(self, e: A.Binary) -> Typed:
        if e.op in ("AND", "OR"):
            a, b = self.truth(e.left), self.truth(e.right)
            return Typed(a & b if e.op == "AND" else a | b, "BOOL")
        if e.op in ("->", "->>"):
            return self.arrow(e)
        a, b = self.lower(e.left), self.lower(e.right)
        if e.op == "||":
            return Typed(F.concat(text_of(a), text_of(b)), "TEXT")
        if e.op in "+-*/%":
            return self.arithmetic(e.op, a, b)
        return Typed(self.compare(e.op, a, b), "BOOL")

    def arithmetic(self, op: str, a: Typed, b: Typed) -> Typed:
        if op == "%":
            real = number_of(a).cls == "REAL" or number_of(b).cls == "REAL"
            r = C.modulo_int(self.cast(a, "INTEGER").col, self.cast(b, "INTEGER").col)
            return Typed(r.cast("double"), "REAL") if real else Typed(r, "INT")
        a, b = number_of(a), number_of(b)
        if "NULL" in (a.cls, b.cls):
            return constant(None)
        whole = a.cls == b.cls == "INT"
        if op == "/":
            return Typed(C.divide_int(a.col.cast("long"), b.col.cast("long")), "INT") if whole else Typed(F.nanvl(F.try_divide(a.col.cast("double"), b.col.cast("double")), F.lit(None)), "REAL")
        kind = "long" if whole else "double"
        x, y = a.col.cast(kind), b.col.cast(kind)
        r = {"+": x + y, "-": x - y, "*": x * y}[op]
        return Typed(r, "INT") if whole else Typed(F.nanvl(r, F.lit(None)), "REAL")

    def compare(self, op: str, a: Typed, b: Typed, affinity: bool = True) -> Column:
        a, b = as_int(a), as_int(b)
        if "NULL" in (a.cls, b.cls):
            return F.lit(None).cast("boolean")
        if a.parts is not None or b.parts is not None:
            exact = a.once(lambda x: b.once(lambda y: self.compare(op, x, y, affinity)))
            j, other = (a, b) if a.cls == "JSON" else (b, a)
            if other.cls in ("INT", "REAL") and other.const is NOT_CONSTANT:
                return _keyed(op, F.coalesce(j.number, C.fully_numeric(j.col)), other.col.cast("double"), exact)
            plain = other.cls == "TEXT" and other.const is NOT_CONSTANT and "NOCASE" not in (a.collation, b.collation)
            return _keyed(op, j.col, other.col, exact) if plain else exact
        nocase = self.nocase(a, b)
        if affinity:
            a, b = self.convert(a, b), self.convert(b, a)
        if "JSON" in (a.cls, b.cls):
            return self.compare_json(op, a, b, nocase)
        num = {"INT", "REAL"}
        if a.cls in num and b.cls in num:
            return _numbers(op, a, b)
        if a.cls == b.cls:
            x, y = (C.fold(a.col), C.fold(b.col)) if nocase and a.cls == "TEXT" else (a.col, b.col)
            return _OPS[op](x, y)
        # a text that its affinity made a number where it could: MAYBE is (number or null, text)
        if "MAYBE" in (a.cls, b.cls):
            flip = b.cls != "MAYBE"
            m, other = (a, b) if flip else (b, a)
            as_number = lambda t: _numbers(op, t, other) if flip else _numbers(op, other, t)
            # a text of digits is an integer, which a double may not hold
            whole = m.col.try_cast("long")
            hit = F.when(whole.isNotNull(), as_number(Typed(whole, "INT"))).otherwise(as_number(Typed(m.number, "REAL")))
            rank = V.compare("", 0) if flip else V.compare(0, "")
            exact = F.when(m.col.isNull() | other.col.isNull(), F.lit(None)).when(m.number.isNotNull(), hit).otherwise(F.lit(_by_sign(op, rank)))
            return _keyed(op, m.number, other.col.cast("double"), exact) if other.const is NOT_CONSTANT else exact
        rank = {"INT": 1, "REAL": 1, "TEXT": 2, "BLOB": 3}
        known = F.lit(_by_sign(op, -1 if rank[a.cls] < rank[b.cls] else 1))
        return F.when(a.col.isNotNull() & b.col.isNotNull(), known)

    def nocase(self, a: Typed, b: Typed) -> bool:
        return (a.collation if a.explicit else b.collation if b.explicit else a.collation or b.collation) == "NOCASE"

    def plain_pair(self, a: Typed, b: Typed) -> tuple[Column, Column] | None:
        """Columns of one type that Spark compares as compare() does a and b, or None where it takes more than that."""
        a, b = as_int(a), as_int(b)
        nocase = self.nocase(a, b)
        a, b = self.convert(a, b), self.convert(b, a)
        kind = {"INT": "long", "REAL": "double", "TEXT": "string", "BLOB": "binary"}.get(a.cls)
        if a.cls != b.cls or kind is None:
            return None
        x, y = (C.fold(a.col), C.fold(b.col)) if nocase and a.cls == "TEXT" else (a.col, b.col)
        return x.cast(kind), y.cast(kind)

    def convert(self, t: Typed, other: Typed) -> Typed:
        """The affinity that the other side puts on this one."""
        numeric = ("INTEGER", "REAL")
        if other.affinity in numeric and t.affinity not in numeric:
            if t.cls == "TEXT":
                if t.const is not NOT_CONSTANT:
                    n = V.fully_numeric(t.const)
                    return t if n is None else constant(n)
                return Typed(t.col, "MAYBE", number=C.fully_numeric(t.col))
            if t.cls == "JSON":
                return replace(t, parts=None, number=F.coalesce(t.number, C.fully_numeric(t.col)), is_text=t.is_text & C.fully_numeric(t.col).isNull())
        if other.affinity == "TEXT" and t.affinity is None and t.cls in ("INT", "REAL"):
            return Typed(text_of(t), "TEXT", collation=t.collation, explicit=t.explicit, const=V.text(t.const) if t.const is not NOT_CONSTANT else NOT_CONSTANT)
        if other.affinity == "TEXT" and t.affinity is None and t.cls == "JSON":
            return Typed(t.col, "TEXT")
        return t

    def compare_json(self, op: str, a: Typed, b: Typed, nocase: bool) -> Column:
        if a.cls == b.cls:
            both = F.when(a.number.isNotNull() & b.number.isNotNull(), _OPS[op](a.number, b.number))
            rank = lambda t: F.when(t.number.isNotNull(), 1).otherwise(2)
            return F.when(a.col.isNull() | b.col.isNull(), F.lit(None)).otherwise(F.coalesce(both, F.when(rank(a) == rank(b), _OPS[op](a.col, b.col)).otherwise(_OPS[op](rank(a), rank(b)))))
        flip = a.cls == "JSON"
        j, other = (a, b) if flip else (b, a)
        pair = lambda x, y: _OPS[op](x, y) if flip else _OPS[op](y, x)
        null = j.col.isNull() | other.col.isNull()
        if other.cls in ("INT", "REAL"):
            rank = V.compare("", 0) if flip else V.compare(0, "")
            return F.when(null, F.lit(None)).when(j.number.isNotNull(), pair(j.number, other.col.cast("double"))).otherwise(F.lit(_by_sign(op, rank)))
        if other.cls == "TEXT":
            x, y = (C.fold(j.col), C.fold(other.col)) if nocase else (j.col, other.col)
            rank = V.compare(0, "") if flip else V.compare("", 0)
            return F.when(null, F.lit(None)).when(j.is_text, pair(x, y)).otherwise(F.lit(_by_sign(op, rank)))
        return F.when(~null, F.lit(_by_sign(op, -1 if flip else 1)))

    def _isnull(self, e: A.IsNull) -> Typed:
        c = self.lower(e.arg).col
        return Typed(c.isNotNull() if e.negated else c.isNull(), "BOOL")

    def _like(self, e: A.Like) -> Typed:
        a, p = self.lower(e.arg), self.lower(e.pattern)
        if "NULL" in (a.cls, p.cls):
            return constant(None)
        hit = C.like_constant(text_of(a), V.text(p.const)) if p.const is not NOT_CONSTANT else C.like(text_of(a), text_of(p))
        return Typed(~hit if e.negated else hit, "BOOL")

    def _in(self, e: A.In) -> Typed:
        if not e.items:
            return constant(int(e.negated))
        a = self.lower(e.arg)
        items = [replace(self.lower(i), affinity=None, collation=None) for i in e.items]
        plain = all(i.const is not NOT_CONSTANT and i.const is not None for i in items) and a.collation != "NOCASE"
        same = a.cls in ("INT", "TEXT") and all(i.cls == a.cls for i in items)
        if plain and same:
            hit = a.col.isin([i.const for i in items])
        else:
            hits = [self.compare("=", a, i) for i in items]
            hit = hits[0]
            for h in hits[1:]:
                hit = hit | h
        return Typed(~hit if e.negated else hit, "BOOL")

    def _injsoneach(self, e: A.InJsonEach) -> Typed:
        a, j = self.lower(e.arg), self.lower(e.json)
        if j.const is not NOT_CONSTANT:
            values = jsons.each(j.const)
            if not values:
                return constant(int(e.negated))
            hits = [self.compare("=", replace(a, affinity=None), constant(v)) for v in values]
            hit = hits[0]
            for h in hits[1:]:
                hit = hit | h
        else:
            doc = F.try_parse_json(text_of(j))
            kind = F.schema_of_variant(doc)
            members = F.when(kind.startswith("OBJECT"), F.map_values(F.try_variant_get(doc, "$", "map<string,variant>"))).when(kind.startswith("ARRAY"), F.try_variant_get(doc, "$", "array<variant>")).otherwise(F.array(doc))
            a = as_int(a)
            def same(v):
                k, word = F.schema_of_variant(v), v.cast("string")
                if a.cls in ("INT", "REAL"):
                    n = F.when(k == "BOOLEAN", F.when(word == "true", 1.0).otherwise(0.0)).when(k != "STRING", word.try_cast("double"))
                    return F.when(k == "VOID", F.lit(None)).otherwise(F.coalesce(n == a.col.cast("double"), F.lit(False)))
                x, y = (C.fold(word), C.fold(a.col)) if a.collation == "NOCASE" else (word, a.col)
                return F.when(k == "VOID", F.lit(None)).otherwise((k == "STRING") & (x == y))
            hit = F.when(doc.isNull(), F.lit(False)).when(F.size(members) == 0, F.lit(False)).when(a.col.isNull(), F.lit(None)).otherwise(F.exists(members, same))
        return Typed(~hit if e.negated else hit, "BOOL")

    def _case(self, e: A.Case) -> Typed:
        outs = [self.lower(o) for _, o in e.arms] + [self.lower(e.other) if e.other is not None else constant(None)]
        cls = unify(outs)
        subject = self.lower(e.subject) if e.subject is not None else None
        col = None
        for (cond, _), out in zip(e.arms, outs, strict=False):
            if subject is None:
                hit = self.truth(cond)
            else:
                hit = self.compare("=", replace(subject, affinity=None), replace(self.lower(cond), affinity=None), affinity=False)
            c = to_class(out, cls)
            col = F.when(hit, c) if col is None else col.when(hit, c)
        return Typed(col.otherwise(to_class(outs[-1], cls)), cls)

    def _cast(self, e: A.Cast) -> Typed:
        return self.cast(self.lower(e.arg), e.type)

    def cast(self, t: Typed, kind: str) -> Typed:
        if t.const is not NOT_CONSTANT:
            return replace(constant(V.cast(t.const, kind)), affinity=kind)
        t = as_int(t)
        if kind == "TEXT":
            return Typed(text_of(t), "TEXT", "TEXT")
        if kind == "BLOB":
            return Typed(t.col if t.cls == "BLOB" else text_of(t).cast("binary"), "BLOB", "BLOB")
        if kind == "REAL":
            return Typed(number_of(t).col.cast("double"), "REAL", "REAL")
        if t.cls == "INT":
            return Typed(t.col, "INT", "INTEGER")
        if t.cls == "REAL":
            return Typed(C.real_to_int(t.col), "INT", "INTEGER")
        if t.cls == "JSON":  # numbers are cut toward zero, texts give their leading digits
            return Typed(t.once(lambda x: F.when(~x.is_text & x.number.isNotNull(), C.real_to_int(x.number)).otherwise(C.text_to_int(x.col))), "INT", "INTEGER")
        return Typed(C.text_to_int(t.col.cast("string") if t.cls == "BLOB" else t.col), "INT", "INTEGER")

    def _subquery(self, e: A.Subquery) -> Typed:
        if self.scope.subquery is None:
            raise Unsupported("a subquery here")
        return self.scope.subquery(e, self.scope)

    def _match(self, e: A.Match) -> Typed:
        raise MatchFault("MATCH is only allowed as a conjunct of WHERE or ON, on a full-text table")

    def arrow(self, e: A.Binary) -> Typed:
        doc, p = self.lower(e.left), self.value(e.right)
        if p is NOT_CONSTANT:
            return Typed(C.json_call(e.op, [text_of(doc), text_of(self.lower(e.right))], False), "TEXT")
        if p is None:
            return constant(None)
        steps = jsons.arrow_path(p)
        if e.op == "->>" and not any(isinstance(s, tuple) for s in steps):
            path = "$" + "".join(f"[{s}]" if isinstance(s, int) else f".{s}" for s in steps)
            if C.simple_path(path):
                return self.found(doc, path)
        return Typed(C.json_call(e.op, [text_of(doc), F.lit(p)], False), "TEXT")

    def found(self, doc: Typed, path: str) -> Typed:
        parts = C.json_parts(text_of(doc), path)
        return Typed(parts["text"], "JSON", number=parts["number"], is_text=parts["is_text"], parts=parts)

    def _call(self, e: A.Call) -> Typed:
        n = e.name
        if n in ("COUNT", "SUM", "JSON_GROUP_ARRAY", "JSON_GROUP_OBJECT"):
            raise SyntaxFault(f"{n} is not allowed here")
        if n == "BM25":
            raise MatchFault("bm25 needs a full-text table that the query matches")
        self.arity(e)
        if n == "DATETIME":
            if [self.value(a) for a in e.args] != ["now"]:
                raise Unsupported("DATETIME other than DATETIME('now')")
            return Typed(F.lit(now_text()), "TEXT")
        ts = [self.lower(a) for a in e.args]
        if n == "COALESCE":
            cls = unify(ts)
            return Typed(F.coalesce(*[to_class(t, cls) for t in ts]), cls) if cls != "NULL" else constant(None)
        if n.startswith("JSON"):
            return self.json(n, e, ts)
        if any(t.cls == "NULL" for t in ts):
            return constant(None)
        if n in ("LOWER", "UPPER"):
            return Typed((C.fold if n == "LOWER" else C.upper)(text_of(ts[0])), "TEXT")
        if n == "LENGTH":
            return Typed((F.octet_length(ts[0].col) if ts[0].cls == "BLOB" else F.length(text_of(ts[0]))).cast("long"), "INT")
        if n == "INSTR":
            return Typed(C.instr(text_of(ts[0]), text_of(ts[1])), "INT")
        whole = [self.cast(t, "INTEGER").col for t in ts[1:]]
        if ts[0].cls == "BLOB":
            return Typed(F.unhex(C.substr(F.hex(ts[0].col), whole[0] * 2 - F.when(whole[0] > 0, 1).otherwise(0), whole[1] * 2 if len(whole) > 1 else None)), "BLOB")
        return Typed(C.substr(text_of(ts[0]), whole[0], whole[1] if len(whole) > 1 else None), "TEXT")

    def json(self, n: str, e: A.Call, ts: list[Typed]) -> Typed:
        paths = [self.value(a) for a in e.args[1:]]
        simple = all(isinstance(p, str) and C.simple_path(p) for p in paths)
        if n == "JSON_EXTRACT" and len(ts) == 2 and simple:
            return self.found(ts[0], paths[0])
        if n == "JSON_VALID":
            return Typed(C.json_valid(text_of(ts[0])), "INT")
        if n in ("JSON_QUOTE", "JSON_ARRAY", "JSON_OBJECT"):
            if any(t.cls == "BLOB" for t in ts):
                raise jsons.JsonFault("JSON cannot hold BLOB values")
            parts = [self.json_value(t) for t in ts]
            if n == "JSON_QUOTE":
                return Typed(parts[0], "TEXT")
            if n == "JSON_ARRAY":
                return Typed(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), "TEXT")
            if len(parts) % 2 or any(t.cls not in ("TEXT", "JSON") for t in ts[::2]):
                raise jsons.JsonFault("json_object needs pairs with TEXT labels")
            return Typed(F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(k, F.lit(":"), v) for k, v in zip(parts[::2], parts[1::2], strict=True)]), F.lit("}")), "TEXT")
        integer = n == "JSON_ARRAY_LENGTH"
        cols = [t.col if t.cls in ("INT", "REAL") else text_of(t) for t in ts]
        return Typed(C.json_call(n, cols, integer), "INT" if integer else "TEXT")

    def json_value(self, t: Typed) -> Column:
        t = as_int(t)
        if t.cls == "JSON":
            return t.once(lambda x: F.when(x.is_text, C.json_text(x.col, "TEXT")).otherwise(F.coalesce(x.col, F.lit("null"))))
        return C.json_text(t.col, t.cls)


def now_text() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")


def _plain(v: Any) -> Any:
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (bytearray, memoryview)):
        return bytes(v)
    if v is None or isinstance(v, (int, float, str, bytes)):
        return None if isinstance(v, float) and v != v else v
    raise ParameterFault(f"a parameter of type {type(v).__name__}")


def _kids(e: A.Expr) -> list:
    if isinstance(e, (A.Unary, A.IsNull, A.Cast, A.Collate)):
        return [e.arg]
    if isinstance(e, A.Binary):
        return [e.left, e.right]
    if isinstance(e, A.Like):
        return [e.arg, e.pattern]
    if isinstance(e, A.In):
        return [e.arg, *e.items]
    if isinstance(e, A.InJsonEach):
        return [e.arg, e.json]
    if isinstance(e, A.Case):
        return [x for x in (e.subject, e.other) if x is not None] + [x for arm in e.arms for x in arm]
    return list(e.args) if isinstance(e, A.Call) else []


def _affinity(e: A.Expr) -> str | None:
    return e.type if isinstance(e, A.Cast) else _affinity(e.arg) if isinstance(e, A.Collate) else None


def _apply(v: Any, own: str | None, other: str | None) -> Any:
    numeric = ("INTEGER", "REAL")
    if other in numeric and own not in numeric and isinstance(v, str):
        n = V.fully_numeric(v)
        return v if n is None else n
    if other == "TEXT" and own is None and isinstance(v, (int, float)):
        return V.text(v)
    return v


_OPS = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _by_sign(op: str, c: int) -> bool:
    return {"=": False, "<>": True, "<": c < 0, "<=": c < 0, ">": c > 0, ">=": c > 0}[op]


def _numbers(op: str, a: Typed, b: Typed) -> Column:
    """Integers and reals compare exactly; a plain operator where doubles are exact enough."""
    if a.cls == b.cls:
        return _OPS[op](a.col, b.col)
    for x, y, swap in ((a, b, False), (b, a, True)):
        if x.cls == "INT" and y.cls == "REAL" and y.const is not NOT_CONSTANT and abs(y.const) < 1 << 53:
            other = F.lit(int(y.const)) if y.const == int(y.const) else y.col
            return _OPS[op](other, x.col) if swap else _OPS[op](x.col, other)
        if x.cls == "INT" and x.const is not NOT_CONSTANT and abs(x.const) < 1 << 53:
            return _OPS[op](y.col, F.lit(float(x.const))) if swap else _OPS[op](F.lit(float(x.const)), y.col)
    i, r, sign = (a.col, b.col, 1) if a.cls == "INT" else (b.col, a.col, -1)
    inside = (r >= float(-(1 << 63))) & (r < float(1 << 63))
    low = F.when(inside, F.floor(F.when(inside, r))).cast("long")
    c = F.when(i.isNull() | r.isNull(), F.lit(None)).when(r >= float(1 << 63), -1).when(r < float(-(1 << 63)), 1).when(i < low, -1).when(i > low, 1).when(r > low.cast("double"), -1).otherwise(0)
    return _keyed(op, i.cast("double"), r, _OPS[op](c * sign, F.lit(0)))


def _keyed(op: str, x: Column, y: Column, exact: Column) -> Column:
    """exact, with x = y before it where that can be a join's key: it holds wherever exact does, and is null where exact is."""
    return (x == y) & exact if op == "=" else exact


_SCALAR: dict[str, Callable] = {
    "COALESCE": lambda *a: next((x for x in a if x is not None), None),
    "LOWER": lambda v: None if v is None else V.fold(V.text(v)),
    "UPPER": lambda v: None if v is None else V.upper(V.text(v)),
    "LENGTH": V.length,
    "INSTR": V.instr,
    "SUBSTR": V.substr,
    "SUBSTRING": V.substr,
    **{k: f for k, f in jsons.FUNCTIONS.items() if k.startswith("JSON")},
}
_MANY = 1 << 20
_ARITY = {
    "COALESCE": (0, _MANY), "LOWER": (1, 1), "UPPER": (1, 1), "LENGTH": (1, 1), "INSTR": (2, 2), "SUBSTR": (2, 3), "SUBSTRING": (2, 3), "DATETIME": (0, _MANY),
    "JSON_EXTRACT": (1, _MANY), "JSON_TYPE": (1, 2), "JSON_VALID": (1, 1), "JSON_ARRAY_LENGTH": (1, 2), "JSON_QUOTE": (1, 1), "JSON": (1, 1), "JSON_ARRAY": (0, _MANY), "JSON_OBJECT": (0, _MANY),
    "JSON_SET": (1, _MANY), "JSON_INSERT": (1, _MANY), "JSON_REPLACE": (1, _MANY), "JSON_REMOVE": (1, _MANY), "JSON_PATCH": (2, 2),
}
