"""The dialect's scalar functions as Spark Column expressions.

Usable from plain DataFrame code.  Only number-to-text of reals and rare JSON forms
leave the JVM, as Arrow UDFs.
"""

from __future__ import annotations

import re
import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import jsons
from . import values as V

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NUM = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"
#: Blanks that may stand around a number.
_B = r"[ \t\n\x0B\f\r]*"


def fold(c: Column) -> Column:
    return F.translate(c, _AZ, _az)


def upper(c: Column) -> Column:
    return F.translate(c, _az, _AZ)


def like(value: Column, pattern: Column) -> Column:
    """ASCII letters match in either case; there is no escape character."""
    return F.like(fold(value), fold(pattern), F.lit("\x01"))


def like_constant(value: Column, pattern: str) -> Column:
    return F.like(fold(value), F.lit(V.fold(pattern)), F.lit("\x01"))


def prefix_real(c: Column) -> Column:
    """The number that a text begins with, else 0."""
    return F.coalesce(F.regexp_extract(c, f"^{_B}({_NUM})", 1).try_cast("double"), F.when(c.isNotNull(), 0.0))


def fully_numeric(c: Column) -> Column:
    """The number that a whole text is, else null."""
    return F.regexp_extract(c, f"^{_B}({_NUM}){_B}$", 1).try_cast("double")


def text_to_int(c: Column) -> Column:
    """Leading digits, toward 64 bits; 0 without any."""
    digits = F.regexp_extract(c, f"^{_B}([-+]?\\d+)", 1)
    whole = digits.try_cast("decimal(38,0)")
    inside = F.greatest(F.least(whole, F.lit(V.HIGH).cast("decimal(38,0)")), F.lit(V.LOW).cast("decimal(38,0)"))
    beyond = F.when(digits.startswith("-"), F.lit(V.LOW)).otherwise(F.lit(V.HIGH))
    return F.when(c.isNotNull(), F.when(digits == "", F.lit(0)).otherwise(F.coalesce(inside.cast("long"), beyond)).cast("long"))


def real_to_int(c: Column) -> Column:
    return F.when(c >= float(1 << 63), F.lit(V.HIGH)).when(c < float(-(1 << 63)), F.lit(V.LOW)).when(F.isnan(c), F.lit(None)).otherwise(F.when(F.abs(c) < float(1 << 63), c).cast("long"))


def _real_text(c: Column) -> Column:
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or v != v else V.real_text(v))

    return _udf(run, "string")(c)


def _udf(f, returns: str):
    f.__annotations__ = {}
    with warnings.catch_warnings():  # a function of any number of columns has no type hints
        warnings.simplefilter("ignore")
        return F.pandas_udf(f, returns, F.PandasUDFType.SCALAR)


def real_text(c: Column) -> Column:
    """Whole numbers of up to 15 digits are written in the JVM."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(c.isNull(), F.lit(None)).when(whole, F.concat(F.when(whole, c).cast("long").cast("string"), F.lit(".0"))).otherwise(_real_text(c))


def divide_int(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.call_function("div", a, F.when(b != 0, b)))


def modulo_int(a: Column, b: Column) -> Column:
    return F.try_mod(a, b)


def instr(h: Column, n: Column) -> Column:
    return F.when(n == "", F.when(h.isNotNull(), F.lit(1))).otherwise(F.position(n, h)).cast("long")


def substr(s: Column, start: Column, length: Column | None) -> Column:
    """1-based; a negative start counts from the end, a negative length takes what stands before the start."""
    n = F.length(s)
    size = F.lit(1 << 30).cast("long") if length is None else length
    known = s.isNotNull() & start.isNotNull() & size.isNotNull()
    most = F.lit(1 << 30).cast("long")  # longer than any text
    start, size = F.greatest(F.least(start, most), -most), F.greatest(F.least(size, most), -most)
    raw = F.when(start < 0, n + start).when(start > 0, start - 1).otherwise(F.lit(0).cast("long"))
    cut = F.when((start < 0) & (raw < 0) & (size > 0), F.greatest(size + raw, F.lit(0))).when((start == 0) & (size > 0), size - 1).otherwise(size)
    begin = F.greatest(raw, F.lit(0))
    first = F.when(cut < 0, F.greatest(begin + cut, F.lit(0))).otherwise(begin)
    many = F.when(cut < 0, F.least(-cut, begin)).otherwise(cut)
    return F.when(known, F.substring(s, (first + 1).cast("int"), many.cast("int")))


# --- JSON

_SIMPLE = re.compile(r"\$(?:\.[A-Za-z_][A-Za-z0-9_]*|\[\d+\])*")


def simple_path(p: str) -> bool:
    return _SIMPLE.fullmatch(p) is not None


def _json_real(word: Column) -> Column:
    """A double as Spark writes it, with its exponent as the dialect writes it; without one up to 15 digits."""
    x = word.try_cast("double")
    small = (F.abs(x) >= 1e-4) & (F.abs(x) < 1e15)
    plain = F.regexp_replace(F.when(small, x).cast("decimal(38,18)").cast("string"), "(\\.\\d+?)0+$", "$1")
    power = F.regexp_replace(F.regexp_replace(word, "E(\\d)", "e+$1"), "E-", "e-")
    return F.when(~word.contains("E"), word).when(small, plain).otherwise(F.regexp_replace(power, "e([+-])(\\d)$", "e$10$2"))


def let(x: Column, f) -> Column:
    """f(x), with x computed once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def json_parts(doc: Column, p: str) -> Column:
    """Of what a simple path leads to: a struct of text, number (null unless it is one) and is_text (whether it is a text).  The document is parsed once."""
    found = F.try_variant_get(F.parse_json(doc), p, "variant")
    told = lambda v: F.struct(F.schema_of_variant(v).alias("kind"), v.cast("string").alias("word"))
    return let(let(found, told), lambda w: F.struct(*[c.alias(n) for c, n in zip(_json_parts(doc, p, w["kind"], w["word"]), ("text", "number", "is_text"), strict=True)]))


def _json_parts(doc: Column, p: str, kind: Column, word: Column) -> tuple[Column, Column, Column]:
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    is_bool, is_text = kind == "BOOLEAN", kind == "STRING"
    real = kind.startswith("DOUBLE") | kind.startswith("FLOAT")
    flag = F.when(word == "true", "1").otherwise("0")
    text = F.when(kind == "VOID", F.lit(None)).when(is_bool, flag).when(nested, F.get_json_object(doc, p)).when(real, _json_real(word)).otherwise(word)
    number = F.when(is_text | nested | (kind == "VOID"), F.lit(None)).when(is_bool, flag.cast("double")).otherwise(word.try_cast("double"))
    return text, number, is_text | nested


def json_valid(doc: Column) -> Column:
    return F.when(doc.isNotNull(), F.try_parse_json(doc).isNotNull().cast("long"))


def json_text(c: Column, kind: str) -> Column:
    """A value as JSON: texts quoted, null as null."""
    if kind == "TEXT":
        whole = F.to_json(F.struct(c.alias("v")))
        return F.when(c.isNull(), "null").otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))
    if kind == "NULL":
        return F.lit("null")
    return F.coalesce(c.cast("string") if kind == "INT" else real_text(c), F.lit("null"))


def json_call(name: str, args: list[Column], integer: bool) -> Column:
    """Any JSON function on columns, in Python on Arrow batches; results are texts, or integers where the function's are."""
    f = jsons.FUNCTIONS[name]
    done = (lambda v: v) if integer else V.text

    def run(*cols: pd.Series) -> pd.Series:
        out = []
        for row in zip(*cols, strict=True):
            out.append(done(f(*[None if _none(v) else _plain(v) for v in row])))
        return pd.Series(out, dtype=object if not integer else "Int64")

    return _udf(run, "long" if integer else "string")(*args)


def _none(v) -> bool:
    return v is None or v is pd.NA or (isinstance(v, float) and v != v)


def _plain(v):
    return v.item() if hasattr(v, "item") else v
