"""Tokenizers of full-text indexes, as Column expressions from text to an array of terms."""

from __future__ import annotations

import shlex
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Unsupported

#: Letters and what they are without their marks (fixed values).
MARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyy"


def unicode61(text: Column, remove_diacritics: int = 1) -> Column:
    """Runs of letters and digits, lower case; combining marks are dropped, and Latin marks unless remove_diacritics is 0."""
    low = F.regexp_replace(F.lower(text), "\\p{M}", "")
    if remove_diacritics:
        low = F.translate(low, MARKED, PLAIN)
    return F.coalesce(F.regexp_extract_all(low, F.lit("([\\p{L}\\p{N}]+)"), F.lit(1)), F.array().cast("array<string>"))


def trigram(text: Column, case_sensitive: bool = False) -> Column:
    """All windows of three characters."""
    t = text if case_sensitive else F.lower(text)
    chars = F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))  # once: a substring of a long text is found from its beginning
    n = F.greatest(F.length(t) - 2, F.lit(0))
    part = lambda i: F.slice(chars, F.lit(i), n)
    joined = lambda a, b: F.concat(a, b)
    return F.zip_with(F.zip_with(part(1), part(2), joined), part(3), joined)


class Tokenizer:
    """A parsed ``tokenize`` option: ``split`` gives terms; with ``stems``, distinct terms are stemmed afterwards."""

    def __init__(self, option: str = "unicode61"):
        words = [w.lower() for w in shlex.split(option)] or ["unicode61"]
        self.stems = words[0] == "porter"
        rest = words[1:] if self.stems else words
        kind, args = (rest[0], rest[1:]) if rest else ("unicode61", [])
        given = dict(zip(args[::2], args[1::2], strict=False))
        if len(args) % 2:
            raise Unsupported(f"tokenizer option {args[-1]}")
        self.kind = kind
        if kind == "unicode61":
            if set(given) - {"remove_diacritics"} or given.get("remove_diacritics", "1") not in ("0", "1", "2"):
                raise Unsupported(f"tokenizer options {sorted(given)}")
            marks = int(given.get("remove_diacritics", 1))
            self.split: Callable[[Column], Column] = lambda c: unicode61(c, marks)
        elif kind == "trigram":
            if set(given) - {"case_sensitive", "remove_diacritics"}:
                raise Unsupported(f"tokenizer options {sorted(given)}")
            exact = given.get("case_sensitive", "0") == "1"
            self.split = lambda c: trigram(c, exact)
        else:
            raise Unsupported(f"tokenizer {kind}")

    def terms(self, spark, texts: list[str]) -> list[list[str]]:
        """The terms of each query string."""
        from .porter import stem

        out = spark.range(1).select(F.array(*[self.split(F.lit(t)) for t in texts]).alias("t")).first()["t"]
        return [[stem(t) for t in terms] if self.stems else terms for terms in out]


__all__ = ["Tokenizer", "trigram", "unicode61"]
