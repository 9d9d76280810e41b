"""The MATCH language: terms, "phrases", prefix*, AND (also by juxtaposition), OR, NOT, (groups), column: and {columns}: filters."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import MatchFault

_TOKEN = re.compile(r'\s+|(?P<phrase>"(?:[^"]|"")*")|(?P<word>[A-Za-z0-9_\x80-\U0010FFFF]+)|(?P<op>[(){}:*])')


@dataclass(frozen=True)
class Phrase:
    """text: to be tokenized; columns: where it may stand (None: anywhere)."""

    text: str
    prefix: bool
    columns: tuple | None = None


@dataclass(frozen=True)
class Node:
    op: str  # AND, OR, NOT
    left: Node | Phrase
    right: Node | Phrase


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise MatchFault(f"syntax error near {text[at : at + 10]!r}")
            at = m.end()
            if m.lastgroup:
                v = m.group()
                self.tokens.append((m.lastgroup, v[1:-1].replace('""', '"') if m.lastgroup == "phrase" else v))
        self.at = 0

    def peek(self, k: int = 0) -> tuple:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def is_(self, kind: str, value: str) -> bool:
        return self.peek() == (kind, value)

    def either(self, columns: tuple | None):
        out = self.both(columns)
        while self.is_("word", "OR"):
            self.at += 1
            out = Node("OR", out, self.both(columns))
        return out

    def both(self, columns: tuple | None):
        out = self.without(columns)
        while True:
            if self.is_("word", "AND"):
                self.at += 1
            elif self.peek()[0] == "end" or self.is_("op", ")") or self.is_("word", "OR"):
                return out
            out = Node("AND", out, self.without(columns))

    def without(self, columns: tuple | None):
        out = self.unit(columns)
        while self.is_("word", "NOT"):
            self.at += 1
            out = Node("NOT", out, self.unit(columns))
        return out

    def unit(self, columns: tuple | None):
        kind, v = self.peek()
        if kind == "op" and v == "{":
            self.at += 1
            names = []
            while self.peek()[0] in ("word", "phrase"):
                names.append(self.peek()[1])
                self.at += 1
            if not names or not self.is_("op", "}") or self.peek(1) != ("op", ":"):
                raise MatchFault("a column list needs } and :")
            self.at += 2
            return self.unit(_narrow(columns, names))
        if kind in ("word", "phrase") and self.peek(1) == ("op", ":"):
            self.at += 2
            return self.unit(_narrow(columns, [v]))
        if kind == "op" and v == "(":
            self.at += 1
            out = self.either(columns)
            if not self.is_("op", ")"):
                raise MatchFault("missing )")
            self.at += 1
            return out
        if kind not in ("word", "phrase") or (kind == "word" and v in ("AND", "OR", "NOT")):
            raise MatchFault(f"syntax error near {v!r}")
        self.at += 1
        prefix = self.is_("op", "*")
        self.at += prefix
        return Phrase(v, prefix, columns)


def _narrow(columns: tuple | None, names: list) -> tuple:
    low = tuple(n.lower() for n in names)
    return low if columns is None else tuple(n for n in low if n in columns)


def parse(text: str):
    p = _Parser(text)
    if not p.tokens:
        return None
    out = p.either(None)
    if p.peek()[0] != "end":
        raise MatchFault(f"syntax error near {p.peek()[1]!r}")
    return out


def leaves(tree, scored: bool = True) -> list:
    """(phrase, whether it scores), from left to right; what stands behind NOT never scores."""
    if tree is None:
        return []
    if isinstance(tree, Phrase):
        return [(tree, scored)]
    return leaves(tree.left, scored) + leaves(tree.right, scored and tree.op != "NOT")
