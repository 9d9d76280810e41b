"""Statements and expressions as plain data."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Expr:
    pass


@dataclass(frozen=True)
class Literal(Expr):
    value: Any  # None, int, float, str or bytes


@dataclass(frozen=True)
class Param(Expr):
    name: str | None
    index: int


@dataclass(frozen=True)
class Column(Expr):
    table: str | None
    name: str


@dataclass(frozen=True)
class Unary(Expr):
    op: str  # - or NOT
    arg: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    arg: Expr
    negated: bool


@dataclass(frozen=True)
class In(Expr):
    arg: Expr
    items: tuple
    negated: bool


@dataclass(frozen=True)
class InJsonEach(Expr):
    arg: Expr
    json: Expr
    negated: bool


@dataclass(frozen=True)
class Like(Expr):
    arg: Expr
    pattern: Expr
    negated: bool


@dataclass(frozen=True)
class Case(Expr):
    subject: Expr | None
    arms: tuple
    other: Expr | None


@dataclass(frozen=True)
class Cast(Expr):
    arg: Expr
    type: str


@dataclass(frozen=True)
class Collate(Expr):
    arg: Expr
    name: str


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple
    star: bool = False


@dataclass(frozen=True)
class Match(Expr):
    table: str
    query: Expr


@dataclass(frozen=True)
class Subquery(Expr):
    select: Any = field(compare=False)
    text: str = ""


@dataclass
class Item:
    expr: Expr | None  # None: a star
    alias: str | None = None
    star_of: str | None = None
    text: str = ""


@dataclass
class TableRef:
    name: str
    alias: str | None


@dataclass
class Join:
    kind: str  # inner or left
    table: TableRef
    on: Expr


@dataclass
class Order:
    expr: Expr
    desc: bool


@dataclass
class Select:
    items: list
    table: TableRef | None
    joins: list
    where: Expr | None = None
    group: list = field(default_factory=list)
    having: Expr | None = None
    distinct: bool = False
    order: list = field(default_factory=list)
    limit: Expr | None = None
    offset: Expr | None = None


@dataclass
class Compound:
    arms: list
    ops: list  # union or union all, one less than arms
    order: list
    limit: Expr | None
    offset: Expr | None


@dataclass
class Insert:
    table: str
    columns: list | None
    rows: list | None
    select: Any
    conflict: str | None  # replace, ignore, or None
    upsert_target: str | None = None
    upsert_sets: list | None = None
    returning: list | None = None


@dataclass
class Update:
    table: str
    sets: list
    where: Expr | None
    returning: list | None


@dataclass
class Delete:
    table: str
    where: Expr | None
    returning: list | None


@dataclass
class ColumnDef:
    name: str
    type: str
    not_null: bool = False
    default: Any = None  # an Expr
    collate: str = "BINARY"
    unique: bool = False
    primary: bool = False
    autoincrement: bool = False
    references: tuple | None = None  # table, action


@dataclass
class CreateTable:
    name: str
    columns: list
    primary: list
    uniques: list
    foreign: list
    if_not_exists: bool


@dataclass
class CreateIndex:
    name: str
    table: str
    columns: list
    unique: bool
    if_not_exists: bool


@dataclass
class CreateFts:
    name: str
    columns: list
    options: dict
    if_not_exists: bool


@dataclass
class CreateTrigger:
    name: str
    event: str
    table: str
    when: Expr | None
    body: list
    text: str
    if_not_exists: bool


@dataclass
class Drop:
    kind: str
    name: str
    if_exists: bool


@dataclass
class Pragma:
    name: str
    value: Any
    setting: bool


@dataclass
class Transaction:
    action: str
