"""Syntax tree of the dialect: plain records without behaviour."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Lit:
    value: Any
    kind: str  # int real text blob null bool now


@dataclass
class Col:
    name: str
    table: str | None = None


@dataclass
class Param:
    name: str


@dataclass
class Unary:
    op: str
    x: Any


@dataclass
class Binary:
    op: str
    a: Any
    b: Any


@dataclass
class IsNull:
    x: Any
    negated: bool


@dataclass
class Same:
    a: Any
    b: Any
    negated: bool


@dataclass
class Between:
    x: Any
    low: Any
    high: Any
    negated: bool


@dataclass
class InList:
    x: Any
    items: list
    negated: bool


@dataclass
class InQuery:
    x: Any
    query: Any
    negated: bool


@dataclass
class Match:
    op: str  # LIKE GLOB REGEXP MATCH
    x: Any
    pattern: Any
    escape: Any
    negated: bool


@dataclass
class Cast:
    x: Any
    type: str


@dataclass
class Case:
    base: Any
    whens: list
    otherwise: Any


@dataclass
class Call:
    name: str
    args: list
    star: bool = False
    distinct: bool = False
    order: list = field(default_factory=list)
    where: Any = None
    over: Any = None  # a window definition or a name


@dataclass
class Window:
    base: str | None
    partition: list
    order: list
    frame: str | None


@dataclass
class Exists:
    query: Any
    negated: bool


@dataclass
class Scalar:
    query: Any


@dataclass
class Row:
    items: list


@dataclass
class Collate:
    x: Any
    name: str


@dataclass
class Raise:
    kind: str
    message: str | None


@dataclass
class Item:
    expr: Any
    alias: str | None
    text: str


@dataclass
class Star:
    table: str | None


@dataclass
class Order:
    expr: Any
    desc: bool
    nulls: str | None


@dataclass
class Table:
    name: str
    alias: str | None


@dataclass
class Derived:
    query: Any
    alias: str | None


@dataclass
class TableFunction:
    name: str
    args: list
    alias: str | None


@dataclass
class Join:
    kind: str  # INNER LEFT RIGHT FULL CROSS
    natural: bool
    left: Any
    right: Any
    on: Any = None
    using: list | None = None


@dataclass
class Core:
    distinct: bool = False
    items: list = field(default_factory=list)
    source: Any = None
    where: Any = None
    group: list = field(default_factory=list)
    having: Any = None
    windows: list = field(default_factory=list)


@dataclass
class Values:
    rows: list


@dataclass
class Compound:
    op: str  # UNION, UNION ALL, INTERSECT, EXCEPT
    left: Any
    right: Any


@dataclass
class Query:
    body: Any
    ctes: list = field(default_factory=list)  # (name, columns, Query)
    recursive: bool = False
    order: list = field(default_factory=list)
    limit: Any = None
    offset: Any = None


@dataclass
class Upsert:
    target: list
    sets: list | None  # None: DO NOTHING
    where: Any


@dataclass
class Insert:
    table: str
    columns: list | None
    source: Any  # Query, or None for DEFAULT VALUES
    action: str | None = None
    upsert: Any = None
    returning: list = field(default_factory=list)


@dataclass
class Update:
    table: str
    alias: str | None
    sets: list
    source: Any = None
    where: Any = None
    order: list = field(default_factory=list)
    limit: Any = None
    offset: Any = None
    returning: list = field(default_factory=list)


@dataclass
class Delete:
    table: str
    alias: str | None
    where: Any = None
    order: list = field(default_factory=list)
    limit: Any = None
    offset: Any = None
    returning: list = field(default_factory=list)


@dataclass
class ColumnDef:
    name: str
    type: str
    primary: bool = False
    autoincrement: bool = False
    not_null: bool = False
    unique: bool = False
    default: str | None = None  # these three as text
    check: str | None = None
    generated: str | None = None


@dataclass
class CreateTable:
    name: str
    columns: list
    primary: list
    unique: list
    checks: list
    exists_ok: bool
    query: Any = None
    text: str = ""


@dataclass
class CreateIndex:
    name: str
    table: str
    columns: list
    unique: bool
    where: Any
    exists_ok: bool
    text: str = ""


@dataclass
class CreateView:
    name: str
    columns: list | None
    query: Any
    exists_ok: bool
    text: str = ""
    query_text: str = ""


@dataclass
class CreateTrigger:
    name: str
    table: str
    timing: str
    event: str
    of: list
    when: Any
    body: list
    exists_ok: bool
    text: str = ""


@dataclass
class Drop:
    kind: str
    name: str
    missing_ok: bool


@dataclass
class Alter:
    table: str
    action: str  # rename, rename_column, add, drop
    args: tuple


@dataclass
class Transaction:
    action: str
    name: str | None = None


@dataclass
class Explain:
    statement: Any
    query_plan: bool
