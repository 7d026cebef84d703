"""Statements as data."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Column:
    name: str  # as written: col, alias.col or dotted.table.col


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Call:
    function: str  # upper case
    argument: Column | Star


@dataclass(frozen=True)
class Literal:
    text: str | None  # None: null
    kind: str  # "int", "float", "string" or "null"


@dataclass(frozen=True)
class Item:
    expression: Column | Star | Call
    alias: str | None = None

    @property
    def name(self) -> str:
        """The alias, or the expression without its punctuation: t.col is tcol, SUM(x) is SUMx."""
        if self.alias:
            return self.alias
        e = self.expression
        if isinstance(e, Call):
            return e.function + ("" if isinstance(e.argument, Star) else e.argument.name.replace(".", ""))
        return e.name.replace(".", "") if isinstance(e, Column) else "*"


@dataclass(frozen=True)
class Compare:
    left: Column | Literal | Call
    operator: str  # = <> < > <= >=
    right: Column | Literal | Call


@dataclass(frozen=True)
class InList:
    column: Column | Call
    values: tuple[Literal, ...]
    negated: bool = False


@dataclass(frozen=True)
class InSelect:
    column: Column
    select: Select
    negated: bool = False


@dataclass(frozen=True)
class Contains:
    column: Column
    value: Literal
    negated: bool = False


@dataclass(frozen=True)
class IsNull:
    column: Column
    negated: bool = False


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Xor:
    parts: tuple


@dataclass(frozen=True)
class Table:
    name: str
    alias: str
    select: Select | None = None  # an inline view


@dataclass(frozen=True)
class Order:
    column: Column
    descending: bool = False
    nulls: str | None = None  # FIRST or LAST, if said


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    tables: tuple[Table, ...]
    where: object | None = None
    group: tuple[Column, ...] = ()
    having: object | None = None
    order: tuple[Order, ...] = ()
    window: tuple[Column, int] | None = None
    limit: int | None = None
    stream: bool = False
    distinct: bool = False
    offset: int = 0


@dataclass(frozen=True)
class Combined:
    """UNION, INTERSECT or EXCEPT; with `every`, rows count as often as they occur."""

    left: Select | Combined
    operator: str
    every: bool
    right: Select


@dataclass(frozen=True)
class Process:
    table: Table
    processor: str
    where: object | None = None
    stream: bool = False


@dataclass(frozen=True)
class Commit:
    pass


@dataclass(frozen=True)
class Rollback:
    pass


AGGREGATES = ("COUNT", "SUM", "MIN", "MAX", "AVG", "LAST")
SCALARS = ("TO_NUMBER", "TO_CHAR", "TO_DATE")
FUNCTIONS = (*AGGREGATES, *SCALARS)
