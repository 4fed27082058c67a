"""Typed logical plans: what analysis makes of syntax, with columns by their offset in the source's output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from tidewater.functions.registry import Overload
from tidewater.functions.types import SqlType


@dataclass(frozen=True)
class Const:
    value: Any
    type: SqlType

    def __str__(self) -> str:
        return show(self.value, self.type)


@dataclass(frozen=True)
class Ref:
    offset: int
    type: SqlType

    def __str__(self) -> str:
        return f"<OFFSET {self.offset}>"


@dataclass(frozen=True)
class Apply:
    name: str
    args: tuple
    type: SqlType
    overload: Overload = field(compare=False, repr=False)

    def __str__(self) -> str:
        name = self.name if self.name.replace("_", "").isalpha() else f"`{self.name}`"
        return f"{name}({', '.join(map(str, self.args))})"

    @property
    def aggregate(self) -> bool:
        return self.overload.aggregate


def show(value: Any, t: SqlType) -> str:
    if value is None:
        return "NULL"
    if t.kind == "bool":
        return "TRUE" if value else "FALSE"
    if t.kind == "decimal":
        return f"{value:.{t.scale}f}"
    if t.kind == "text":
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + '"'
    return str(value)


def rebuilt(e, fn):
    """e with fn applied to its parts and then to itself."""
    if isinstance(e, Apply):
        e = replace(e, args=tuple(rebuilt(a, fn) for a in e.args))
    return fn(e)


def parts(e) -> Iterator:
    yield e
    if isinstance(e, Apply):
        for a in e.args:
            yield from parts(a)


def refs(e) -> set[int]:
    return {x.offset for x in parts(e) if isinstance(x, Ref)}


def has_aggregate(e) -> bool:
    return any(isinstance(x, Apply) and x.aggregate for x in parts(e))


@dataclass(frozen=True)
class Field:
    qualifier: str | None
    name: str
    type: SqlType

    def __str__(self) -> str:
        return f"{self.qualifier}.{self.name}" if self.qualifier else self.name


@dataclass
class Single:
    fields: list = field(default_factory=list)


@dataclass
class Project:
    items: list[tuple[str, Any]]
    source: Any

    @property
    def fields(self):
        return [Field(None, n, e.type) for n, e in self.items]


@dataclass
class Filter:
    predicate: Any
    source: Any

    @property
    def fields(self):
        return self.source.fields


@dataclass
class Join:
    left: Any
    right: Any
    kind: str
    on: Any

    @property
    def fields(self):
        return [*self.left.fields, *self.right.fields]


@dataclass
class Group:
    keys: list
    items: list[tuple[str, Any]]
    source: Any

    @property
    def fields(self):
        return [Field(None, n, e.type) for n, e in self.items]


@dataclass
class Sort:
    keys: list[tuple[Any, bool]]
    source: Any

    @property
    def fields(self):
        return self.source.fields


@dataclass
class Limit:
    offset: int
    limit: int
    source: Any

    @property
    def fields(self):
        return self.source.fields


@dataclass
class UnionAll:
    sources: list

    @property
    def fields(self):
        return [Field(None, f.name, f.type) for f in self.sources[0].fields]


@dataclass
class Values:
    columns: list[tuple[str, SqlType]]
    rows: list[tuple]

    @property
    def fields(self):
        return [Field(None, n, t) for n, t in self.columns]


@dataclass
class Table:
    name: str
    columns: list[tuple[str, SqlType]]
    read: Any  # () -> DataFrame

    @property
    def fields(self):
        return [Field(self.name, n, t) for n, t in self.columns]


@dataclass
class Alias:
    name: str
    source: Any

    @property
    def fields(self):
        return [Field(self.name, f.name, f.type) for f in self.source.fields]


@dataclass
class FileScan:
    path: str
    delimiter: str
    type: SqlType

    @property
    def fields(self):
        return [Field(None, "data", self.type)]


@dataclass
class Negate:
    source: Any

    @property
    def fields(self):
        return self.source.fields


@dataclass
class Insert:
    table: Table
    source: Any

    @property
    def fields(self):
        return []
