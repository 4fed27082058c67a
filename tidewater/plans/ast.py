"""Syntax trees of the dialect, as the parser makes them."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from tidewater.functions.types import SqlType


@dataclass(frozen=True)
class Literal:
    value: Any
    type: SqlType


@dataclass(frozen=True)
class Name:
    qualifier: str | None
    name: str

    def __str__(self) -> str:
        return f"{self.qualifier}.{self.name}" if self.qualifier else self.name


@dataclass(frozen=True)
class Star:
    qualifier: str | None = None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Cast:
    expr: Any
    type: SqlType


@dataclass
class TableRef:
    database: str | None
    name: str
    alias: str | None = None


@dataclass
class Subquery:
    select: Any
    alias: str | None = None


@dataclass
class Directory:
    path: str
    delimiter: str = ","
    alias: str | None = None


@dataclass
class JoinRef:
    left: Any
    right: Any
    kind: str  # inner | left
    on: Any


@dataclass
class Select:
    items: list[tuple[Any, str | None]]
    source: Any = None
    where: Any = None
    group: list = field(default_factory=list)
    order: list[tuple[Any, bool]] = field(default_factory=list)  # expression, ascending
    limit: tuple[int, int] | None = None  # offset, limit


@dataclass
class Union:
    branches: list[Select]


@dataclass
class Statement:
    kind: str
    args: dict
