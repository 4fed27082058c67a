"""The dialect's functions: overloads, implicit conversions and their Spark expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions import jsonpath as J
from tidewater.functions import types as T
from tidewater.functions.types import SqlError, SqlType

COMPARABLE = ("bool", "int", "bigint", "decimal", "text", "date")


@dataclass(frozen=True)
class Overload:
    name: str
    params: tuple[str, ...]
    returns: Callable[[list[SqlType]], SqlType]
    build: Callable[..., Column]  # (columns, types, return type) -> Column
    aggregate: bool = False


REGISTRY: dict[str, list[Overload]] = {}


def register(name: str, params, returns, build, aggregate: bool = False) -> None:
    to = returns if callable(returns) else lambda _: returns
    REGISTRY.setdefault(name, []).append(Overload(name, tuple(params), to, build, aggregate))


#: Costs of implicit conversions; what is not here does not convert.
PROMOTIONS = {("int", "bigint"): 1, ("int", "decimal"): 2, ("bigint", "decimal"): 1, ("text", "jsonpath"): 1}


def resolve(name: str, args: list[SqlType]) -> Overload:
    """The overload of least total conversion cost, the first registered of equals."""
    best, least = None, None
    for o in REGISTRY.get(name, ()):
        if len(o.params) != len(args):
            continue
        costs = [0 if p == "any" or a.kind in (p, "null") else PROMOTIONS.get((a.kind, p)) for p, a in zip(o.params, args, strict=True)]
        if None not in costs and (least is None or sum(costs) < least):
            best, least = o, sum(costs)
    if best is None:
        raise SqlError(f"Function {name}({', '.join(map(str, args))}) not found")
    return best


# Boolean logic: NULL if any side is NULL.


def _strict(build):
    def strict(c, types, ret):
        known = c[0].isNotNull()
        for x in c[1:]:
            known = known & x.isNotNull()
        return F.when(known, build(*c))

    return strict


register("and", ("bool", "bool"), T.BOOL, _strict(lambda a, b: a & b))
register("or", ("bool", "bool"), T.BOOL, _strict(lambda a, b: a | b))
register("not", ("bool",), T.BOOL, lambda c, t, r: ~c[0])
register("isnull", ("any",), T.BOOL, lambda c, t, r: c[0].isNull())
register("istrue", ("bool",), T.BOOL, lambda c, t, r: F.coalesce(c[0], F.lit(False)))
register("isfalse", ("bool",), T.BOOL, lambda c, t, r: F.coalesce(~c[0], F.lit(False)))
for _kind in COMPARABLE:
    register("=", (_kind, _kind), T.BOOL, lambda c, t, r: c[0] == c[1])
    register("!=", (_kind, _kind), T.BOOL, lambda c, t, r: c[0] != c[1])
    register("<", (_kind, _kind), T.BOOL, lambda c, t, r: c[0] < c[1])
    register("<=", (_kind, _kind), T.BOOL, lambda c, t, r: c[0] <= c[1])
    register(">", (_kind, _kind), T.BOOL, lambda c, t, r: c[0] > c[1])
    register(">=", (_kind, _kind), T.BOOL, lambda c, t, r: c[0] >= c[1])
    register("between", (_kind,) * 3, T.BOOL, _strict(lambda x, a, b: x.between(a, b)))

# Arithmetic. Decimals are held to (28, 14).


def _sum_type(t: list[SqlType]) -> SqlType:
    a, b = t
    scale = max(a.scale, b.scale)
    return T.decimal(min(max(a.precision - a.scale, b.precision - b.scale) + scale + 1, T.MAX_PRECISION), scale)


def _product_type(t: list[SqlType]) -> SqlType:
    return T.capped(t[0].precision + t[1].precision, t[0].scale + t[1].scale)


def _as(column: Column, t: SqlType) -> Column:
    return column.cast(T.spark_type(t))


for _name, _op in (("+", lambda a, b: a + b), ("-", lambda a, b: a - b), ("*", lambda a, b: a * b)):
    register(_name, ("int", "int"), T.INT, lambda c, t, r, op=_op: op(*c))
    register(_name, ("bigint", "bigint"), T.BIGINT, lambda c, t, r, op=_op: op(*c))
    register(_name, ("decimal", "decimal"), _product_type if _name == "*" else _sum_type, lambda c, t, r, op=_op: _as(op(*c), r))


register("/", ("int", "int"), T.INT, lambda c, t, r: _as((c[0] - c[0] % c[1]) / c[1], r))
register("/", ("bigint", "bigint"), T.BIGINT, lambda c, t, r: _as(_as(c[0] - c[0] % c[1], T.decimal(19, 0)) / _as(c[1], T.decimal(19, 0)), r))
register("/", ("decimal", "decimal"), T.decimal(T.MAX_PRECISION, T.MAX_SCALE), lambda c, t, r: _as(_as(c[0], r) / c[1], r))

register("date_sub", ("date", "int"), T.DATE, lambda c, t, r: F.date_sub(c[0], c[1]))

# JSON


register("json_extract", ("json", "jsonpath"), T.JSON, lambda c, t, r: J.json_extract(c[0], c[1]))
register("->", ("json", "jsonpath"), T.JSON, lambda c, t, r: J.json_extract(c[0], c[1]))
register("->>", ("json", "jsonpath"), T.TEXT, lambda c, t, r: J.json_extract_unquote(c[0], c[1]))
register("json_unquote", ("json",), T.TEXT, lambda c, t, r: J.json_unquote(c[0]))

# Conditionals


def _common(types: list[SqlType]) -> SqlType:
    known = [t for t in types if t.kind != "null"]
    if not known or known[0].kind != "decimal":
        return known[0] if known else T.NULL
    scale = max(t.scale for t in known)
    return T.decimal(min(T.MAX_PRECISION, max(t.precision - t.scale for t in known) + scale), scale)


for _kind in ("bool", "int", "bigint", "text", "bytea", "date", "timestamp", "json", "decimal"):
    for _n in range(1, 11):
        register("coalesce", (_kind,) * _n, lambda t, k=_kind: x if (x := _common(t)) != T.NULL else (T.decimal(1, 0) if k == "decimal" else SqlType(k)), lambda c, t, r: _as(F.coalesce(*c), r))
    register("if", ("bool", _kind, _kind), lambda t, k=_kind: x if (x := _common(t[1:])) != T.NULL else (T.decimal(1, 0) if k == "decimal" else SqlType(k)), lambda c, t, r: _as(F.when(c[0], c[1]).otherwise(c[2]), r))

# Casts: what cannot be converted is NULL.

_INTEGER, _DECIMAL = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*|\.\d+)$"


def _try(column: Column, t: SqlType) -> Column:
    return column.try_cast(T.spark_type(t))


def _json_scalar(c: Column) -> Column:
    """Text of a JSON string's content or of a number; NULL for other JSON."""
    return F.when(c.startswith('"'), F.regexp_extract(c, r'(?s)^"(.*)"$', 1)).when(F.regexp_like(c, F.lit(r"^-?\d")), c)


def _text_to(pattern: str):
    return lambda c, t, r: F.when(F.regexp_like(c[0], F.lit(pattern)), _try(c[0], r))


def _json_to_whole(c, t, r):
    # A number is cut to its whole part; a string must be a whole number.
    return F.when(c[0].startswith('"'), _text_to(_INTEGER)([_json_scalar(c[0])], t, r)).otherwise(_try(_try(_json_scalar(c[0]), T.decimal(38, 14)), r))


register("to_bool", ("bool",), T.BOOL, lambda c, t, r: c[0])
register("to_bool", ("text",), T.BOOL, lambda c, t, r: F.when(F.lower(c[0]) == "true", True).when(F.lower(c[0]) == "false", False))
register("to_bool", ("json",), T.BOOL, lambda c, t, r: F.when(F.lower(c[0]).isin("true", '"true"'), True).when(F.lower(c[0]).isin("false", '"false"'), False))
for _name, _to in (("to_int", T.INT), ("to_bigint", T.BIGINT)):
    register(_name, ("bool",), _to, lambda c, t, r: _as(c[0], r))
    register(_name, ("int",), _to, lambda c, t, r: _as(c[0], r))
    # A BIGINT keeps its low 32 bits as an INTEGER.
    register(_name, ("bigint",), _to, lambda c, t, r: _as(F.shiftright(F.shiftleft(c[0], 32), 32), r) if r == T.INT else c[0])
    register(_name, ("decimal",), _to, lambda c, t, r: _try(c[0], r))
    register(_name, ("text",), _to, _text_to(_INTEGER))
    register(_name, ("json",), _to, _json_to_whole)
register("to_decimal", ("bool",), T.decimal(1, 0), lambda c, t, r: _try(_as(c[0], T.INT), r))
register("to_decimal", ("int",), T.decimal(10, 0), lambda c, t, r: _try(c[0], r))
register("to_decimal", ("bigint",), T.decimal(20, 0), lambda c, t, r: _try(c[0], r))
register("to_decimal", ("decimal",), lambda t: t[0], lambda c, t, r: _try(c[0], r))
register("to_decimal", ("text",), T.decimal(28, 14), _text_to(_DECIMAL))
register("to_decimal", ("json",), T.decimal(28, 14), lambda c, t, r: _text_to(_DECIMAL)([_json_scalar(c[0])], t, r))


def _timestamp_text(c: Column) -> Column:
    ms = F.date_format(c, "SSS")
    return F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.when(ms == "000", "").otherwise(F.concat(F.lit("."), ms)))


register("to_text", ("bool",), T.TEXT, lambda c, t, r: F.when(c[0], "TRUE").when(~c[0], "FALSE"))
register("to_text", ("text",), T.TEXT, lambda c, t, r: c[0])
for _kind in ("int", "bigint", "decimal", "date", "json"):
    register("to_text", (_kind,), T.TEXT, lambda c, t, r: c[0].cast("string"))
register("to_text", ("timestamp",), T.TEXT, lambda c, t, r: _timestamp_text(c[0]))
register("to_json", ("bool",), T.JSON, lambda c, t, r: c[0].cast("string"))
for _kind in ("int", "bigint", "decimal"):
    register("to_json", (_kind,), T.JSON, lambda c, t, r: c[0].cast("string"))
register("to_json", ("text",), T.JSON, lambda c, t, r: J.json_canonical(c[0]))
register("to_jsonpath", ("text",), T.JSONPATH, lambda c, t, r: c[0])
register("to_date", ("text",), T.DATE, _text_to(r"^\d{4}-\d{1,2}-\d{1,2}$"))
register(
    "to_timestamp",
    ("text",),
    T.TIMESTAMP,
    lambda c, t, r: F.when(F.regexp_like(c[0], F.lit(r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?$")), F.date_trunc("MILLISECOND", _try(c[0], r)).cast("timestamp_ntz")),
)

register("type_of", ("any",), T.TEXT, lambda c, t, r: F.lit(str(t[0])))
#: The lowering puts the session's database in.
register("database", (), T.TEXT, lambda c, t, r: F.lit(None).cast("string"))

# Aggregates


def _average(c: Column, t: SqlType) -> Column:
    """An exact quotient to 14 digits: the sum keeps the argument's scale, and the quotient's scale is 14 or more."""
    scale = max(t.scale, 8)
    total = F.sum(c).cast(f"decimal({min(38, 22 + scale)},{scale})")
    return (total / F.count(c).cast("decimal(16,0)")).cast(T.spark_type(T.decimal(28, 14)))


register("count", (), T.BIGINT, lambda c, t, r: F.count(F.lit(1)), True)
register("count", ("any",), T.BIGINT, lambda c, t, r: F.count(c[0]), True)
register("sum", ("int",), T.INT, lambda c, t, r: F.sum(c[0]).cast("int"), True)
register("sum", ("bigint",), T.BIGINT, lambda c, t, r: F.sum(c[0]), True)
register("sum", ("decimal",), lambda t: T.decimal(T.MAX_PRECISION, t[0].scale), lambda c, t, r: _as(F.sum(c[0]), r), True)
for _kind in ("int", "bigint", "decimal"):
    register("avg", (_kind,), T.decimal(28, 14), lambda c, t, r: _average(c[0], t[0]), True)

CASTS: dict[str, str] = {"bool": "to_bool", "int": "to_int", "bigint": "to_bigint", "decimal": "to_decimal", "text": "to_text", "json": "to_json", "date": "to_date", "timestamp": "to_timestamp", "jsonpath": "to_jsonpath"}


def literal(value: Any, t: SqlType) -> Column:
    return F.lit(value).cast(T.spark_type(t))
