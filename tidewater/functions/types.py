"""SQL types of the dialect and their Spark counterparts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Computed decimals are held to these.
MAX_PRECISION, MAX_SCALE = 28, 14


class SqlError(Exception):
    """A statement that cannot be parsed, typed or executed."""


@dataclass(frozen=True)
class SqlType:
    kind: str
    precision: int = 0
    scale: int = 0
    #: JSON that is a flat array of strings, as file scans make it.
    flat: bool = field(default=False, compare=False)

    def __str__(self) -> str:
        return f"DECIMAL({self.precision},{self.scale})" if self.kind == "decimal" else NAMES[self.kind]


# Display names and spellings of types.
NAMES = {"null": "NULL", "bool": "BOOLEAN", "int": "INTEGER", "bigint": "BIGINT", "decimal": "DECIMAL", "text": "TEXT", "bytea": "BYTEA", "json": "JSON", "date": "DATE", "timestamp": "TIMESTAMP", "jsonpath": "JSONPATH"}
SPELLINGS = {"boolean": "bool", "integer": "int", "int": "int", "bigint": "bigint", "text": "text", "json": "json", "date": "date", "timestamp": "timestamp"}

NULL, BOOL, INT, BIGINT, TEXT, BYTEA, JSON, DATE, TIMESTAMP, JSONPATH = (SqlType(k) for k in ("null", "bool", "int", "bigint", "text", "bytea", "json", "date", "timestamp", "jsonpath"))


def decimal(precision: int, scale: int) -> SqlType:
    return SqlType("decimal", precision, scale)


def capped(precision: int, scale: int) -> SqlType:
    return decimal(min(precision, MAX_PRECISION), min(scale, MAX_SCALE))


_SPARK = {"null": T.NullType(), "bool": T.BooleanType(), "int": T.IntegerType(), "bigint": T.LongType(), "text": T.StringType(), "json": T.StringType(), "jsonpath": T.StringType(), "bytea": T.BinaryType(), "date": T.DateType(), "timestamp": T.TimestampNTZType()}


def spark_type(t: SqlType) -> T.DataType:
    return T.DecimalType(t.precision, t.scale) if t.kind == "decimal" else _SPARK[t.kind]


def sql_type(t: T.DataType) -> SqlType:
    """The dialect's type of a Spark column; doubles and the like have none."""
    if isinstance(t, T.DecimalType):
        return decimal(t.precision, t.scale)
    if isinstance(t, T.TimestampType):
        return TIMESTAMP
    for kind, spark in _SPARK.items():
        if type(t) is type(spark) and kind not in ("json", "jsonpath"):
            return SqlType(kind)
    raise SqlError(f"Columns of Spark type {t.simpleString()} have no SQL type here")


def parse_type(text: str) -> SqlType:
    """The type of its display name, as kept in catalogs."""
    text = text.strip().lower()
    if text.startswith("decimal"):
        p, s = text[text.index("(") + 1 : -1].split(",")
        return decimal(int(p), int(s))
    return SqlType(SPELLINGS[text])
