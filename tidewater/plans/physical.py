"""From typed logical plans to DataFrames. Column names are internal until the end, so that equal names never clash."""

from __future__ import annotations

from dataclasses import replace
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import registry as R
from tidewater.functions import types as T
from tidewater.functions.jsonpath import compile_path
from tidewater.functions.types import spark_type
from tidewater.operators import relational as O
from tidewater.plans import logical as L
from tidewater.sources import csv_directory, field


def column(e, names: list[str], keys: dict | None = None) -> Column:
    """The Spark expression of e over columns `names`; with `keys`, that of a grouped query."""
    if keys is not None and e in keys:
        return F.col(keys[e])
    if isinstance(e, L.Const):
        return R.literal(e.value, e.type)
    if isinstance(e, L.Ref):
        return F.col(names[e.offset]) if keys is None else O.first_value(F.col(names[e.offset]))
    inner = None if e.aggregate else keys
    flat = _flat_field(e, names, inner)
    if flat is not None:
        return flat
    args, types = [], []
    for a, want in zip(e.args, e.overload.params, strict=True):
        c = column(a, names, inner)
        t = a.type
        if t.kind == "null" and want != "any":
            t = T.decimal(1, 0) if want == "decimal" else T.SqlType(want)
            c = c.cast(spark_type(t))
        args.append(c)
        types.append(t)
    return e.overload.build(args, types, e.type)


def _flat_field(e, names, keys) -> Column | None:
    """->> with a constant index on a record of a file scan stays out of Python."""
    if e.name != "->>" or not e.args[0].type.flat:
        return None
    path = e.args[1]
    while isinstance(path, L.Apply) and path.name == "to_jsonpath":
        path = path.args[0]
    steps = compile_path(path.value) if isinstance(path, L.Const) else None
    if steps and len(steps) == 1 and steps[0][0] == "at" and steps[0][2] is not None and steps[0][2] >= 0:
        return field(column(e.args[0], names, keys), steps[0][2])
    return None


def conjuncts(e):
    """A predicate's parts at its top: plain conjunction (and BETWEEN) keeps the same rows as the strict one, and Catalyst can push it down."""
    if isinstance(e, L.Apply) and e.name == "and":
        for a in e.args:
            yield from conjuncts(a)
    else:
        yield e


def condition(e, names: list[str]) -> Column:
    out = None
    for part in conjuncts(e):
        if isinstance(part, L.Apply) and part.name == "between":
            part = replace(part, overload=replace(part.overload, build=lambda c, t, r: c[0].between(c[1], c[2])))
        c = column(part, names).cast("boolean")
        out = c if out is None else out & c
    return out


class Planner:
    def __init__(self, spark: SparkSession):
        self.spark, self.number = spark, count()

    def fresh(self, n: int) -> list[str]:
        return [f"_{next(self.number)}" for _ in range(n)]

    def named(self, df: DataFrame, columns: list[Column]) -> tuple[DataFrame, list[str]]:
        names = self.fresh(len(columns))
        return df.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)]), names

    def build(self, p) -> tuple[DataFrame, list[str]]:
        match p:
            case L.Single():
                return O.single_row(self.spark), []
            case L.Table():
                df = p.read()
                return self.named(df, [F.col(f"`{n}`") for n, _ in p.columns])
            case L.FileScan():
                return self.named(csv_directory(self.spark, p.path, p.delimiter), [F.col("data")])
            case L.Alias():
                return self.build(p.source)
            case L.Values():
                schema = T.T.StructType([T.T.StructField(f"v{i}", spark_type(t)) for i, (_, t) in enumerate(p.columns)])
                rows = [tuple(self._value(e) for e in row) for row in p.rows]
                return self.named(O.values_rows(self.spark, rows, schema), [F.col(f"v{i}") for i in range(len(p.columns))])
            case L.Project():
                df, names = self.build(p.source)
                return self.named(df, [column(e, names).cast(spark_type(e.type)) for _, e in p.items])
            case L.Filter():
                df, names = self.build(p.source)
                return O.filter_rows(df, condition(p.predicate, names)), names
            case L.Join():
                left, a = self.build(p.left)
                right, b = self.build(p.right)
                if not a or not b:  # a side without columns still has rows
                    left, right = (x.select(*n, F.lit(None).cast("boolean").alias(self.fresh(1)[0])) for x, n in ((left, a), (right, b)))
                always = isinstance(p.on, L.Const) and p.on.value is True
                return O.join_rows(left, right, None if always else condition(p.on, [*a, *b]), p.kind), [*a, *b]
            case L.Group():
                df, names = self.build(p.source)
                keys = dict(zip(p.keys, self.fresh(len(p.keys)), strict=False))
                made = self.fresh(len(p.items))
                aggregates = {n: column(e, names, keys).cast(spark_type(e.type)) for n, (_, e) in zip(made, p.items, strict=True)}
                df = df.select("*", *[column(k, names).alias(n) for k, n in keys.items()])
                return O.group_rows(df, {n: F.col(n) for n in keys.values()}, aggregates).select(*made), made
            case L.Sort():
                df, names = self.build(p.source)
                keys = [column(e, names).asc() if up else column(e, names).desc() for e, up in p.keys]
                return O.sort_total(df, keys), names
            case L.Limit():
                df, names = self.build(p.source)
                if isinstance(p.source, (L.Table, L.Filter)):  # which rows a table's LIMIT takes follows its scan: all columns ascending
                    df = O.sort_total(df, [])
                return O.limit_offset(df, p.limit, p.offset), names
            case L.UnionAll():
                built = [self.build(s) for s in p.sources]
                return O.union_all(*[df.select(*names) for df, names in built]), built[0][1]
            case L.Negate():
                return self.build(p.source)
        raise TypeError(type(p).__name__)

    @staticmethod
    def _value(e):
        if isinstance(e, L.Const):
            return e.value
        import datetime

        try:  # a DATE literal
            return datetime.date(*map(int, e.args[0].value.split("-")))
        except ValueError:
            return None

    def frame(self, p) -> DataFrame:
        df, names = self.build(p)
        return df.select(*[F.col(n).alias(f.name) for n, f in zip(names, p.fields, strict=True)])
