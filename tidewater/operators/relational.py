"""The relational operators as plain DataFrame functions; Catalyst picks the physical ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.types import SqlError

#: The signed multiplicity of a row in a change feed.
FREQ = "_freq"


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def single_row(spark: SparkSession) -> DataFrame:
    """One row of no columns that matter."""
    return spark.range(1).select(F.lit(None).cast("boolean").alias("_single"))


def project(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in columns.items()])


def filter_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows whose predicate is TRUE."""
    return df.where(predicate)


def join_rows(left: DataFrame, right: DataFrame, on: Column | None, kind: str = "inner") -> DataFrame:
    """Inner or left outer join on any condition: equalities become keys, the rest is residual; None joins every pair."""
    if kind not in ("inner", "left"):
        raise SqlError(f"Joins are inner or left, not {kind}")
    return left.join(right, F.lit(True) if on is None else on, kind)


def group_rows(df: DataFrame, keys: dict[str, Column], aggregates: dict[str, Column]) -> DataFrame:
    """Groups by keys, NULL being a key like others; without keys one row always."""
    made = [c.alias(n) for n, c in aggregates.items()]
    if not keys:
        return df.agg(*made)
    grouped = df.groupBy(*[c.alias(n) for n, c in keys.items()])
    return grouped.agg(*made) if made else df.select(*[c.alias(n) for n, c in keys.items()]).distinct()


def first_value(column: Column) -> Column:
    """What a bare column means in a grouped query: a value of the group that is not NULL."""
    return F.first(column, ignorenulls=True)


def sort_total(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """By the keys and then by the whole row ascending, so that the order is total; NULLs first ascending, last descending."""
    return df.orderBy(*keys, *[F.col(f"`{c}`").asc() for c in df.columns])


def limit_offset(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return (df.offset(offset) if offset else df).limit(limit)


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Concatenation; types must be the same exactly, names are the first's."""
    types = [f.dataType for f in first.schema]
    for other in others:
        if [f.dataType for f in other.schema] != types:
            raise SqlError(f"UNION ALL of different types: {[t.simpleString() for t in types]}, {[f.dataType.simpleString() for f in other.schema]}")
        first = first.union(other)
    return first


def values_rows(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def insert_rows(rows: DataFrame, path: str) -> None:
    """Append in one atomic job commit."""
    rows.write.mode("append").parquet(path)


def negate(df: DataFrame) -> DataFrame:
    return df.withColumn(FREQ, -F.col(FREQ))


def weighted(df: DataFrame, freq: int = 1) -> DataFrame:
    return df.withColumn(FREQ, F.lit(freq).cast("long"))


def consolidate(df: DataFrame) -> DataFrame:
    """One row for each distinct tuple with its multiplicity; none of multiplicity 0."""
    keys = [F.col(f"`{c}`") for c in df.columns if c != FREQ]
    return df.groupBy(*keys).agg(F.sum(FREQ).alias(FREQ)).where(F.col(FREQ) != 0)


def expand(df: DataFrame) -> DataFrame:
    """Rows as often as their multiplicity says; those of 0 or less are none."""
    return df.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.greatest(F.col(FREQ), F.lit(0)).cast("int")))).drop("_copy", FREQ)


def delete_rows(table: DataFrame, victims: DataFrame) -> DataFrame:
    """Bag difference: each victim takes one copy of its tuple away."""
    return table.exceptAll(victims)


def delete_where(table: DataFrame, predicate: Column | None) -> DataFrame:
    """What is left when all rows whose predicate is TRUE go: a filter, no shuffle."""
    return table.where(F.lit(False) if predicate is None else ~F.coalesce(predicate, F.lit(False)))
