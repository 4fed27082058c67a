"""The engine's front door: Engine(spark).session().sql(text) is a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as ST

from tidewater.catalog import SYSTEM, Catalog
from tidewater.functions.registry import REGISTRY
from tidewater.functions.types import SqlError, sql_type
from tidewater.operators import relational as O
from tidewater.plans import ast as A
from tidewater.plans import logical as L
from tidewater.plans.analyze import Analyzer
from tidewater.plans.explain import explain
from tidewater.plans.parser import parse
from tidewater.plans.physical import Planner

#: Bytes that COMPACT TABLE aims at in a file.
FILE_BYTES = 128 << 20


class Engine:
    """Tables live under `location`, any folder that Spark can write."""

    def __init__(self, spark: SparkSession, location: str | None = None):
        self.spark = spark
        self.catalog = Catalog(spark, location or f"{spark.conf.get('spark.sql.warehouse.dir')}/tidewater")

    def session(self, database: str = "default") -> Session:
        return Session(self, database)

    def attach(self, name: str, df: DataFrame, database: str = "default") -> None:
        """Make a DataFrame readable as a table."""
        self.catalog.attach(name, [(f.name.lower(), sql_type(f.dataType)) for f in df.schema], lambda: df.toDF(*[c.lower() for c in df.columns]), database)


class Session:
    def __init__(self, engine: Engine, database: str):
        self.engine, self.spark, self.catalog, self.database = engine, engine.spark, engine.catalog, database

    def sql(self, text: str) -> DataFrame:
        """Run one statement; queries are lazy, and others give an empty DataFrame once they are done."""
        s = parse(text)
        self.catalog.refresh()
        return getattr(self, f"_{s.kind}")(**s.args)

    def plan(self, text: str):
        """The typed logical plan of a query or a write."""
        self.catalog.refresh()
        return self._plan(parse(text))

    def _plan(self, s: A.Statement):
        a = Analyzer(self.catalog, self.database)
        if s.kind == "select":
            return a.query(s.args["query"])
        if s.kind in ("insert", "insert_values", "delete"):
            return getattr(a, s.kind)(**s.args)
        if s.kind == "explain":
            return self._plan(s.args["of"])
        raise SqlError(f"{s.kind.replace('_', ' ').upper()} has no plan")

    def _frame(self, plan) -> DataFrame:
        return Planner(self.spark).frame(plan)

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], ST.StructType([]))

    def _of(self, table: tuple[str | None, str]) -> tuple[str, str]:
        return table[0] or self.database, table[1]

    # Statements

    def _select(self, query) -> DataFrame:
        return self._frame(Analyzer(self.catalog, self.database).query(query))

    def _explain(self, of) -> DataFrame:
        rows = explain(self.spark, self._plan(of))
        return self.spark.createDataFrame(rows, "tree string, col_idx string, datatype string, expression string")

    def _insert(self, table, query) -> DataFrame:
        plan = Analyzer(self.catalog, self.database).insert(table, query)
        return self._append(table, plan)

    def _insert_values(self, table, rows) -> DataFrame:
        plan = Analyzer(self.catalog, self.database).insert_values(table, rows)
        return self._append(table, plan)

    def _append(self, table, plan: L.Insert) -> DataFrame:
        names = [n for n, _ in plan.table.columns]
        self.catalog.append(*self._of(table), self._frame(plan.source).toDF(*names))
        return self._nothing()

    def _delete(self, table, where, limit) -> DataFrame:
        plan = Analyzer(self.catalog, self.database).delete(table, where, limit)
        names = [n for n, _ in plan.table.columns]
        current = plan.table.read()
        if limit is None:  # whole tuples go: no need to compare bags
            predicate = None if where is None else _condition(plan.source.source.predicate, names)
            left = O.delete_where(current, predicate) if where is not None else current.limit(0)
        else:
            left = O.delete_rows(current, self._frame(plan.source).toDF(*names))
        self.catalog.replace(*self._of(table), left)
        return self._nothing()

    def _create_database(self, name) -> DataFrame:
        self.catalog.create_database(name)
        return self._nothing()

    def _drop_database(self, name) -> DataFrame:
        self.catalog.drop_database(name)
        return self._nothing()

    def _create_table(self, table, columns) -> DataFrame:
        self.catalog.create_table(*self._of(table), columns)
        return self._nothing()

    def _create_view(self, table, query, sql) -> DataFrame:
        plan = Analyzer(self.catalog, self.database).query(query)
        self.catalog.create_view(*self._of(table), [(f.name, f.type) for f in plan.fields], sql, self.database)
        return self._nothing()

    def _drop_table(self, table) -> DataFrame:
        self.catalog.drop(*self._of(table))
        return self._nothing()

    def _use(self, name) -> DataFrame:
        self.database = name
        return self._nothing()

    def _rows(self, name: str, values: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(v,) for v in values], f"{name} string")

    def _show_functions(self) -> DataFrame:
        return self._rows("name", sorted(REGISTRY))

    def _show_databases(self) -> DataFrame:
        return self.sql(f"SELECT name FROM {SYSTEM}.databases ORDER BY name")

    def _show_tables(self) -> DataFrame:
        return self._rows("name", self.catalog.names(self.database))

    def _compact(self, table) -> DataFrame:
        """Fewer, fuller files; the rows stay."""
        database, name = self._of(table)
        Analyzer(self.catalog, self.database).own_table(*table)
        df = self.catalog.find(database, name).read()
        files = max(1, -(-self.catalog.size(database, name) // FILE_BYTES))
        self.catalog.replace(database, name, df.repartition(int(files)))
        return self._nothing()


def _condition(predicate, names):
    from tidewater.plans.physical import condition

    return condition(predicate, [f"`{n}`" for n in names])
