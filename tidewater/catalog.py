"""Databases, tables and views, shared by all engines on one folder.

The catalog is a series of numbered JSON files; a change reads the latest and
writes the next, and the rename to that number decides between engines. A table
is a list of parts, folders of Parquet files that are written once: INSERT adds
a part, DELETE and COMPACT put one part in the place of all. What a query has
read from stays until vacuum() removes parts that no table has any more.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as ST

from tidewater.functions import types as T
from tidewater.functions.types import SqlError, SqlType, parse_type, spark_type
from tidewater.operators.relational import insert_rows

#: The database of the system tables.
SYSTEM = "system"
INITIAL = ("default", "information_schema", SYSTEM)

# The system tables' columns.
SYSTEM_TABLES = {
    "databases": [("name", T.TEXT)],
    "prefix_tables": [("table_id", T.BIGINT), ("column_len", T.INT), ("pk_sort", T.JSON)],
    "tables": [("database_name", T.TEXT), ("name", T.TEXT), ("type", T.TEXT), ("sql", T.TEXT), ("sql_context", T.TEXT), ("table_id", T.BIGINT), ("columns", T.JSON), ("system", T.BOOL)],
}


@dataclass
class Item:
    name: str
    columns: list[tuple[str, SqlType]]
    read: Callable[[], DataFrame] | None = None
    sql: str | None = None
    context: str | None = None
    system: bool = False


def schema_of(columns: list[tuple[str, SqlType]]) -> ST.StructType:
    return ST.StructType([ST.StructField(n, spark_type(t)) for n, t in columns])


class Files:
    """Small file operations through Hadoop's file systems, so that any store that Spark reads will do."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def read(self, path: str) -> str | None:
        fs, p = self.at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, path: str) -> list[str]:
        fs, p = self.at(path)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def changed(self, path: str) -> float:
        """Seconds since 1970 of the last change of a file or folder."""
        fs, p = self.at(path)
        return fs.getFileStatus(p).getModificationTime() / 1000

    def create(self, path: str, text: str) -> bool:
        """A new file, written aside and renamed; False where there is one of that name."""
        fs, aside = self.at(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        _, p = self.at(path)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf)
        options = self.jvm.org.apache.hadoop.fs.Options
        rename = getattr(options, "Rename")
        none = self.jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 0)
        try:
            context.rename(aside, p, none)
        except Exception as e:
            fs.delete(aside, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        fs, p = self.at(path)
        fs.delete(p, True)


#: Catalog files that are kept behind the latest, for engines that are reading one.
KEPT = 16


class Catalog:
    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location, self.files = spark, location.rstrip("/"), Files(spark)
        self.attached: dict[tuple[str, str], Item] = {}
        self.number, self.state = -1, {"next_id": len(SYSTEM_TABLES) + 1, "databases": {d: {} for d in INITIAL}}
        self.refresh()

    def _file(self, number: int) -> str:
        return f"{self.location}/catalog/{number:012d}.json"

    def _numbers(self) -> list[int]:
        return sorted(int(n[:12]) for n in self.files.names(f"{self.location}/catalog") if re.fullmatch(r"\d{12}\.json", n))

    def refresh(self) -> None:
        """See what other engines have changed."""
        numbers = self._numbers()
        if numbers and numbers[-1] != self.number:
            self.state, self.number = json.loads(self.files.read(self._file(numbers[-1]))), numbers[-1]

    def change(self, apply) -> None:
        """apply(state) on the latest state, made the next; done again if another engine was faster."""
        while True:
            self.refresh()
            state = json.loads(json.dumps(self.state))
            apply(state)
            if self.files.create(self._file(self.number + 1), json.dumps(state)):
                self.state, self.number = state, self.number + 1
                for old in self._numbers():
                    if old < self.number - KEPT:
                        self.files.delete(self._file(old))
                return

    def vacuum(self, seconds: float = 7 * 24 * 3600) -> int:
        """Remove parts that no table has and that are older than that; how many. Results that still read them fail from then on."""
        self.refresh()
        live = {p for tables in self.state["databases"].values() for e in tables.values() for p in e.get("parts", ())}
        gone = [p for p in self.files.names(f"{self.location}/parts") if p not in live and self.files.changed(self._part(p)) < time.time() - seconds]
        for p in gone:
            self.files.delete(self._part(p))
        return len(gone)

    # Look-ups

    def database(self, name: str) -> dict:
        if name not in self.state["databases"]:
            raise SqlError(f"Database {name} not found")
        return self.state["databases"][name]

    def find(self, database: str, name: str) -> Item:
        if (database, name) in self.attached:
            return self.attached[database, name]
        if database == SYSTEM and name in SYSTEM_TABLES:
            return Item(name, SYSTEM_TABLES[name], lambda: self.system_table(name), system=True)
        found = self.database(database).get(name)
        if found is None:
            raise SqlError(f"Table {database}.{name} not found")
        columns = [(n, parse_type(t)) for n, t in found["columns"]]
        if found["type"] == "view":
            return Item(name, columns, sql=found["sql"], context=found["context"])
        parts = [self._part(p) for p in found["parts"]]
        return Item(name, columns, lambda: self.spark.read.schema(schema_of(columns)).parquet(*parts) if parts else self.spark.createDataFrame([], schema_of(columns)))

    def attach(self, name: str, columns: list[tuple[str, SqlType]], read: Callable[[], DataFrame], database: str = "default") -> None:
        """A read-only table of this session's engine over a DataFrame."""
        self.attached[database, name] = Item(name, columns, read, system=True)

    def _part(self, name: str) -> str:
        return f"{self.location}/parts/{name}"

    def size(self, database: str, name: str) -> int:
        """Bytes of a table's files."""
        return sum(fs.getContentSummary(p).getLength() for fs, p in (self.files.at(self._part(x)) for x in self.database(database)[name]["parts"]))

    def names(self, database: str) -> list[str]:
        own = set(self.database(database)) | {n for d, n in self.attached if d == database}
        return sorted(own | (set(SYSTEM_TABLES) if database == SYSTEM else set()))

    def system_table(self, name: str) -> DataFrame:
        rows = []
        if name == "databases":
            rows = [(d,) for d in sorted(self.state["databases"])]
        else:
            known = [(SYSTEM, n, {"type": "table", "id": i + 1, "columns": [(c, str(t)) for c, t in SYSTEM_TABLES[n]]}, True) for i, n in enumerate(SYSTEM_TABLES)]
            known += [(d, n, e, False) for d, tables in self.state["databases"].items() for n, e in tables.items()]
            if name == "tables":
                rows = [(d, n, e["type"], e.get("sql"), e.get("context"), e.get("id"), json.dumps(e["columns"], separators=(",", ":")), s) for d, n, e, s in known]
            else:
                rows = [(e["id"], len(e["columns"]), json.dumps(["ASC"] * len(e["columns"]), separators=(",", ":"))) for _, _, e, _ in known if e["type"] == "table"]
        return self.spark.createDataFrame(rows, schema_of(SYSTEM_TABLES[name]))

    # Changes

    def create_database(self, name: str) -> None:
        def apply(state):
            if name in state["databases"]:
                raise SqlError(f"Database {name} exists already")
            state["databases"][name] = {}

        self.change(apply)

    def drop_database(self, name: str) -> None:
        def apply(state):
            if self._tables(state, name) or name == SYSTEM:
                raise SqlError(f"Database {name} is not empty")
            del state["databases"][name]

        self.change(apply)

    @staticmethod
    def _tables(state: dict, database: str) -> dict:
        if database not in state["databases"]:
            raise SqlError(f"Database {database} not found")
        return state["databases"][database]

    def _add(self, database: str, name: str, entry: dict) -> None:
        def apply(state):
            tables = self._tables(state, database)
            if name in self.names(database):
                raise SqlError(f"Table {database}.{name} exists already")
            if entry["type"] == "table":
                entry["id"] = state["next_id"]
                state["next_id"] += 1
            tables[name] = entry

        self.change(apply)

    def create_table(self, database: str, name: str, columns: list[tuple[str, SqlType]]) -> None:
        if len({n for n, _ in columns}) != len(columns):
            raise SqlError(f"Table {name} has a column twice")
        self._add(database, name, {"type": "table", "parts": [], "columns": [(n, str(t)) for n, t in columns]})

    def create_view(self, database: str, name: str, columns, sql: str, context: str) -> None:
        self._add(database, name, {"type": "view", "sql": sql, "context": context, "columns": [(n, str(t)) for n, t in columns]})

    def drop(self, database: str, name: str) -> None:
        def apply(state):
            if self._tables(state, database).pop(name, None) is None:
                raise SqlError(f"Table {database}.{name} not found")

        self.change(apply)

    def _written(self, entry: dict, rows: DataFrame) -> str:
        part = f"{entry['id']}-{uuid.uuid4().hex}"
        insert_rows(rows.to(schema_of([(n, parse_type(t)) for n, t in entry["columns"]])), self._part(part))
        return part

    def append(self, database: str, name: str, rows: DataFrame) -> None:
        """A new part, which all readers see at once or not at all."""
        before = self.database(database)[name]
        part = self._written(before, rows)

        def apply(state):
            entry = self._tables(state, database).get(name)
            if entry is None or entry.get("id") != before["id"]:
                raise SqlError(f"Table {database}.{name} not found")
            entry["parts"].append(part)

        self.change(apply)

    def replace(self, database: str, name: str, rows: DataFrame) -> None:
        """One new part in the place of all that `rows` was computed from; an error if others have changed the table since."""
        before = self.database(database)[name]
        part = self._written(before, rows)

        def apply(state):
            entry = self._tables(state, database).get(name)
            if entry is None or entry.get("id") != before["id"] or entry["parts"] != before["parts"]:
                raise SqlError(f"Table {database}.{name} was changed meanwhile; nothing was done")
            entry["parts"] = [part]

        self.change(apply)
