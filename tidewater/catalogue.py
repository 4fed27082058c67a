"""Registered queries over the test tables, each with its SQL counterpart.

Money columns are cast to DECIMAL(12,2) and times to DATE first, so that
results are exact whatever the order of summation.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from tidewater.functions import types as T
from tidewater.operators import relational as O
from tidewater.plans.analyze import Analyzer
from tidewater.plans.parser import parse
from tidewater.plans.physical import Planner
from tidewater.session import Engine
from tidewater.streaming.changelog import grouped_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The columns that queries see, by table: money and dates in exact types.
MONEY = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "c_acctbal", "s_acctbal", "o_totalprice", "p_retailprice", "value")
DATES = ("l_shipdate", "o_orderdate")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def exact(df: DataFrame) -> DataFrame:
    columns = []
    for f in df.schema:
        c = F.col(f.name)
        if f.name in MONEY:
            c = c.cast("decimal(12,2)")
        elif f.name in DATES:
            c = c.cast("date")
        elif isinstance(f.dataType, ST.TimestampType):
            c = c.cast("timestamp_ntz")
        columns.append(c.alias(f.name))
    return df.select(*columns)


class Tables:
    """The test tables as a catalog for the analyzer; props of events is JSON."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def find(self, database: str, name: str):
        from tidewater.catalog import Item

        if name not in TABLES:
            raise T.SqlError(f"Table {name} not found")
        df = exact(O.scan_table(self.spark, f"{self.sf_dir}/{name}.parquet"))
        columns = [(f.name, T.JSON if f.name == "props" else T.sql_type(f.dataType)) for f in df.schema]
        return Item(name, columns, lambda: df, system=True)


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query of the dialect over the test tables."""
    plan = Analyzer(Tables(spark, sf_dir), "default").query(parse(text).args["query"])
    return Planner(spark).frame(plan)


def dialect(name: str, text: str, sql: str | None) -> None:
    """Register a query given in the dialect."""
    QUERIES[name] = lambda spark, sf_dir, text=text: run_sql(spark, sf_dir, text)
    if sql is not None:
        SQL[name] = sql


def frame(name: str, sql: str | None):
    """Register a query given as a DataFrame function of (table reader)."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, lambda t: exact(O.scan_table(spark, f"{sf_dir}/{t}.parquet")))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


_M = "CAST({} AS DECIMAL(12,2))".format
_LI = f"(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_M('l_quantity')} AS l_quantity, {_M('l_extendedprice')} AS l_extendedprice, {_M('l_discount')} AS l_discount, {_M('l_tax')} AS l_tax, l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem)"
_OR = f"(SELECT o_orderkey, o_custkey, o_orderstatus, {_M('o_totalprice')} AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders)"
_CU = f"(SELECT c_custkey, c_name, c_nationkey, {_M('c_acctbal')} AS c_acctbal, c_mktsegment FROM customer)"
# Averages are compared at 6 digits: DuckDB's quotient of decimals is a double.


def _round6(text: str) -> str:
    return f"ROUND(CAST(SUM({text}) AS DOUBLE) / COUNT({text}), 6)"


# TPC-H

Q1 = """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base_price,
  sum(l_extendedprice * (1 - l_discount)) AS sum_disc_price, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS sum_charge,
  avg(l_quantity) AS avg_qty, avg(l_extendedprice) AS avg_price, avg(l_discount) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= date_sub(DATE '1998-12-01', 90)
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus
"""
Q3 = """
SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue, o_orderdate, o_orderpriority
FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1995-03-15' AND l_shipdate > DATE '1995-03-15'
GROUP BY l_orderkey, o_orderdate, o_orderpriority ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10
"""
Q5 = """
SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue
FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
  AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'
GROUP BY n_name ORDER BY revenue DESC
"""
Q6 = """
SELECT sum(l_extendedprice * l_discount) AS revenue FROM lineitem
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.06 - 0.01 AND 0.06 + 0.01 AND l_quantity < 24
"""
Q10 = """
SELECT c_custkey, c_name, sum(l_extendedprice * (1 - l_discount)) AS revenue, c_acctbal, n_name
FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-04-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20
"""


def _q1(spark, sf_dir):
    df = run_sql(spark, sf_dir, Q1)
    return df.select(*[F.round(F.col(c).cast("double"), 6).alias(c) if c.startswith("avg_") else F.col(c) for c in df.columns])


QUERIES["tpch_q1"] = _q1
SQL["tpch_q1"] = f"""
SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DECIMAL(28,2)) AS sum_qty, CAST(sum(l_extendedprice) AS DECIMAL(28,2)) AS sum_base_price,
  CAST(sum(l_extendedprice * (1 - l_discount)) AS DECIMAL(28,4)) AS sum_disc_price, CAST(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS DECIMAL(28,6)) AS sum_charge,
  {_round6("l_quantity")} AS avg_qty, {_round6("l_extendedprice")} AS avg_price, {_round6("l_discount")} AS avg_disc, CAST(count(*) AS BIGINT) AS count_order
FROM {_LI} WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus
"""
dialect("tpch_q3", Q3, f"""
SELECT l_orderkey, CAST(sum(l_extendedprice * (1 - l_discount)) AS DECIMAL(28,4)) AS revenue, o_orderdate, o_orderpriority FROM {_CU}, {_OR}, {_LI}
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1995-03-15' AND l_shipdate > DATE '1995-03-15'
GROUP BY l_orderkey, o_orderdate, o_orderpriority ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10
""")
dialect("tpch_q5", Q5, f"""
SELECT n_name, CAST(sum(l_extendedprice * (1 - l_discount)) AS DECIMAL(28,4)) AS revenue FROM {_CU}, {_OR}, {_LI}, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
  AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY n_name
""")
dialect("tpch_q6", Q6, f"""
SELECT CAST(sum(l_extendedprice * l_discount) AS DECIMAL(28,4)) AS revenue FROM {_LI}
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24
""")
dialect("tpch_q10", Q10, f"""
SELECT c_custkey, c_name, CAST(sum(l_extendedprice * (1 - l_discount)) AS DECIMAL(28,4)) AS revenue, c_acctbal, n_name FROM {_CU}, {_OR}, {_LI}, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-04-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20
""")

# Relational operators

dialect("scan_table", "SELECT * FROM nation", "SELECT * FROM nation")
dialect("single_row", "SELECT 1 AS a, 'x' AS b, 1.5 AS c", "SELECT CAST(1 AS INTEGER) AS a, 'x' AS b, CAST(1.5 AS DECIMAL(2,1)) AS c")
dialect("project_expr", "SELECT s_suppkey, s_nationkey + 1 AS next, s_name FROM supplier", "SELECT s_suppkey, s_nationkey + 1 AS next, s_name FROM supplier")
dialect("project_star", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n_regionkey = r_regionkey", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n_regionkey = r_regionkey")
dialect("filter_pred", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000.00", f"SELECT o_orderkey FROM {_OR} WHERE o_orderstatus = 'F' AND o_totalprice > 1000.00")
_NULLABLE = "if(o_custkey / 7 * 7 = o_custkey, null, o_custkey)"
_NULLABLE_SQL = "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END"
dialect("filter_strict_or", f"SELECT o_orderkey FROM (SELECT o_orderkey, o_orderstatus, {_NULLABLE} AS k FROM orders) t WHERE k > 500 OR o_orderstatus = 'F'", f"SELECT o_orderkey FROM (SELECT o_orderkey, o_orderstatus, {_NULLABLE_SQL} AS k FROM orders) WHERE k IS NOT NULL AND (k > 500 OR o_orderstatus = 'F')")
dialect("between_pred", "SELECT o_orderkey, o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AS inside FROM orders", f"SELECT o_orderkey, o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AS inside FROM {_OR}")
dialect("cross_join_where", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
dialect("cross_join", "SELECT n_name, r_name FROM nation, region", "SELECT n_name, r_name FROM nation, region")
dialect("inner_join_equi", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
dialect("inner_join_residual", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > c_acctbal", f"SELECT o_orderkey, c_name FROM {_OR} JOIN {_CU} ON o_custkey = c_custkey AND o_totalprice > c_acctbal")
dialect("inner_join_theta", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_regionkey", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_regionkey")
_FEW = "(SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < DATE '1995-06-01') o"
_FEW_SQL = f"(SELECT * FROM {_OR} WHERE o_orderstatus = 'F' AND o_orderdate < DATE '1995-06-01') o"
dialect("left_join_equi", f"SELECT c_custkey, o_orderkey FROM customer LEFT JOIN {_FEW} ON c_custkey = o_custkey", f"SELECT c_custkey, o_orderkey FROM customer LEFT JOIN {_FEW_SQL} ON c_custkey = o_custkey")
dialect("left_join_residual", f"SELECT c_custkey, o_orderkey FROM customer LEFT OUTER JOIN {_FEW} ON c_custkey = o_custkey AND o_totalprice > c_acctbal", f"SELECT c_custkey, o_orderkey FROM {_CU} LEFT JOIN {_FEW_SQL} ON c_custkey = o_custkey AND o_totalprice > c_acctbal")
dialect("left_join_theta", "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_nationkey < r_regionkey", "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_nationkey < r_regionkey")
dialect("left_join_false", "SELECT n_name, r_name FROM nation LEFT JOIN region ON false", "SELECT n_name, r_name FROM nation LEFT JOIN region ON false")
dialect("left_join_anti_idiom", f"SELECT c_custkey FROM customer LEFT JOIN {_FEW} ON c_custkey = o_custkey WHERE o_orderkey IS NULL", f"SELECT c_custkey FROM customer LEFT JOIN {_FEW_SQL} ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
dialect("table_alias", "SELECT t.k FROM (SELECT n_nationkey AS k FROM nation) AS t", "SELECT n_nationkey AS k FROM nation")
dialect("group_hash", f"SELECT {_NULLABLE} AS k, count(*) AS n FROM orders GROUP BY {_NULLABLE}", f"SELECT {_NULLABLE_SQL} AS k, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
dialect("group_expr_tree", "SELECT o_orderstatus, sum(o_totalprice) / count(*) + 1 AS x FROM orders GROUP BY o_orderstatus", f"SELECT o_orderstatus, CAST(ROUND(CAST(sum(o_totalprice) AS DOUBLE) / count(*) + 1, 4) AS DOUBLE) AS x FROM {_OR} GROUP BY o_orderstatus")
_tree = QUERIES["group_expr_tree"]
QUERIES["group_expr_tree"] = lambda spark, sf_dir: _tree(spark, sf_dir).withColumn("x", F.round(F.col("x").cast("double"), 4))
dialect("group_global", "SELECT count(*) AS n, sum(o_totalprice) AS s FROM orders", f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(o_totalprice) AS DECIMAL(28,2)) AS s FROM {_OR}")
dialect("group_global_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s FROM orders WHERE o_orderkey < 0", "SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS DECIMAL(28,2)) AS s")
dialect("group_sorted", "SELECT k, count(*) AS n FROM (SELECT o_custkey AS k FROM orders ORDER BY k) t GROUP BY k", "SELECT o_custkey AS k, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
dialect("group_first_value", "SELECT n_regionkey, r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey", "SELECT n_regionkey, min(r_name) AS r_name, CAST(count(*) AS BIGINT) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey")
dialect("agg_count_star", "SELECT count(*) AS n FROM lineitem", "SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem")
dialect("agg_count_col", f"SELECT count(k) AS n FROM (SELECT {_NULLABLE} AS k FROM orders) t", f"SELECT CAST(count({_NULLABLE_SQL}) AS BIGINT) AS n FROM orders")
dialect("agg_sum_int", "SELECT n_regionkey, sum(n_nationkey) AS s FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(sum(n_nationkey) AS INTEGER) AS s FROM nation GROUP BY 1")
dialect("agg_sum_bigint", "SELECT sum(l_orderkey) AS s FROM lineitem", "SELECT CAST(sum(l_orderkey) AS BIGINT) AS s FROM lineitem")
dialect("agg_sum_decimal", "SELECT l_returnflag, sum(l_extendedprice) AS s FROM lineitem GROUP BY l_returnflag", f"SELECT l_returnflag, CAST(sum(l_extendedprice) AS DECIMAL(28,2)) AS s FROM {_LI} GROUP BY 1")


def _exact_avg(column: str, scale: int) -> str:
    """SQL of an average to 14 digits, rounded half up, in whole numbers."""
    whole = f"((2 * CAST(sum(CAST({column} * {10**scale} AS HUGEINT)) AS HUGEINT) * {10 ** (14 - scale)} + count({column})) // (2 * count({column})))"
    return f"CAST(({whole} // 100000000000000)::VARCHAR || '.' || lpad(({whole} % 100000000000000)::VARCHAR, 14, '0') AS DECIMAL(28,14))"


dialect("agg_avg", "SELECT l_returnflag, avg(l_linenumber) AS i, avg(l_orderkey) AS b, avg(l_tax) AS d FROM lineitem GROUP BY l_returnflag", f"SELECT l_returnflag, {_exact_avg('l_linenumber', 0)} AS i, {_exact_avg('l_orderkey', 0)} AS b, {_exact_avg('l_tax', 2)} AS d FROM {_LI} GROUP BY 1")
dialect("sort_total", "SELECT o_orderstatus, o_orderkey FROM orders ORDER BY o_orderstatus DESC LIMIT 50", "SELECT o_orderstatus, o_orderkey FROM orders ORDER BY o_orderstatus DESC NULLS LAST, o_orderkey LIMIT 50")
dialect("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20")
dialect("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", f"SELECT o_orderkey, o_totalprice FROM {_OR} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
dialect("union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")


@frame("values_rows", "SELECT * FROM (VALUES (CAST(1 AS INTEGER), 'a'), (2, NULL), (NULL, 'b')) t(k, v)")
def _values(spark, read):
    return O.values_rows(spark, [(1, "a"), (2, None), (None, "b")], ST.StructType([ST.StructField("k", ST.IntegerType()), ST.StructField("v", ST.StringType())]))


@frame("insert_bag", "SELECT n_regionkey AS k, CAST(2 * count(*) AS BIGINT) AS n FROM nation GROUP BY 1")
def _insert(spark, read):
    n = O.weighted(read("nation").select("n_regionkey"))
    return O.consolidate(n.unionAll(n)).select(F.col("n_regionkey").alias("k"), F.col(O.FREQ).alias("n"))


@frame("delete_bag", "SELECT o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 3 IS NULL")
def _delete(spark, read):
    return O.delete_where(read("orders"), F.col("o_orderkey") % 3 == 0).select("o_orderstatus")


@frame("delete_limit_bag", "SELECT n_regionkey FROM nation UNION ALL SELECT n_regionkey FROM (SELECT n_regionkey, row_number() OVER (ORDER BY n_regionkey) AS r FROM nation WHERE n_regionkey >= 1) WHERE r > 3")
def _delete_limit(spark, read):
    bag = read("nation").select("n_regionkey")
    bag = bag.unionAll(bag.where("n_regionkey >= 1"))
    victims = O.limit_offset(O.sort_total(bag.where("n_regionkey >= 1"), []), 3)
    return O.delete_rows(bag, victims)


@frame("negate_freq", "SELECT n_regionkey, CAST(count(*) - 2 * count(*) FILTER (WHERE n_nationkey % 2 = 0) AS BIGINT) AS _freq FROM nation GROUP BY 1 HAVING count(*) <> 2 * count(*) FILTER (WHERE n_nationkey % 2 = 0)")
def _negate(spark, read):
    """Rows of even keys go twice, so that some multiplicities are negative."""
    n = read("nation")
    even = O.weighted(n.where("n_nationkey % 2 = 0").select("n_regionkey"), 2)
    return O.consolidate(O.weighted(n.select("n_regionkey")).unionAll(O.negate(even)))


@frame("expand_freq", "SELECT n_name FROM nation, range(1, 10) t(i) WHERE i <= n_regionkey")
def _expand(spark, read):
    return O.expand(read("nation").select("n_name", F.col("n_regionkey").cast("long").alias(O.FREQ)))


@frame("view_inline", "SELECT n_name, n FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT n_regionkey AS k, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY 1) b USING (k)")
def _view(spark, read):
    from tidewater.catalog import Item

    class Views:
        def find(self, database, name):
            if name == "nation":
                df = read("nation")
                return Item(name, [(f.name, T.sql_type(f.dataType)) for f in df.schema], lambda: df)
            return Item(name, [], sql="SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey", context="elsewhere")

    plan = Analyzer(Views(), "default").query(parse("SELECT n_name, n FROM nation JOIN per_region v ON n_regionkey = v.k").args["query"])
    return Planner(spark).frame(plan)


# Statements, each on an engine of its own over a folder that goes when the driver ends.


def shared_folder(spark: SparkSession) -> str:
    path = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')}/tidewater-sql-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session is already gone
            pass

    atexit.register(drop)
    return path


def statements(name: str, sql: str, *texts: str) -> None:
    """Register the result of the last of some statements; {folder} is a folder of CSV files of customer. Test tables are there to be read."""

    def run(spark, sf_dir):
        folder = shared_folder(spark)
        engine = Engine(spark, f"{folder}/tables")
        tables = Tables(spark, sf_dir)
        for t in ("nation", "orders", "customer"):
            engine.attach(t, tables.find("default", t).read())
        if any("{folder}" in t for t in texts):
            tables.find("default", "customer").read().select("c_custkey", "c_name", "c_mktsegment").write.csv(f"{folder}/csv")
        session = engine.session()
        for t in texts[:-1]:
            session.sql(t.replace("{folder}", f"{folder}/csv"))
        return session.sql(texts[-1].replace("{folder}", f"{folder}/csv"))

    QUERIES[name], SQL[name] = run, sql


_NEW = "CREATE TABLE t (k INT, name TEXT)"
_FILL = "INSERT INTO t SELECT n_regionkey, n_name FROM nation"
statements("file_scan_csv", "SELECT c_custkey AS k, c_name AS name FROM customer", "SELECT CAST(data->>'$[0]' AS BIGINT) AS k, data->>'$[1]' AS name FROM DIRECTORY '{folder}'")
statements("insert_from_directory", "SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey < 100", "CREATE TABLE t (k BIGINT, name TEXT)", "INSERT INTO t SELECT CAST(data->>'$[0]' AS BIGINT), data->>'$[1]' FROM DIRECTORY '{folder}' WITH (DELIMITER=',')", "SELECT * FROM t WHERE k < 100")
statements("insert_values", "SELECT * FROM (VALUES (1, 'x'), (2, NULL), (2, NULL)) t(k, name)", _NEW, "INSERT INTO t VALUES (1, 'x'), (2, NULL), (2, NULL)", "SELECT * FROM t")
statements("insert_select", "SELECT n_regionkey AS k, n_name AS name FROM nation, range(2)", _NEW, _FILL, _FILL, "SELECT * FROM t")
statements("insert_is_empty_result", "SELECT CAST(count(*) AS BIGINT) AS n FROM nation WHERE n_regionkey < 0", _NEW, _FILL, "DELETE FROM t", "SELECT count(*) AS n FROM t")
statements("delete_where", "SELECT n_regionkey AS k, n_name AS name FROM nation WHERE n_regionkey <> 1", _NEW, _FILL, "DELETE FROM t WHERE k = 1", "SELECT * FROM t")
statements("delete_limit", "SELECT CAST(count(*) - 3 AS BIGINT) AS n, CAST(count(*) FILTER (WHERE n_regionkey = 1) - 3 AS BIGINT) AS ones FROM nation", _NEW, _FILL, "DELETE FROM t WHERE k = 1 LIMIT 3", "SELECT count(*) AS n, count(if(k = 1, 1, NULL)) AS ones FROM t")
statements("compact_table", "SELECT n_regionkey AS k, n_name AS name FROM nation, range(2)", _NEW, _FILL, _FILL, "COMPACT TABLE t", "SELECT * FROM t")
statements("stored_view", "SELECT n_name AS name, CAST(n AS BIGINT) AS n FROM nation JOIN (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1) ON n_regionkey = k", "CREATE DATABASE other", "CREATE VIEW other.v AS SELECT n_regionkey AS k, count(*) AS n FROM default.nation GROUP BY n_regionkey", "SELECT n_name AS name, n FROM nation JOIN other.v ON n_regionkey = k")
statements("drop_and_create", "SELECT 7 AS z", _NEW, _FILL, "DROP TABLE t", "CREATE TABLE t (z INT)", "INSERT INTO t VALUES (7)", "SELECT * FROM t")
statements("use_database", "SELECT 'other' AS d, 5 AS k", "CREATE DATABASE other", "USE other", "CREATE TABLE t (k INT)", "INSERT INTO t VALUES (5)", "SELECT database() AS d, k FROM t")
statements("drop_database", "SELECT * FROM (VALUES ('default'), ('information_schema'), ('system')) t(name)", "CREATE DATABASE other", "DROP DATABASE other", "SHOW DATABASES")
statements("show_tables", "SELECT * FROM (VALUES ('customer'), ('nation'), ('orders'), ('t'), ('v')) t(name)", _NEW, "CREATE VIEW v AS SELECT k FROM t", "SHOW TABLES")
statements("show_functions", "SELECT unnest(['*', '+', '-', '->', '->>', '/', '<', '<=', '=', '>', '>=', '!=', 'and', 'avg', 'between', 'coalesce', 'count', 'database', 'date_sub', 'if', 'isfalse', 'isnull', 'istrue', 'json_extract', 'json_unquote', 'not', 'or', 'sum', 'to_bigint', 'to_bool', 'to_date', 'to_decimal', 'to_int', 'to_json', 'to_jsonpath', 'to_text', 'to_timestamp', 'type_of']) AS name", "SHOW FUNCTIONS")
statements("explain_statement", "SELECT * FROM (VALUES ('PROJECT', '', '', ''), (' |output_exprs:', '', '', ''), (' |  _col1', '0', 'INTEGER', '7'), (' |source:', '', '', ''), (' |  SINGLE', '', '', '')) t(tree, col_idx, datatype, expression)", "EXPLAIN SELECT 1 + 2 * 3")
statements("system_tables", "SELECT * FROM (VALUES ('t', 'table'), ('v', 'view')) t(name, type)", _NEW, "CREATE VIEW v AS SELECT k FROM t", "SELECT name, type FROM system.tables WHERE system IS FALSE")
statements("names_and_variables", "SELECT 16777215 AS a, '' AS b, 2 AS _col3, n_name FROM nation", "SELECT @@max_allowed_packet AS a, @@socket AS b, 1 + 1, `N_Name` -- a comment\n FROM /* another */ Nation")
statements("limit_forms", "SELECT n_nationkey FROM nation ORDER BY 1 LIMIT 4 OFFSET 3", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 3, 4")
statements("limit_offset_word", "SELECT n_nationkey FROM nation ORDER BY 1 LIMIT 4 OFFSET 3", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 4 OFFSET 3")


@frame("maintained_view", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(v) AS BIGINT) AS count_v, CAST(sum(v) AS DECIMAL(38,2)) AS sum_v FROM (SELECT event_type, event_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(value AS DECIMAL(12,2)) END AS v FROM events) WHERE event_id % 3 <> 0 GROUP BY 1")
def _maintained(spark, read):
    """Every event comes, and one in three goes again."""
    e = read("events").select("event_type", "event_id", F.when(F.col("user_id") % 5 == 0, None).otherwise(F.col("value")).alias("v"))
    feed = O.weighted(e).unionByName(O.weighted(e.where("event_id % 3 = 0"), -1))
    return grouped_view(feed, ["event_type"], ["v"]).withColumn("sum_v", F.col("sum_v").cast("decimal(38,2)"))


# Scalar functions

dialect("json_extract", "SELECT event_id, json_extract(props, '$.k') AS k FROM events", "SELECT event_id, CAST(props::JSON->'$.k' AS VARCHAR) AS k FROM events")
dialect("json_unquote", "SELECT event_id, json_unquote(props -> '$.k') AS k FROM events", "SELECT event_id, props::JSON->>'$.k' AS k FROM events")
dialect("json_extract_unquote", "SELECT event_id, props ->> '$.k' AS k FROM events", "SELECT event_id, props::JSON->>'$.k' AS k FROM events")
dialect("cast_bool", "SELECT o_orderkey, CAST(if(o_orderstatus = 'F', 'TRUE', if(o_orderstatus = 'O', 'false', 'x')) AS BOOLEAN) AS b FROM orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS b FROM orders")
dialect("cast_int", "SELECT o_orderkey, CAST(o_orderkey * 3000000000 AS INTEGER) AS wrapped, CAST(o_totalprice AS INTEGER) AS cut, CAST(o_orderpriority AS INTEGER) AS none FROM orders", f"SELECT o_orderkey, CAST(((o_orderkey * 3000000000 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS INTEGER) AS wrapped, CAST(trunc(o_totalprice) AS INTEGER) AS cut, CAST(NULL AS INTEGER) AS none FROM {_OR}")
dialect("cast_bigint", "SELECT o_orderkey, CAST(CAST(o_orderkey AS TEXT) AS BIGINT) AS b FROM orders", "SELECT o_orderkey, o_orderkey AS b FROM orders")
dialect("cast_decimal", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,1)) AS d, CAST('12.345' AS DECIMAL(10,2)) AS t FROM orders", f"SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,1)) AS d, CAST(12.35 AS DECIMAL(10,2)) AS t FROM {_OR}")
dialect("cast_text", "SELECT o_orderkey, CAST(o_orderkey AS TEXT) AS i, CAST(o_totalprice AS TEXT) AS d, CAST(o_orderdate AS TEXT) AS t, CAST(o_orderkey > 100 AS TEXT) AS b FROM orders", f"SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS i, CAST(o_totalprice AS VARCHAR) AS d, CAST(o_orderdate AS VARCHAR) AS t, upper(CAST(o_orderkey > 100 AS VARCHAR)) AS b FROM {_OR}")
dialect("cast_json", "SELECT o_orderkey, CAST('[1, {\"a\": 1.20}]' AS JSON) AS j, CAST(o_orderkey AS JSON) AS n, CAST('{' AS JSON) AS bad FROM orders", "SELECT o_orderkey, '[1,{\"a\":1.20}]' AS j, CAST(o_orderkey AS VARCHAR) AS n, CAST(NULL AS VARCHAR) AS bad FROM orders")
dialect("cast_date", "SELECT o_orderkey, CAST(CAST(o_orderdate AS TEXT) AS DATE) AS d, CAST('2010' AS DATE) AS bad FROM orders", f"SELECT o_orderkey, o_orderdate AS d, CAST(NULL AS DATE) AS bad FROM {_OR}")
dialect("cast_timestamp", "SELECT o_orderkey, CAST('2020-01-02T03:04:05.678' AS TIMESTAMP) AS t, CAST('x' AS TIMESTAMP) AS bad FROM orders", "SELECT o_orderkey, TIMESTAMP '2020-01-02 03:04:05.678' AS t, CAST(NULL AS TIMESTAMP) AS bad FROM orders")
for _name, _op in (("add", "+"), ("sub", "-"), ("mul", "*")):
    dialect(f"arith_{_name}", f"SELECT l_orderkey, l_linenumber, l_linenumber {_op} 2 AS i, l_orderkey {_op} l_linenumber AS b, l_tax {_op} l_discount AS d FROM lineitem", f"SELECT l_orderkey, l_linenumber, l_linenumber {_op} 2 AS i, l_orderkey {_op} l_linenumber AS b, CAST(l_tax {_op} l_discount AS {'DECIMAL(24,4)' if _op == '*' else 'DECIMAL(13,2)'}) AS d FROM {_LI}")
dialect("arith_div_int", "SELECT l_orderkey, l_linenumber, (l_linenumber - 5) / 2 AS i, (l_orderkey - 100) / 7 AS b FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(trunc((l_linenumber - 5) / 2) AS INTEGER) AS i, CAST(trunc((l_orderkey - 100) / 7) AS BIGINT) AS b FROM lineitem")


def _divide(spark, sf_dir):
    df = run_sql(spark, sf_dir, "SELECT l_orderkey, l_linenumber, l_extendedprice / (l_quantity + 1.00) AS d FROM lineitem")
    return df.withColumn("d", F.round(F.col("d").cast("double"), 9))


QUERIES["arith_div_dec"] = _divide
SQL["arith_div_dec"] = f"SELECT l_orderkey, l_linenumber, ROUND(CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity + 1 AS DOUBLE), 9) AS d FROM {_LI}"
for _name, _op in (("eq", "="), ("ne", "!="), ("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">=")):
    dialect(f"cmp_{_name}", f"SELECT o_orderkey, k {_op} 700 AS i, o_totalprice {_op} 5000.00 AS d, o_orderpriority {_op} '3' AS t, o_orderdate {_op} DATE '1996-01-01' AS x FROM (SELECT *, {_NULLABLE} AS k FROM orders) t", f"SELECT o_orderkey, ({_NULLABLE_SQL}) {_op} 700 AS i, o_totalprice {_op} 5000.00 AS d, o_orderpriority {_op} '3' AS t, o_orderdate {_op} DATE '1996-01-01' AS x FROM {_OR}")
_B = "if(o_custkey / 7 * 7 = o_custkey, null, o_custkey > 500)"
_B_SQL = "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey > 500 END"
for _name, _op in (("and", "AND"), ("or", "OR")):
    dialect(f"bool_{_name}", f"SELECT o_orderkey, {_B} {_op} o_orderstatus = 'F' AS b FROM orders", f"SELECT o_orderkey, CASE WHEN ({_B_SQL}) IS NULL THEN NULL ELSE ({_B_SQL}) {_op} o_orderstatus = 'F' END AS b FROM orders")
dialect("bool_not", f"SELECT o_orderkey, NOT {_B} AS b FROM orders", f"SELECT o_orderkey, NOT ({_B_SQL}) AS b FROM orders")
dialect("bool_istrue", f"SELECT o_orderkey, {_B} IS TRUE AS a, {_B} IS NOT TRUE AS b FROM orders", f"SELECT o_orderkey, coalesce(({_B_SQL}), false) AS a, NOT coalesce(({_B_SQL}), false) AS b FROM orders")
dialect("bool_isfalse", f"SELECT o_orderkey, {_B} IS FALSE AS a, {_B} IS NOT FALSE AS b FROM orders", f"SELECT o_orderkey, NOT coalesce(({_B_SQL}), true) AS a, coalesce(({_B_SQL}), true) AS b FROM orders")
dialect("bool_isnull", f"SELECT o_orderkey, {_B} IS NULL AS a, {_B} IS NOT NULL AS b FROM orders", f"SELECT o_orderkey, ({_B_SQL}) IS NULL AS a, ({_B_SQL}) IS NOT NULL AS b FROM orders")
dialect("coalesce_fn", f"SELECT o_orderkey, coalesce({_NULLABLE}, null, 0) AS k, coalesce(null, 'x') AS t FROM orders", f"SELECT o_orderkey, coalesce({_NULLABLE_SQL}, 0) AS k, 'x' AS t FROM orders")
dialect("if_fn", "SELECT o_orderkey, if(o_totalprice > 5000.00, 'high', 'low') AS t FROM orders", f"SELECT o_orderkey, CASE WHEN o_totalprice > 5000.00 THEN 'high' ELSE 'low' END AS t FROM {_OR}")
dialect("date_sub_fn", "SELECT o_orderkey, date_sub(o_orderdate, 90) AS d FROM orders", f"SELECT o_orderkey, CAST(o_orderdate - INTERVAL 90 DAY AS DATE) AS d FROM {_OR}")
dialect("type_of_fn", "SELECT type_of(o_orderkey) AS b, type_of(o_totalprice) AS d, type_of(o_orderkey + 1.50) AS x, type_of(null) AS n FROM orders LIMIT 1", "SELECT 'BIGINT' AS b, 'DECIMAL(12,2)' AS d, 'DECIMAL(23,2)' AS x, 'NULL' AS n")
dialect("database_fn", "SELECT database() AS d", "SELECT 'default' AS d")
dialect("jsonpath_fn", "SELECT event_id, json_extract(props, to_jsonpath('$.*')) AS k FROM events", "SELECT event_id, '[' || CAST(props::JSON->'$.k' AS VARCHAR) || ']' AS k FROM events")

