"""Statements of the dialect end to end: rows as text, in order."""

import datetime
import random
from collections import Counter
from decimal import Decimal

import pytest

from tidewater.functions.types import SqlError
from tidewater.session import Engine


def shown(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    return str(v)


def rows(session, text):
    return ["|".join(map(shown, r)) for r in session.sql(text).collect()]


@pytest.fixture()
def session(spark, tmp_path):
    return Engine(spark, str(tmp_path)).session()


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("SELECT 1, 'a' UNION ALL SELECT 2, \"b\"", ["1|a", "2|b"]),
        ("SELECT 1 WHERE false UNION ALL SELECT 2", ["2"]),
        ("SELECT 5 WHERE null", []),
        ("SELECT a FROM (SELECT 3 AS a UNION ALL SELECT 1 UNION ALL SELECT 2) ORDER BY a DESC LIMIT 2", ["3", "2"]),
        ("SELECT a FROM (SELECT 3 AS a UNION ALL SELECT 1 UNION ALL SELECT 2) ORDER BY a LIMIT 1, 5", ["2", "3"]),
        ("SELECT a FROM (SELECT 3 AS a UNION ALL SELECT 1 UNION ALL SELECT 2) ORDER BY a LIMIT 1 OFFSET 1", ["2"]),
        ("SELECT 2 AS a UNION ALL SELECT 1 ORDER BY _col1 LIMIT 1", ["2", "1"]),
        ("SELECT t.* FROM (SELECT 1 AS x, 2 AS y) AS t", ["1|2"]),
        ("SELECT `t`.`x` FROM (SELECT 1 AS X) t -- comment\n /* and */", ["1"]),
        ("SELECT true OR null, null AND false, false OR false, true AND true", ["NULL|NULL|FALSE|TRUE"]),
        ("SELECT NOT true OR true, NOT false AND false, NOT NOT true, true AND false OR true", ["TRUE|FALSE|TRUE|TRUE"]),
        ("SELECT 1 = 1 IS TRUE, 1 = null IS NOT TRUE, 1 = 2 IS FALSE = TRUE IS TRUE", ["TRUE|TRUE|TRUE"]),
        ("SELECT 2 BETWEEN 1 AND 3, 2 BETWEEN null AND 1, NOT 5 BETWEEN 1 AND 3", ["TRUE|NULL|TRUE"]),
        ("SELECT 1.2 = 1.20, 1 = 1.0, 'a' = 'A', null = null, 1 != 2", ["TRUE|TRUE|FALSE|NULL|TRUE"]),
        ("SELECT 1 + 2 * 3 - 4, 7 / 2, -7 / 2, 9000000000 / 7, 1.5 * 2.25", ["3|3|-3|1285714285|3.375"]),
        ("SELECT 7.0 / 2, 1 / 3.0", ["3.50000000000000|0.33333333333333"]),
        ("SELECT type_of(1), type_of(9123123123), type_of(200000000000000000000), type_of(12.34), type_of(.12), type_of('x'), type_of(null), type_of(true)", ["INTEGER|BIGINT|DECIMAL(21,0)|DECIMAL(4,2)|DECIMAL(2,2)|TEXT|NULL|BOOLEAN"]),
        ("SELECT type_of(1 + 9123123123), type_of(1 + 1.50), type_of(9123123123 + 1.50), type_of(1.5 * 2.25), type_of(1.5 / 2.25)", ["BIGINT|DECIMAL(13,2)|DECIMAL(23,2)|DECIMAL(5,3)|DECIMAL(28,14)"]),
        ("SELECT CAST('12' AS INT), CAST('12a' AS INT), CAST(' 12' AS INT), CAST(4294967297 AS INT), CAST(2.9 AS INT), CAST(3000000000.5 AS INT)", ["12|NULL|NULL|1|2|NULL"]),
        ("SELECT CAST('tRue' AS BOOLEAN), CAST('t' AS BOOLEAN), CAST(true AS TEXT), CAST(true AS INT), CAST(1.50 AS TEXT)", ["TRUE|NULL|TRUE|1|1.50"]),
        ("SELECT CAST('2.5' AS DECIMAL(10,2)), CAST('x' AS DECIMAL), CAST(2.567 AS DECIMAL(10,1)), CAST('2010-02-03' AS DATE), CAST('2010' AS DATE)", ["2.50|NULL|2.6|2010-02-03|NULL"]),
        ("SELECT date_sub(DATE '2020-03-01', 1), DATE '2020-03-01' > DATE '2019-01-01', if(null, 1, 2), coalesce(null, 1.5, 2.25)", ["2020-02-29|TRUE|2|1.50"]),
        ("SELECT CAST(CAST('2020-01-02T03:04:05.6789' AS TIMESTAMP) AS TEXT), CAST('2020-01-02 03:04' AS TIMESTAMP)", ["2020-01-02 03:04:05.678|NULL"]),
        ("SELECT json_extract(CAST('[[1,2],[3,4],[5,6]]' AS JSON), '$[*][1]'), CAST('[1,2]' AS JSON) -> '$[5]', CAST('{\"b\": 1.20, \"a\": null}' AS JSON)", ['[2,4,6]|NULL|{"b":1.20,"a":null}']),
        ("SELECT json_unquote(CAST('null' AS JSON)), json_unquote(CAST('\"te\\\\\"st\"' AS JSON)), CAST('{\"Ab\": \"x\"}' AS JSON) ->> '$.aB', json_unquote(null)", ['null|te"st|x|NULL']),
        ("SELECT CAST('{\"1\": \"k\"}' AS JSON) ->> '$[1]', CAST('[5,6]' AS JSON) ->> '$.1', CAST('[5,6]' AS JSON) ->> '$[\"0\"]', CAST('[5]' AS JSON) ->> '$[-1]'", ["k|6|5|NULL"]),
        ("SELECT CAST(CAST('12' AS JSON) AS INT), CAST(CAST('\"7\"' AS JSON) AS BIGINT), CAST(CAST('[1]' AS JSON) AS INT), CAST(CAST('true' AS JSON) AS BOOLEAN), CAST(CAST('1.25' AS JSON) AS DECIMAL(5,2))", ["12|7|NULL|TRUE|1.25"]),
        ("SELECT database(), @@max_allowed_packet, @@socket", ["default|16777215|"]),
        ("SELECT sum(a), count(*), count(a), avg(a) FROM (SELECT 1 AS a UNION ALL SELECT 1 UNION ALL SELECT null) t", None),
    ],
)
def test_expressions(session, text, expected):
    if expected is None:
        with pytest.raises(SqlError):  # branches must have the same types exactly
            session.sql(text)
    else:
        assert rows(session, text) == expected


def test_aggregates(session):
    session.sql("CREATE TABLE t (k TEXT, v INT)")
    session.sql("INSERT INTO t VALUES ('a', 1), ('a', 2), ('b', 3), ('b', null), ('c', null), (null, 2)")
    assert rows(session, "SELECT k, count(*), count(v), sum(v), avg(v) FROM t GROUP BY k ORDER BY k") == ["NULL|1|1|2|2.00000000000000", "a|2|2|3|1.50000000000000", "b|2|1|3|3.00000000000000", "c|1|0|NULL|NULL"]
    assert rows(session, "SELECT sum(v + 1) * 2 + count(v) FROM t") == ["28"]
    assert rows(session, "SELECT count(*), sum(v) FROM t WHERE false") == ["0|NULL"]
    assert rows(session, "SELECT v + 1, count(*) FROM t GROUP BY v + 1 ORDER BY _col1") == ["NULL|2", "2|1", "3|2", "4|1"]
    assert rows(session, "SELECT v, k FROM t WHERE k = 'b' GROUP BY k") == ["3|b"]
    assert [f.dataType.simpleString() for f in session.sql("SELECT sum(v), sum(v + 9000000000), sum(v + 1.5), avg(v) FROM t").schema] == ["int", "bigint", "decimal(28,1)", "decimal(28,14)"]
    assert session.sql("SELECT avg(x) AS a FROM (SELECT 1 AS x UNION ALL SELECT 1 UNION ALL SELECT 0) t").first()["a"] == Decimal("0.66666666666667")


def test_joins(session):
    session.sql("CREATE TABLE l (a INT, x TEXT)")
    session.sql("INSERT INTO l VALUES (1, 'p'), (1, 'q'), (2, 'r'), (3, 's'), (null, 't')")
    session.sql("CREATE TABLE r (b INT, y TEXT)")
    session.sql("INSERT INTO r VALUES (1, 'P'), (1, 'Q'), (2, 'R'), (4, 'S'), (null, 'T')")
    inner = ["1|p|1|P", "1|p|1|Q", "1|q|1|P", "1|q|1|Q", "2|r|2|R"]
    assert rows(session, "SELECT * FROM l, r WHERE a = b ORDER BY a, b") == inner
    assert rows(session, "SELECT * FROM l JOIN r ON a = r.b ORDER BY a, b") == inner
    assert rows(session, "SELECT * FROM l LEFT JOIN r ON a = b AND y = 'Q' ORDER BY x") == ["1|p|1|Q", "1|q|1|Q", "2|r|NULL|NULL", "3|s|NULL|NULL", "NULL|t|NULL|NULL"]
    assert rows(session, "SELECT x, y FROM l LEFT OUTER JOIN r ON a + b = 3 ORDER BY x, y") == ["p|R", "q|R", "r|P", "r|Q", "s|NULL", "t|NULL"]
    assert rows(session, "SELECT x, y FROM l LEFT JOIN r ON false ORDER BY x") == ["p|NULL", "q|NULL", "r|NULL", "s|NULL", "t|NULL"]
    assert rows(session, "SELECT l.* FROM l LEFT JOIN r ON a = b WHERE b IS NULL ORDER BY x") == ["3|s", "NULL|t"]
    assert rows(session, "SELECT x FROM l LEFT JOIN r ON a = b WHERE b = 2") == ["r"]
    assert rows(session, "SELECT count(*) FROM l, r, l AS m") == ["125"]
    assert rows(session, "SELECT m.x FROM l JOIN l AS m ON l.a = m.a AND l.x = m.x WHERE m.a = 2") == ["r"]
    with pytest.raises(SqlError, match="ambiguous"):
        session.sql("SELECT a FROM l JOIN l AS m ON l.a = m.a")


def test_filters_inside_and_outside_of_subqueries_both_hold(session):
    assert rows(session, "SELECT a FROM (SELECT a FROM (SELECT 1 AS a UNION ALL SELECT 2 UNION ALL SELECT 3) WHERE a > 1) WHERE a < 3") == ["2"]


@pytest.mark.parametrize(
    "text",
    ["SELECT nope", "SELECT 'a' + 1", "SELECT 1 WHERE 1", "SELECT count(*) WHERE count(*) = 1", "SELECT sum(sum(1))", "SELECT 1 FROM nowhere", "SELECT 1 +", "SELECT to_bytes('a')", "SELECT 1 UNION SELECT 1", "SELECT CAST(DATE '2020-01-01' AS DATE)", "DROP DATABASE system", "CREATE DATABASE default", "SELECT nope(1)", "SELECT x.* FROM (SELECT 1 AS a) y"],
)
def test_errors(session, text):
    with pytest.raises(SqlError):
        session.sql(text)


def test_tables_databases_and_views(session):
    session.sql("CREATE TABLE t (a INT, b TEXT, c DECIMAL(4,2), d BOOLEAN, e DATE, f JSON, g TIMESTAMP, h BIGINT)")
    session.sql("INSERT INTO t VALUES (1, 'x', 12.34, false, DATE '2020-01-02', null, null, null)")
    assert rows(session, "SELECT * FROM t") == ["1|x|12.34|FALSE|2020-01-02|NULL|NULL|NULL"]
    for bad in ("INSERT INTO t VALUES (1)", "INSERT INTO t VALUES (1.5, 'x', 12.34, false, null, null, null, null)", "INSERT INTO t SELECT 1", "INSERT INTO t VALUES (1, 'x', 12.34, false, null, null, null, 1)", "CREATE TABLE t (a INT)", "CREATE TABLE u (a INT, a INT)"):
        with pytest.raises(SqlError):
            session.sql(bad)
    session.sql("CREATE DATABASE other")
    session.sql("CREATE TABLE other.u (k TEXT)")
    session.sql("INSERT INTO other.u SELECT b FROM t")
    with pytest.raises(SqlError, match="not empty"):
        session.sql("DROP DATABASE other")
    session.sql("USE other")
    assert rows(session, "SELECT database(), k FROM u") == ["other|x"]
    session.sql("CREATE VIEW default.v AS SELECT k AS name FROM u WHERE k = 'x'")
    session.sql("USE default")
    assert rows(session, "SELECT v.name, b FROM v JOIN t ON name = b") == ["x|x"]
    assert rows(session, "SHOW TABLES") == ["t", "v"] and "other" in rows(session, "SHOW DATABASES")
    assert rows(session, "SELECT database_name, name, type FROM system.tables WHERE system IS FALSE ORDER BY name") == ["default|t|table", "other|u|table", "default|v|view"]
    again = Engine(session.spark, session.catalog.location).session()
    assert rows(again, "SELECT name FROM v") == ["x"]
    session.sql("COMPACT TABLE t")
    assert rows(session, "SELECT count(*) FROM t") == ["1"]
    session.sql("DROP TABLE v")
    session.sql("DROP TABLE other.u")
    session.sql("DROP DATABASE other")
    session.sql("DROP TABLE t")
    session.sql("CREATE TABLE t (z INT)")
    assert rows(session, "SELECT * FROM t") == []


def test_deletes_are_bag_exact(session):
    session.sql("CREATE TABLE t (a INT, b TEXT)")
    rng, bag = random.Random(4), Counter()
    for _ in range(4):
        new = [(rng.choice([1, 2, 3, None]), rng.choice(["x", "y"])) for _ in range(6)]
        session.sql("INSERT INTO t VALUES " + ", ".join(f"({'null' if a is None else a}, '{b}')" for a, b in new))
        bag.update(new)
        victim, limit = rng.choice([1, 2, 3]), rng.randint(0, 3)
        session.sql(f"DELETE FROM t WHERE a = {victim} LIMIT {limit}")
        for row in sorted((r for r in bag.elements() if r[0] == victim), key=lambda r: r[1])[:limit]:
            bag[row] -= 1
        assert Counter(tuple(r) for r in session.sql("SELECT * FROM t").collect()) == +bag
    session.sql("DELETE FROM t WHERE b = 'x' OR a = 1")
    want = Counter({r: n for r, n in bag.items() if n and not (r[0] is not None and (r[1] == "x" or r[0] == 1))})
    assert Counter(tuple(r) for r in session.sql("SELECT * FROM t").collect()) == want
    session.sql("DELETE FROM t")
    assert rows(session, "SELECT count(*) FROM t") == ["0"]


def test_results_outlive_later_writes(session):
    session.sql("CREATE TABLE t (a INT)")
    session.sql("INSERT INTO t VALUES (1), (2)")
    before = session.sql("SELECT a FROM t")
    session.sql("DELETE FROM t WHERE a = 1")
    between = session.sql("SELECT a FROM t")
    session.sql("INSERT INTO t VALUES (3)")
    session.sql("COMPACT TABLE t")
    session.sql("DROP TABLE t")
    assert sorted(r["a"] for r in before.collect()) == [1, 2] and [r["a"] for r in between.collect()] == [2]
    assert session.catalog.vacuum() == 0 and session.catalog.vacuum(0) == 4


def test_engines_share_a_folder(session):
    other = Engine(session.spark, session.catalog.location).session()
    session.sql("CREATE TABLE t (a INT)")
    other.sql("CREATE TABLE u (a INT)")
    other.sql("INSERT INTO t VALUES (1)")
    session.sql("INSERT INTO t VALUES (2)")
    assert sorted(rows(other, "SELECT a FROM t")) == ["1", "2"] and rows(session, "SHOW TABLES") == ["t", "u"]
    with pytest.raises(SqlError, match="exists"):
        session.sql("CREATE TABLE u (a INT)")
    current = session.catalog.find("default", "t").read()
    other.sql("INSERT INTO t VALUES (3)")
    with pytest.raises(SqlError, match="meanwhile"):
        session.catalog.replace("default", "t", current)
    assert sorted(rows(session, "SELECT a FROM t")) == ["1", "2", "3"]
    assert not session.catalog.files.create(session.catalog._file(session.catalog.number), "{}")


def test_csv_directory(session, tmp_path):
    d = tmp_path / "in" / "deep"
    d.mkdir(parents=True)
    (tmp_path / "in" / "a.csv").write_text('123,abc,12.1\n"456","d,ef","13.2"\n')
    (d / "b.csv").write_text('7,"q""uote",,long\n\n8\n')
    got = sorted(rows(session, f"SELECT data FROM DIRECTORY \"{tmp_path}/in\""))
    assert got == sorted(['["123","abc","12.1"]', '["456","d,ef","13.2"]', '["7","q\\"uote","","long"]', '["8"]'])
    assert sorted(rows(session, f"SELECT CAST(data->>'$[0]' AS INT) + 1, d.data->>'$[3]' FROM DIRECTORY '{tmp_path}/in' d")) == ["124|NULL", "457|NULL", "8|long", "9|NULL"]
    (tmp_path / "p.csv").write_text("1|x|\n2|y|\n")
    session.sql("CREATE TABLE t (a BIGINT, b TEXT)")
    session.sql(f"INSERT INTO t SELECT CAST(data->>'$[0]' AS BIGINT), data->>'$[1]' FROM DIRECTORY '{tmp_path}/p.csv' WITH (DELIMITER='|')")
    assert rows(session, "SELECT * FROM t ORDER BY a") == ["1|x", "2|y"]


def test_explain(session):
    def tree(text):
        return ["|".join(r) for r in session.sql("EXPLAIN " + text).collect()]

    assert tree("SELECT 1 + 2 * 3") == ["PROJECT|||", " |output_exprs:|||", " |  _col1|0|INTEGER|7", " |source:|||", " |  SINGLE|||"]
    assert tree("SELECT a FROM (SELECT 1 AS a) WHERE a = 1")[4:] == [" |  FILTER|||", " |   |predicate:|||", " |   |||BOOLEAN|TRUE", " |   |source:|||", " |   |  SINGLE|||"]
    session.sql("CREATE TABLE l (a INT, x TEXT)")
    session.sql("CREATE TABLE r (b INT, y TEXT)")
    got = tree("SELECT * FROM l, r WHERE a = r.b AND x = 'q' ORDER BY a LIMIT 3")
    assert got[:3] == ["LIMIT|||", " |limit: 3|||", " |offset: 0|||"]
    assert any(line.strip(" |").startswith("JOIN") for line in got)
    assert any("`=`(<OFFSET 0>, <OFFSET 3>)" in line for line in got) and any('`=`(<OFFSET 1>, "q")' in line for line in got)
    filters = [i for i, line in enumerate(got) if "FILTER" in line]
    assert len(filters) == 1 and "TABLE(l)" in "".join(got[filters[0] : filters[0] + 6])
    assert tree("DELETE FROM l WHERE a = 1")[:3] == ["INSERT|||", " |source:|||", " |  NEGATE|||"]


def test_plans_push_filters_and_columns_down(spark, tmp_path):
    session = Engine(spark, str(tmp_path)).session()
    session.sql("CREATE TABLE t (a INT, b TEXT, c INT)")
    session.sql("INSERT INTO t VALUES (1, 'x', 2), (2, 'y', 3)")
    plan = session.sql("SELECT c FROM (SELECT a, b, c FROM t) s WHERE a = 1 AND b = 'x'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(a,1)" in plan and "EqualTo(b,x)" in plan


def test_show_functions_is_sorted_and_complete(session):
    got = rows(session, "SHOW FUNCTIONS")
    assert got == sorted(got) and len(got) == 38 and {"->>", "avg", "to_jsonpath", "type_of"} <= set(got)


def test_explain_of_other_plans(session):
    session.sql("CREATE TABLE t (a INT, b TEXT)")
    lines = ["|".join(r) for r in session.sql("EXPLAIN SELECT b, sum(a) FROM t GROUP BY b").collect()]
    assert lines[0] == "GROUP|||" and " |group_keys:|||" in lines and " |  _col2|1|INTEGER|sum(<OFFSET 0>)" in lines
    lines = ["|".join(r) for r in session.sql("EXPLAIN INSERT INTO t VALUES (1, 'x')").collect()]
    assert lines == ["INSERT|||", " |source:|||", " |  VALUES|||"]
    lines = ["|".join(r) for r in session.sql("EXPLAIN SELECT data FROM DIRECTORY '/nowhere'").collect()]
    assert " |  FILE_SCAN|||" in lines and " |   |  data|0|JSON|" in lines


def test_dates_are_dates(session):
    assert session.sql("SELECT DATE '2020-03-01' AS d").first()["d"] == datetime.date(2020, 3, 1)
