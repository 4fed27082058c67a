"""Every registered query of the engine against its SQL in DuckDB, and change feeds against recomputation."""

import datetime
import decimal
import os
import random
from collections import Counter

import duckdb
import pytest

from tidewater import catalogue
from tidewater.operators import relational as O
from tidewater.streaming.changelog import grouped_view, join_changes, maintain

SF = "/root/testdata/sf0.001"


def value(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = Counter(tuple(value(r[c]) for c in sorted(df.columns)) for r in df.collect())
    made = oracle.execute(catalogue.SQL[name])
    names = [d[0] for d in made.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert got == Counter(tuple(value(r[i]) for i in at) for r in made.fetchall())


def test_changes_of_a_join(spark):
    rng = random.Random(3)
    make = lambda n: [(rng.randint(0, 4), rng.choice("xy"), rng.choice((1, 1, -1))) for _ in range(n)]
    left, dl, right, dr = make(20), make(6), make(20), make(6)
    frame = lambda rows, v: O.consolidate(spark.createDataFrame(rows, f"k int, {v} string, _freq long"))
    join = lambda a, b: a.withColumnRenamed("_freq", "f").join(b.withColumnRenamed("_freq", "g"), "k").selectExpr("k", "a", "b", "f * g AS _freq")
    bag = lambda df: {tuple(r)[:3]: r["_freq"] for r in O.consolidate(df).collect()}
    L, DL, R, DR = frame(left, "a"), frame(dl, "a"), frame(right, "b"), frame(dr, "b")
    before, after = bag(join(L, R)), bag(join(L.unionByName(DL), R.unionByName(DR)))
    change = bag(join_changes(L, DL, R, DR, ["k"]))
    keys = set(before) | set(after) | set(change)
    assert all(before.get(k, 0) + change.get(k, 0) == after.get(k, 0) for k in keys)


def test_maintained_view_over_a_stream(spark, tmp_path):
    rng, live, batches = random.Random(8), [], []
    for _ in range(3):
        batch = [(rng.choice("abc"), rng.choice([None, 1, 2, 5]), 1) for _ in range(10)]
        gone = [live.pop(rng.randrange(len(live))) for _ in range(min(len(live), 5))]
        live += [(k, v) for k, v, _ in batch]
        batches.append(batch + [(k, v, -1) for k, v in gone])
    schema = "k string, v long, _freq long"
    source = str(tmp_path / "feed")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(source)
    query = maintain(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), ["k"], ["v"], "live_view", str(tmp_path / "state"))
    try:
        query.processAllAvailable()
        got = {r["k"]: (r["n"], r["count_v"], r["sum_v"]) for r in spark.table("live_view").collect()}
    finally:
        query.stop()
    want = {}
    for k in {k for k, _ in live}:
        values = [v for x, v in live if x == k and v is not None]
        want[k] = (sum(x == k for x, _ in live), len(values), sum(values) if values else None)
    assert got == want
    assert grouped_view(spark.createDataFrame([("z", 1, 1), ("z", 1, -1)], schema), ["k"], ["v"]).count() == 0


def test_weighted_rows(spark):
    df = spark.createDataFrame([(1, 2), (2, 0), (3, -1), (4, 1)], "a int, _freq long")
    assert sorted(r["a"] for r in O.expand(df).collect()) == [1, 1, 4]
    assert O.consolidate(df.unionByName(O.negate(df))).count() == 0
    t = spark.createDataFrame([(1,), (1,), (2,)], "a int")
    assert sorted(r["a"] for r in O.delete_rows(t, spark.createDataFrame([(1,)], "a int")).collect()) == [1, 2]


def test_entry_points_import():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "tpch_q1" in entry.queries()
