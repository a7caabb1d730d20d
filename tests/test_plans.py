"""Plans: what reaches the scan, which operators run, and streaming windows."""

import os

import pytest
from pyspark.sql import functions as F

from lakeweave.operators import relational as R
from lakeweave.sources import tables
from lakeweave.streaming import events
from lakeweave.workspace import Workspace

SF = os.environ.get("LAKEWEAVE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def ws(spark):
    return Workspace.over(spark, SF)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(ws):
    p = plan(ws.sql("SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_totalprice > 10.5"))
    assert "PushedFilters: [IsNotNull(o_custkey), IsNotNull(o_totalprice), EqualTo(o_custkey,7), GreaterThan(o_totalprice,10.5)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in p


def test_dates_against_text_are_pushed(ws):
    assert "GreaterThan(o_orderdate,1996" in plan(ws.sql("SELECT count(*) FROM orders WHERE o_orderdate > '1996-07-15'"))


def test_top_k_is_a_heap(ws):
    assert "TakeOrderedAndProject" in plan(ws.sql("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC LIMIT 3"))


def test_comma_join_becomes_an_equi_join(ws):
    p = plan(ws.sql("SELECT count(*) FROM customer, orders WHERE c_custkey = o_custkey"))
    assert "Cartesian" not in p and "NestedLoop" not in p


@pytest.mark.parametrize("condition", ["p_partkey NOT IN ({})", "NOT p_partkey IN ({})", "NOT (p_size = 3 OR p_partkey IN ({}))", "p_size = 3 OR p_partkey NOT IN ({})"])
def test_not_in_shuffles(spark, ws, condition):
    """Nothing but the tests for NULLs and for no rows reaches the driver, each of a row at most."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(ws.sql(f"SELECT p_partkey FROM part WHERE {condition.format('SELECT l_partkey FROM lineitem WHERE l_quantity > 10')}"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Broadcast" not in p and "SortMergeJoin" in p


def test_no_python_in_scalar_functions(ws):
    p = plan(ws.sql("SELECT substr(c_name, -4, 2), printf('%d', c_custkey), quote(c_name), c_name GLOB 'C*' FROM customer"))
    assert "Python" not in p and "Arrow" not in p


def test_group_limit_before_the_shuffle(ws):
    assert "WindowGroupLimit" in plan(R.top_k_per_group(ws.table("orders"), ["o_custkey"], [F.desc("o_totalprice")], 2))


def test_distinct_on_a_declared_key_is_done(ws):
    assert "Aggregate" in plan(R.distinct(ws.table("orders").select("o_orderkey", "o_custkey"), ("o_orderkey",)))


def test_distinct_sql_on_a_declared_key_is_done(ws):
    assert "Aggregate" in plan(ws.sql("SELECT DISTINCT o_custkey, o_orderkey FROM orders"))  # a file's key is not enforced
    assert "Aggregate" in plan(ws.sql("SELECT DISTINCT o_custkey FROM orders"))
    assert "Aggregate" in plan(ws.sql("SELECT DISTINCT a.o_orderkey FROM orders a JOIN lineitem ON a.o_orderkey = l_orderkey"))


def test_shuffle_partitions_follow_the_input():
    from lakeweave.session import shuffle_partitions_for

    assert shuffle_partitions_for(1) == 8 and shuffle_partitions_for(100 << 40) == 819_200


def test_salted_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (3, 0)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, w string")
    assert R.salted_join(left, right, "k", 4).count() == 51 and R.salted_join(left, right, "k", 4, "left").count() == 52
    assert sorted(R.set_operation("UNION", left.select("k"), right.select("k")).collect()) == [(1,), (2,), (3,)]
    assert R.exists(left, right, [("k", "k")], negated=True).count() == 1
    assert R.group_last(left, ["k"], ["v"], bare=("v",)).filter("k = 1").first()["v"] == 49


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, s string")
    for fmt in ("parquet", "orc", "json", "csv"):
        tables.write(df, str(tmp_path / fmt), fmt)
        assert sorted(tables.read(spark, str(tmp_path / fmt), fmt, "id long, s string").collect(), key=str) == sorted(df.collect(), key=str)
    tables.write_clustered(df, str(tmp_path / "clustered"), ("id",), 2)
    assert spark.read.parquet(str(tmp_path / "clustered")).count() == 2
    with pytest.raises(ValueError):
        tables.read(spark, "x", "xls")


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "2024-01-01 00:05:00", 7, "a", 1.0), (2, "2024-01-01 00:55:00", 7, "a", 2.0), (3, "2024-01-01 01:10:00", 7, "b", 4.0), (4, "2024-01-03 00:00:00", 8, "a", 1.0)], "event_id long, t string, user_id long, event_type string, value double").selectExpr("event_id", "cast(t as timestamp_ntz) ts", "user_id", "event_type", "value").write.parquet(source)
    schema = spark.read.parquet(source).schema
    out = str(tmp_path / "out")
    events.run_to_end(events.tumbling(events.read_events(spark, source, schema)), out, str(tmp_path / "c1"))
    got = sorted((str(r.window_start), r.event_type, r.n, r.total) for r in spark.read.parquet(out).collect())
    assert got[:2] == [("2024-01-01 00:00:00", "a", 2, 3.0), ("2024-01-01 01:00:00", "b", 1, 4.0)]
    events.run_to_end(events.sessions(events.read_events(spark, source, schema)), out + "2", str(tmp_path / "c2"))
    found = sorted((r.user_id, str(r.session_start), r.n) for r in spark.read.parquet(out + "2").collect())
    assert (7, "2024-01-01 00:05:00", 1) in found and (7, "2024-01-01 00:55:00", 2) in found
    events.run_to_end(events.sliding(events.read_events(spark, source, schema)), out + "3", str(tmp_path / "c3"))
    assert spark.read.parquet(out + "3").filter("window_start = '2024-01-01 00:30:00' AND event_type = 'a'").first()["n"] == 1
