"""Plans: what reaches the files, what is broadcast, and that nothing joins without keys."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from oracle import once
from tidemark.plans.skew import fits, lookup_join

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [k for k in e.queries() if k[:3] not in ("p6_", "p7_", "p8_")])
def test_no_join_without_keys(spark, name):
    got = plan(once(spark, e.queries()[name], name, D))
    assert "CartesianProduct" not in got and "BroadcastNestedLoopJoin" not in got


@pytest.mark.parametrize(
    "name,want",
    [
        ("get_one", "EqualTo(c_custkey,42)"), ("find_by_eq", "EqualTo(o_orderpriority,1-URGENT)"), ("range_by_asc", "GreaterThanOrEqual(o_totalprice,1000.0)"),
        ("range_by_desc_limit", "TakeOrderedAndProject"), ("nearest_geo", "TakeOrderedAndProject"), ("find_by_null", "IsNull(relay_node)"), ("series_latest_each", "WindowGroupLimit"),
    ],
)
def test_predicates_reach_the_files(spark, name, want):
    assert want in plan(e.queries()[name](spark, D))


def test_columns_are_pruned(spark):
    got = plan(e.queries()["get_all_projection"](spark, D))
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in got


def test_lookup_is_broadcast_only_below_its_limit(spark):
    big = spark.range(1000).select(F.expr("if(id < 999, 'hot', 'x')").alias("k"), "id")
    small = spark.createDataFrame([("hot", 1), ("x", 2)], "k string, v int")
    a, b = lookup_join(big, small, ["k"], F.col("id")), lookup_join(big, small, ["k"], F.col("id"), limit=10)
    assert fits(small) and not fits(small, 10)
    assert "BroadcastHashJoin" in plan(a) and "_salt" in plan(b)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and b.count() == 1000
    assert lookup_join(big, small.filter("v = 2"), ["k"], F.col("id"), "left", limit=10).filter("v is null").count() == 999
