import random

from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators.dedup import drop_copies, mark_copies

S = "seq long, change_id string, origin_node string"


def brute(data):
    seen, copies = set(), set()
    for seq, cid, node in sorted(data, key=lambda r: r[0]):
        k = (cid or "").strip().lower()
        if k:
            key = (k, None if node is None else node.strip().lower())
            (copies.add(seq) if key in seen else seen.add(key))
    return copies


def test_first_of_each_message_stays(spark):
    r = random.Random(1)
    data = [(i, r.choice(["a", " A", "b\t", "", " ", None, "c"]) and r.choice(["a", " A", "b\t", "c", "D", "", None]), r.choice(["n1", "N1 ", "n2", None])) for i in range(400)]
    df = spark.createDataFrame(data, S)
    assert {x.seq for x in mark_copies(df).filter("is_copy").collect()} == brute(data)
    assert drop_copies(df).count() == len(data) - len(brute(data))


def test_hot_message_is_ranked_in_parts(spark):
    data = [(i, "hot" if i % 3 else f"x{i % 50}", "n") for i in range(3000)]
    df = spark.createDataFrame(data, S)
    got = mark_copies(df, hot_rows=100)
    assert got.count() == len(data)
    assert {x.seq for x in got.filter("is_copy").collect()} == brute(data)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_repeated_rows_and_ties_leave_one(spark):
    df = spark.createDataFrame([(1, "a", "n"), (1, "a", "n"), (1, "A ", "n"), (None, "b", "n"), (2, "b", "n")], S)
    assert drop_copies(df).count() == 2
    assert mark_copies(df, hot_rows=1).filter("is_copy").count() == 3
    assert rows(mark_copies(df).filter("change_id = 'b' and is_copy").select("seq")) == [(2,)]


def test_new_messages_against_stored_ones_and_clashing_names(spark):
    stored = spark.createDataFrame([(1, "a", "n", "x", "y")], S + ", _n string, _rank string")
    new = spark.createDataFrame([(2, "a", "n"), (3, "b", "n")], S)
    got = drop_copies(stored, new)
    assert got.columns == stored.columns
    assert rows(got.select("seq"), "seq") == [(1,), (3,)]


def test_empty(spark):
    assert mark_copies(spark.createDataFrame([], S)).count() == 0


def test_columns_may_have_dots(spark):
    df = spark.createDataFrame([(1, "a", "n", 5), (2, "a", "n", 6)], S + ", `x.y` int")
    assert drop_copies(df).select("`x.y`").first()[0] == 5
    assert drop_copies(df.withColumn("is_copy", F.lit(1))).count() == 1
