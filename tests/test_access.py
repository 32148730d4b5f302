import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.operators import access


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([("1", "Alice", 30), ("2", "Bob", 25), ("3", "Alice", 35)], "doc_id string, name string, age long")


def ids(df):
    return [r.doc_id for r in df.collect()]


def test_equal_composite_and_range(users):
    assert sorted(ids(access.find_by(users, {"name": "Alice"}))) == ["1", "3"]
    assert ids(access.find_by(users, {"name": "Alice", "age": 30})) == ["1"]
    assert ids(access.range_by(users, "age", 26, 40)) == ["1", "3"]
    assert ids(access.range_by(users, "age", 0, 40, ascending=False, limit=2)) == ["3", "1"]
    assert ids(access.find_by(users, {"age": 30.0})) == []
    assert ids(access.find_by(users, {"name": "Alice"}, limit=1)) == ["1"]


def test_reads(users):
    assert access.get_many(users, ["1", "3", "x"]).count() == 2
    assert ids(access.get_many(users, ["3", "1", "3"], position="p").orderBy("p")) == ["3", "1", "3"]
    assert access.get_many(users, users.select("doc_id").limit(2)).count() == 2
    assert access.get(users, "9").count() == 0 and access.get_all(users).count() == 3
    assert [r.doc_id for r in access.stream(users.orderBy("doc_id"))] == ["1", "2", "3"]
    assert access.current_version(users.withColumn("version", F.lit(4)), "1").first()[0] == 4
    assert access.current_version(users.withColumn("version", F.lit(4)), "z").first()[0] == 0


def test_nulls_have_their_place_between_the_kinds(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("b", None, None), ("c", -5, "b")], "doc_id string, i long, s string")
    assert ids(access.range_by(df, "i", -9, None)) == ["c", "a", "b"]
    assert ids(access.range_by(df, "i", None, 9)) == ["c", "a"]
    assert ids(access.range_by(df, "s", None, "z")) == ["b", "c", "a"]
    assert ids(access.range_by(df, "s", "a", None)) == ["c", "a"]
    assert ids(access.range_by(df, "i")) == ["c", "a", "b"] and ids(access.range_by(df, "i", ascending=False)) == ["b", "a", "c"]
    assert ids(access.range_by(df, "i", 1.5, None)) == ["c", "a", "b"]  # ints come after floats
    assert ids(access.range_by(df, "i", 1, 9.5)) == []
    assert ids(access.range_by(df, "s", 5, "c")) == ["b", "c"]
    assert ids(access.find_by(df, {"i": None})) == ["b"]


def test_index_keys_order_values_of_all_kinds(spark):
    vals = ["null", "-5", "3", "7", "-1.5e0", "2.5e0", '"a"', '"b"', "true", "false", None, "-1e300", "1e-300", "0e0"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "doc_id int, j string").withColumn("k", V.index_key(F.parse_json("j")))
    got = [vals[r.doc_id] for r in df.orderBy("k", "doc_id").collect()]
    assert got == ["false", "true", "-1e300", "-1.5e0", "0e0", "1e-300", "2.5e0", "-5", "3", "7", "null", None, '"a"', '"b"']


def test_accessors(spark):
    df = spark.createDataFrame([('{"a":{"b":1},"f":1.5e0,"n":null,"s":"x","l":[1],"t":true}',)], "j string").select(F.parse_json("j").alias("v"))
    v = F.col("v")
    at = lambda p: V.at_path(v, p)
    r = df.select(
        V.to_int(at("a.b")), V.to_float(at("a.b")), V.to_number(at("a.b")), V.to_float(at("f")), V.to_string(at("s")), V.to_bool(at("t")),
        V.has_key(v, "n"), V.has_key(v, "zz"), V.kind(at("n")), V.kind(at("zz")), V.kind(at("l")), V.kind(at("a")), V.to_int(at("s")), V.to_string(V.get_or(v, "zz", F.lit("d"))),
    ).first()
    assert tuple(r) == (1, None, 1.0, 1.5, "x", True, True, False, "null", None, "array", "object", None, "d")
    assert df.select(V.to_int(V.get_strict(at("a"), "b"))).first()[0] == 1
    with pytest.raises(Exception, match="no field q"):
        df.select(V.get_strict(v, "q")).collect()


def test_churn_against_a_dictionary(spark):
    r = random.Random(4)
    docs = {}
    for _ in range(2000):
        k = f"u{r.randrange(300)}"
        if r.random() < 0.3:
            docs.pop(k, None)
        else:
            docs[k] = (r.choice(["Alice", "Bob", None]), r.choice([None, r.randrange(18, 78)]))
    df = spark.createDataFrame([(k, *v) for k, v in docs.items()], "doc_id string, name string, age long")
    for _ in range(8):
        lo, hi = sorted((r.randrange(18, 78), r.randrange(18, 78)))
        want = sorted((v[1], k) for k, v in docs.items() if v[1] is not None and lo <= v[1] <= hi)
        assert rows(access.range_by(df, "age", lo, hi).select("age", "doc_id")) == want
    want = sorted(k for k, v in docs.items() if v == ("Bob", None))
    assert sorted(ids(access.find_by(df, {"name": "Bob", "age": None}))) == want and math.isfinite(len(want))
