import pytest
from pyspark.sql import functions as F

from tidemark.operators import validators as v

USER = v.obj(name=v.string().trim().min_len(2), age=v.integer().gte(0), tags=v.array(v.string().min_len(1)).optional(), admin=v.boolean().default(False), status=v.enum("active", "off").default("active"))


def parse(spark, schema, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string").withColumn("v", F.parse_json("j"))
    return schema.parse(df, "v", "out", "issues", variant=True).orderBy("i").collect()


def issues(r):
    return [(i.path, i.message) for i in r.issues]


def test_objects(spark):
    a, b, c, d, e = parse(spark, USER, '{"name":"  Terra ","age":32,"tags":["a","db"]}', '{"name":"Al","age":1}', '{"name":"Z","age":-1,"tags":["","ok"]}', '{"name":1,"age":"x","status":"?"}', "[1]")
    assert a.ok and tuple(a.out) == ("Terra", 32, ["a", "db"], False, "active")
    assert b.ok and b.out.tags is None
    assert not c.ok and c.out is None and [p for p, _ in issues(c)] == ["$.name", "$.age", "$.tags.0"]
    assert issues(d) == [("$.name", "wrong kind"), ("$.age", "wrong kind"), ("$.status", "none of the choices")]
    assert issues(e) == [("$", "wrong kind")] and e.issues[0].actual == "array"


def test_unions_and_literals(spark):
    u = v.union(v.string().trim(), v.integer().map(lambda c: c.cast("string")))
    assert [r.out for r in parse(spark, u, "42", '"abc"', "true")] == ["42", "abc", None]
    least = v.union(v.obj(a=v.integer(), b=v.integer()), v.obj(a=v.integer(), b=v.integer().optional()))
    (r,) = parse(spark, least, '{"a":"x"}')
    assert issues(r) == [("$.a", "wrong kind")]
    lit = v.union(v.literal("a"), v.literal("b"))
    assert [r.ok for r in parse(spark, lit, '"a"', '"b"', '"c"', "1")] == [True, True, False, False]


def test_missing_and_null(spark):
    s = v.obj(o=v.integer().optional(), n=v.integer().nullable(), d=v.integer().default(7), f=v.number(), x=v.any_value())
    rows = parse(spark, s, '{"n":null,"f":1}', '{"o":null,"n":2,"d":null,"f":1.5e0,"x":[1]}', '{"f":"1"}')
    assert rows[0].ok and tuple(rows[0].out)[:4] == (None, None, 7, 1.0)
    assert rows[1].ok and tuple(rows[1].out)[:4] == (None, 2, 7, 1.5)
    assert issues(rows[2]) == [("$.n", "wrong kind"), ("$.f", "wrong kind")]


def test_arrays_and_records(spark):
    s = v.obj(m=v.record(v.array(v.integer().lte(9))))
    a, b, c = parse(spark, s, '{"m":{"x":[1,2],"y":[]}}', '{"m":{"x":[10,"a"],"y":3}}', '{"m":[]}')
    assert a.ok and a.out.m == {"x": [1, 2], "y": []}
    assert sorted(issues(b)) == [("$.m.x.0", "too large"), ("$.m.x.1", "wrong kind"), ("$.m.y", "wrong kind")]
    assert issues(c) == [("$.m", "wrong kind")]


def test_typed_columns(spark):
    df = spark.createDataFrame([("  ok ", 5), ("é", 5), (None, None), ("toolong", -1)], "name string, n long")
    s = v.row({"name": v.string().trim().min_len(2).max_len(5).matches("[a-zé]+"), "n": v.integer().gte(0).refine(lambda c: c % 5 == 0)})
    good, bad = v.split(df, s)
    assert [tuple(r.value) for r in good.collect()] == [("ok", 5), ("é", 5)]  # lengths are bytes
    assert sorted(len(r.issues) for r in bad.collect()) == [2, 2]
    with pytest.raises(Exception, match=r"[$]: too short"):
        v.string().min_len(6).parse_or_raise(df.filter("name is not null"), "name").collect()
    assert v.any_value().describe("x").described == "x"


def test_deep_schemas_stay_small(spark):
    s = v.integer()
    for _ in range(6):
        s = v.obj(a=s, b=v.string().trim().min_len(1).matches("x").optional())
    (r,) = parse(spark, s, '{"a":{"a":{"a":{"a":{"a":{"a":"no"}}}}}}')
    assert issues(r) == [("$.a.a.a.a.a.a", "wrong kind")]


def test_the_registered_variant_query_validates_every_collection(spark, tmp_path):
    from tidemark.plans import reference

    data = [(1, "users", '{"age": 3}'), (2, "items", '{"age": 4}'), (3, "items", '{"age": -1}'), (4, "zones", '{"n": 1}'), (5, None, '{"age": 5}'), (6, "items", "no json")]
    spark.createDataFrame(data, "seq long, collection string, value string").write.parquet(f"{tmp_path}/repl_changes.parquet")
    assert {tuple(r) for r in reference.validate_variant(spark, str(tmp_path)).collect()} == {(1, 3), (2, 4), (5, 5)}
