import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.functions.ids import hlc_order
from tidemark.operators import changelog, replication, txn
from tidemark.sources import shared
from tidemark.sources.database import Database

LOG = "seq long, collection string, doc_id string, op string, value string"


@pytest.mark.parametrize("chunk", [5, 40, 1 << 20])
def test_versions_are_those_of_a_fold(spark, chunk):
    r = random.Random(chunk)
    data = [(i, "c", r.choice(["a", "b", "hot", None]), r.choice(["put", "put", "delete"]), str(i)) for i in range(300)]
    state, want = {}, {}
    for i, _, d, op, _ in data:
        if op == "put":
            state[d] = want[i] = state.get(d, 0) + 1
        elif d in state:
            want[i] = state.pop(d) + 1
    df = spark.createDataFrame(data, LOG)
    assert {x.seq: x.version for x in changelog.with_versions(df, chunk=chunk).collect()} == want
    live = {x.doc_id for x in changelog.current(df).collect()}
    assert live == set(state)
    assert changelog.with_versions(df.limit(0)).count() == changelog.current(df.limit(0)).count() == 0


def test_overlay(spark):
    snap = spark.createDataFrame([(0, "c", f"t{i}", "put", str(i)) for i in range(50)], LOG).select("collection", "doc_id", "value")
    log = spark.createDataFrame([(1, "c", "t10", "delete", None), (2, "c", "z-fresh", "put", "hi"), (3, "c", "t5", "put", "9999"), (4, "c", "none", "delete", None)], LOG)
    got = {r.doc_id: r.value for r in changelog.overlay(snap, log).collect()}
    assert len(got) == 50 and "t10" not in got and got["t5"] == "9999" and got["z-fresh"] == "hi" and got["t0"] == "0"


def test_transactions(spark):
    state = spark.createDataFrame([("items", "i1", 1)], "collection string, doc_id string, version long")
    t = txn.Txn(spark)
    t.read(state, "items", "i1")
    t.read(state, "items", "missing")
    assert t.read_many(state, "items", ["i1", "nope"]).count() == 1 and t.reads == {("items", "i1"): 1}
    t.put("items", "i1", {"n": 1})
    t.put("items", "i1", {"n": 2})
    t.delete("items", "i2")
    status, writes = t.commit(state)
    assert status == txn.OK and rows(writes, "doc_id") == [("items", "i1", "put", '{"n": 2}'), ("items", "i2", "delete", None)]
    assert t.commit(state)[0] == txn.INVALID
    t = txn.Txn(spark)
    t.read(state, "items", "i1")
    t.put("items", "i1", 1)
    status, stale = t.commit(state.withColumn("version", F.lit(2).cast("long")))
    assert status == txn.CONFLICT and rows(stale) == [("items", "i1", 1, 2)]
    assert t.commit(state.limit(0))[0] == txn.CONFLICT
    blind = txn.Txn(spark, cap=3)
    for i in range(4):
        blind.put("c", str(i), i)
    assert blind.commit(state)[0] == txn.INVALID
    off = txn.Txn(spark)
    off.rollback()
    assert off.commit(state)[0] == txn.INVALID


REPL = "collection string, doc_id string, op string, seq long, change_id string, hlc struct<wall:long,counter:long,node:string>, value string"


def test_export(spark):
    log = spark.createDataFrame([("users", "u", "put", 1, "1:n", None, "a"), ("posts", "p", "put", 2, "2:n", None, "b"), ("posts", "q", "put", 3, "", None, "c"), ("posts", "q", "put", 4, None, None, "c")], REPL)
    n = lambda **k: replication.export_changes(log, **k).count()
    assert (n(), n(include=["users"]), n(exclude=["posts"]), n(since=1), n(include=["posts"], exclude=["posts"])) == (2, 1, 1, 1, 0)
    assert replication.export_cursor(log, 0, include=["users"]).first()[0] == 1 and replication.export_cursor(log, 9).first()[0] == 9
    cursors = spark.createDataFrame([], "peer string, cursor long")
    assert replication.gc_log(log, cursors).count() == 4 and replication.get_cursor(cursors, "a") == 0
    cursors = replication.set_cursor(replication.set_cursor(cursors, "a", 2), "b", 3)
    at = f"{shared.fresh_folder(spark, 'cursors')}/c.json"
    assert replication.load_cursors(spark, at).count() == 0
    replication.save_cursors(cursors, at)
    cursors = replication.load_cursors(spark, at)
    assert replication.gc_log(log, cursors).count() == 2
    assert replication.gc_log(log, replication.set_cursor(cursors, "a", 0)).count() == 4


@pytest.mark.parametrize("chunk", [4, 1 << 20])
def test_applying_changes_one_by_one_and_at_once(spark, chunk):
    r = random.Random(chunk)
    clock = lambda: None if r.random() < 0.1 else (r.randrange(6), r.randrange(2), r.choice("ab"))
    inc = [("c", r.choice("xyz"), "put", i, f"id{r.randrange(25)}", clock(), str(i)) for i in range(80)]
    loc = [("c", "x", "put", 0, "id1", (3, 0, "a"), "l"), ("c", "y", "delete", 0, "id2", None, None), ("d", "q", "put", 0, "z", (1, 0, "a"), "l")]
    key = lambda h: (h is not None, *(h or (0, 0, "")))
    state, accepted = {d: (key(h), i, v) for _, d, _, _, i, h, v in loc}, []
    for _, d, _, p, i, h, v in inc:
        if d in state and (state[d][1] == i or key(h) < state[d][0]):
            # the same identifier again, or older: left alone (an equal clock with the same identifier has the same rank)
            if state[d][1] == i and key(h) > state[d][0]:
                state[d] = (key(h), i, state[d][2])
            continue
        state[d] = (key(h), i, v)
        accepted.append(p)
    df = spark.createDataFrame(inc, REPL).withColumn("batch_pos", F.col("seq"))
    local = spark.createDataFrame(loc, REPL)
    assert [x.seq for x in replication.trace(local, df, chunk=chunk).filter("accepted").orderBy("seq").collect()] == accepted
    once = replication.apply_changes(local, df)
    again = replication.apply_changes(once.drop("batch_pos"), df)
    assert rows(once.select("doc_id", "value"), "doc_id") == rows(again.select("doc_id", "value"), "doc_id")
    best = {d: max([(key(h), -1, v) for _, e, _, _, _, h, v in loc if e == d] + [(key(h), p, v) for _, e, _, p, _, h, v in inc if e == d], key=lambda t: t[:2])[2] for d in "xyzq"}
    assert {x.doc_id: x.value for x in once.collect()} == best


def test_two_sides_converge(spark):
    a = spark.createDataFrame([("i", "1", "put", 1, "a1", (5, 0, "a"), "A")], REPL)
    b = spark.createDataFrame([("i", "1", "put", 1, "b1", (5, 0, "b"), "B")], REPL)
    pos = lambda d: d.withColumn("batch_pos", F.lit(0).cast("long"))
    assert rows(replication.apply_changes(a, pos(b)).select("value")) == rows(replication.apply_changes(b, pos(a)).select("value")) == [("B",)]


def test_clocks(spark):
    df = spark.createDataFrame([(1, 10), (2, 12), (3, 11), (4, 12), (5, 20)], "o int, now long")
    for chunk in (2, 1000):
        assert [tuple(r.hlc) for r in replication.tick(df, "now", "o", "n", chunk).orderBy("o").collect()] == [(10, 0, "n"), (12, 0, "n"), (12, 1, "n"), (12, 2, "n"), (20, 0, "n")]
    h = "struct<wall:long,counter:long,node:string>"
    pair = spark.createDataFrame([((1, 2, "a"), (1, 2, "b")), (None, (0, 0, "a")), ((3, 0, "a"), None)], f"a {h}, b {h}")
    assert [tuple(r[0]) for r in pair.select(replication.merge_clocks(F.col("a"), F.col("b"))).collect()] == [(1, 2, "b"), (0, 0, "a"), (3, 0, "a")]
    assert pair.filter(hlc_order(F.col("a")) > hlc_order(F.col("b"))).count() == 1


def test_database(spark):
    root = shared.fresh_folder(spark, "db")
    db = Database(spark, root)
    db.put_many("users", spark.createDataFrame([("1", "Alice", 30), ("2", "Bob", 25), ("3", "Alice", 35), ("3", "Alice", 36)], "doc_id string, name string, age long").coalesce(1))
    db.put("users", "4", name="Eve", age=40, vip=True)
    db.delete("users", "2")
    db.create_index("users", "byName", "name")
    db.create_index("users", "byBoth", "name, age")
    db.create_index("users", "byAge", "age")
    ids = lambda df: [r.doc_id for r in df.collect()]
    for d in (db, Database(spark, root)):
        assert sorted(ids(d.all("users"))) == ["1", "3", "4"]
        assert sorted(ids(d.find_by("users", "byName", "Alice"))) == ["1", "3"]
        assert ids(d.find_by("users", "byBoth", "Alice", 36)) == ["3"]
        assert ids(d.range_by("users", "byAge", 31, None, ascending=False)) == ["4", "3"]
        assert ids(d.find_by("users", "nope", "x")) == ids(d.range_by("users", "byBoth", 1)) == ids(d.all("unknown")) == []
        assert rows(d.versions("users"), "doc_id") == [("1", 1), ("3", 2), ("4", 1)]
    db.put_many("geo", spark.createDataFrame([("sf", -122.42, 37.77), ("la", -118.24, 34.05)], "doc_id string, lon double, lat double"))
    db.create_geo_index("geo", "byLoc", "lon", "lat")
    assert ids(db.find_in_box("geo", "byLoc", -130, 35, -100, 40)) == ids(db.find_within_radius("geo", "byLoc", -122.42, 37.77, 9000)) == ["sf"]
    assert ids(db.find_nearest("geo", "byLoc", -118, 34, 1, "geographic")) == ["la"] and ids(db.find_points_in_polygon("geo", "byLoc", [(-130, 30), (-121, 30), (-121, 40), (-130, 40)])) == ["sf"]
    db.put_many("zones", spark.createDataFrame([("z", [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]])], "doc_id string, shape array<array<double>>"))
    db.create_polygon_index("zones", "byShape", "shape")
    assert ids(db.find_polygons_containing("zones", "byShape", 1, 2)) == ids(db.find_polygons_meeting("zones", "byShape", 3, 3, 9, 9)) == ["z"]
    assert db.paths().count() == 5
    db.drop_path("geo", "geo", "byLoc")
    assert ids(db.find_in_box("geo", "byLoc", -180, -90, 180, 90)) == []
    kept = db.cache("users")
    assert kept.count() == 3 and db.cache_stats().count() >= 1
    kept.unpersist()
    db.compact()
    assert sorted(ids(db.all("users"))) == ["1", "3", "4"] and db.get("users", "4").first().vip
    db.put("users", "5", name="Zed", age=1)
    db.delete("users", "1")
    again = Database(spark, root)
    assert sorted(ids(again.all("users"))) == ["3", "4", "5"] and again.collections() == ["geo", "users", "zones"]
    assert ids(again.get_many("users", ["5", "3", "1"], "p").orderBy("p")) == ["5", "3"]
