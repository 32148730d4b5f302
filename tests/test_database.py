"""The stored database: writers at once, what a lookup reads, compaction beside writers."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from tidemark.operators import txn
from tidemark.sources import shared
from tidemark.sources.database import Database


@pytest.fixture
def root(spark):
    return shared.fresh_folder(spark, "db")


def files(df):
    return len(df.inputFiles())


def test_lookups_read_only_files_whose_zones_match(spark, root):
    db = Database(spark, root)
    docs = spark.range(4000).selectExpr("lpad(id, 5, '0') as doc_id", "id % 50 as g", "cast(id % 200 as double) - 100 as lon", "cast(id div 200 as double) as lat")
    db.put_many("t", docs)
    db.create_index("t", "byG", "g")
    db.create_geo_index("t", "byLoc", "lon", "lat")
    db.compact(files=16)
    whole = files(db.all("t"))
    assert whole >= 12 and files(db.get("t", "00123")) == 1 and db.get("t", "00123").first().g == 23
    assert files(db.find_by("t", "byG", 7)) <= 2 and db.find_by("t", "byG", 7).count() == 80
    assert files(db.range_by("t", "byG", 10, 12)) <= 3 and db.range_by("t", "byG", 10, 12).count() == 240
    box = db.find_in_box("t", "byLoc", 10.5, 4.5, 14.5, 6.5)
    assert files(box) <= 4 and box.count() == 8
    near = db.find_nearest("t", "byLoc", 12.1, 5.1, 3)
    assert files(near) < whole and sorted((r.lon, r.lat) for r in near.collect()) == [(12.0, 5.0), (12.0, 6.0), (13.0, 5.0)]
    # Changes since lie over the files that are read: a document that left the box, one that came, and a deleted one.
    gone = box.orderBy("doc_id").select("doc_id").limit(2).collect()
    db.put("t", gone[0].doc_id, g=1, lon=-90.0, lat=0.0)
    db.delete("t", gone[1].doc_id)
    db.put("t", "zzzzz", g=7, lon=12.0, lat=5.5)
    assert db.find_in_box("t", "byLoc", 10.5, 4.5, 14.5, 6.5).count() == 7 and db.find_by("t", "byG", 7).filter("doc_id = 'zzzzz'").count() == 1
    assert db.get("t", gone[1].doc_id).count() == 0


def test_writers_at_once_lose_nothing(spark, root):
    Database(spark, root).ensure_collection("t")

    def write(i):
        db = Database(spark, root)
        for k in range(3):
            db.put("t", f"{i}-{k}", n=i)
            db.create_index("t", f"by{i}{k}", "n")

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    db = Database(spark, root)
    assert db.all("t").count() == 12 and db.paths().count() == 12
    seq = [r.seq for r in db.log("t").select("seq").collect()]
    assert len(set(seq)) == 12


def test_of_transactions_on_one_document_all_but_one_conflict(spark, root):
    db = Database(spark, root)
    db.put("t", "a", n=0)

    def add(i):
        mine = Database(spark, root)
        t = mine.begin()
        n = mine.read(t, "t", "a").first().n
        barrier.append(i)
        while len(barrier) < 4:
            pass
        t.put("t", "a", {"n": n + 1})
        return mine.commit(t)

    barrier = []
    with ThreadPoolExecutor(4) as pool:
        got = sorted(pool.map(add, range(4)))
    assert got == [txn.CONFLICT] * 3 + [txn.OK] and db.get("t", "a").first().n == 1


def test_compaction_keeps_what_is_committed_meanwhile_and_versions_restart(spark, root, monkeypatch):
    db, other = Database(spark, root), Database(spark, root)
    db.put("t", "a", n=1)
    db.put("t", "b", n=1)
    lay_out = db._lay_out

    def slow(*args):
        lay_out(*args)
        other.put("t", "a", n=2)

    monkeypatch.setattr(db, "_lay_out", slow)
    db.compact("t")
    assert {(r.doc_id, r.n) for r in Database(spark, root).all("t").collect()} == {("a", 2), ("b", 1)}
    assert {(r.doc_id, r.version) for r in db.versions("t").collect()} == {("a", 1), ("b", 0)}
    assert db.log_stats().first().changes == 1 and len(shared.names(spark, f"{root}/data")) == 1


def test_an_uncommitted_batch_is_not_read(spark, root):
    db = Database(spark, root)
    db.put("t", "a", n=1)
    db._write("t", spark.createDataFrame([("a", 5), ("b", 5)], "doc_id string, n long"), "put")
    assert [(r.doc_id, r.n) for r in Database(spark, root).all("t").collect()] == [("a", 1)]


def test_small_files_are_created_once_and_replaced_whole(spark, root):
    at = f"{root}/x/y.json"
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda i: shared.create_text(spark, at, str(i)), range(8))) == 1
    shared.write_text(spark, at, "new")
    assert shared.read_text(spark, at) == "new" and shared.names(spark, f"{root}/x") == ["y.json"]


def test_ids_listed_very_often_meet_their_documents_by_broadcast(spark, monkeypatch):
    from tidemark.operators import access
    from tidemark.plans import skew

    docs = spark.range(100).selectExpr("id as k", "id * 2 as v")
    ids = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id % 140) as k", "id as n")
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 10)
    monkeypatch.setattr(access, "fits", lambda df: False)
    monkeypatch.setattr(access, "hot_keys", lambda df, keys: skew.hot_keys(df, keys, 500))
    got = {(r.k, r.n, r.v) for r in access.get_many(docs, ids, "k").collect()}
    assert got == {(k, n, 2 * k) for n in range(3000) for k in [7 if n % 3 == 0 else n % 140] if k < 100}
    assert skew.hot_keys(ids, ["k"], 500).collect()[0].k == 7 and skew.hot_keys(ids, ["k"]) is None
