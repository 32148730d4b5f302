import random

import pytest
from conftest import rows

from tidemark.operators import feed
from tidemark.sources import shared
from tidemark.sources.vectors import VectorTable

LOG = "seq long, collection string, doc_id string, op string, version long, change_id string, hlc struct<wall:long,counter:long,node:string>"


def brute(data):
    head = {}
    for seq, c, d, op, v, cid, h in data:
        o = (op or "").strip().lower()
        kind = "put" if o in ("put", "roput") else "delete" if o in ("delete", "rodelete") else None
        if kind is None:
            continue
        i = None if cid is None else cid.strip().lower()
        key = (h is not None, *(h or (0, 0, "")), bool(i), seq)
        if (c, d) not in head or key > head[c, d][0]:
            head[c, d] = (key, kind, v, i)
    return {(*k, v, i) for k, (_, kind, v, i) in head.items() if kind == "put"}


def made(n, docs, seed):
    r = random.Random(seed)
    return [
        (i, r.choice(["a", "b", None]), r.choice([f"d{r.randrange(docs)}", "hot", None]), r.choice(["put", " PUT", "roPut", "delete", "RODELETE ", "other", None]), i, r.choice([None, "", f" X{i}", f"y{i}"]),
         r.choice([None, (r.randrange(20), r.randrange(3), r.choice("abB"))]))
        for i in range(n)
    ]


def test_feed_in_any_number_of_batches(spark):
    data = made(600, 20, 5)
    df = spark.createDataFrame(data, LOG)
    for batches in (1, 3, 6):
        got = feed.alive(feed.apply_feed(df, batches=batches)).select("collection", "doc_id", "version", "change_id")
        assert {tuple(r) for r in got.collect()} == brute(data)


def test_repeated_and_late_batches_change_nothing(spark):
    data = made(300, 10, 6)
    df = spark.createDataFrame(data, LOG)
    t = feed.apply_feed(df.filter("seq >= 150"))
    t.apply(feed.images(df.filter("seq < 150")))
    before = rows(feed.alive(t).drop("hlc"), "collection", "doc_id")
    t.apply(feed.images(df))
    assert rows(feed.alive(t).drop("hlc"), "collection", "doc_id") == before
    assert {tuple(r) for r in feed.alive(t).select("collection", "doc_id", "version", "change_id").collect()} == brute(data)


def test_uncommitted_batch_is_not_seen_and_done_again(spark):
    df = spark.createDataFrame(made(200, 10, 7), LOG)
    t = feed.table(spark)
    t.apply(feed.images(df.filter("seq < 100")))
    before = sorted(map(str, t.read().collect()))
    t.apply(feed.images(df))
    shared.remove(spark, f"{t.root}/log/{1:010d}.json")  # as if the commit had failed
    assert sorted(map(str, t.read().collect())) == before
    assert t.apply(feed.images(df)) == 1
    assert {tuple(r) for r in feed.alive(t).select("collection", "doc_id", "version", "change_id").collect()} == brute(made(200, 10, 7))


def test_bits_are_set_for_superseded_rows_only(spark):
    t = VectorTable(spark, shared.fresh_folder(spark, "v"), ["k"], ["o"])
    t.apply(spark.createDataFrame([(i, 1, "a") for i in range(200)], "k long, o long, v string").coalesce(1))
    t.apply(spark.createDataFrame([(i, 2, "b") for i in range(0, 200, 3)] + [(1, 0, "late")], "k long, o long, v string"))
    assert sum(bin(r["__bits"] & (1 << 64) - 1).count("1") for r in t.deleted().collect()) == 67
    assert {(r.k, r.v) for r in t.read().collect()} == {(i, "a" if i % 3 else "b") for i in range(200)}


def test_extra_columns_pass_and_empty_feed(spark):
    df = spark.createDataFrame([(*r, "v", "w") for r in made(50, 5, 8)], LOG + ", value string, told2 string")
    assert "value" in feed.alive(feed.apply_feed(df, extra=("value",))).columns
    assert feed.alive(feed.apply_feed(df.limit(0))).count() == 0


def _table(spark, n=6000):
    t = VectorTable(spark, shared.fresh_folder(spark, "v"), ["k"], ["o"])
    t.apply(spark.range(n).selectExpr("id as k", "1L as o", "'a' as v"))
    return t


def test_a_small_batch_reads_few_buckets_of_the_index_and_shuffles_none_of_it(spark):
    t = _table(spark)
    new = spark.createDataFrame([(5, 2, "b"), (99_999, 2, "b")], "k long, o long, v string")
    places = t.with_places(new, t._held(t._log()), t.few(new, t._held(t._log())))
    got = {r.k: (r["__o"], r["__old_file"]) for r in places.collect()}
    assert got[99_999] == (None, None) and got[5][0].o == 1 and got[5][1]
    assert len(t.touched(new)) <= 2 < len(t._index(t._held(t._log())).inputFiles())
    plan = places._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "PartitionFilters: [bucket" in plan


def test_a_large_batch_meets_the_index_in_one_join(spark, monkeypatch):
    from tidemark.sources import vectors

    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
    data = made(400, 15, 11)
    got = feed.alive(feed.apply_feed(spark.createDataFrame(data, LOG), batches=4)).select("collection", "doc_id", "version", "change_id")
    assert {tuple(r) for r in got.collect()} == brute(data)


def test_compaction_changes_nothing_for_readers_and_drops_dead_files(spark):
    t = _table(spark, 900)
    for o in (2, 3):
        t.apply(spark.range(0, 900, 2 if o == 2 else 1).selectExpr("id as k", f"{o}L as o", "'b' as v").filter("k < 600"))
    before = rows(t.read(), "k")
    assert len(t.compact()) == 2 and rows(t.read(), "k") == before and t.compact() == []
    t.vacuum()
    assert rows(t.read(), "k") == before and len(shared.names(spark, f"{t.root}/data")) == 2
    t.apply(spark.createDataFrame([(1, 1, "old"), (700, 9, "new"), (5000, 1, "first")], "k long, o long, v string"))
    got = {r.k: r.v for r in t.read().collect()}
    assert len(got) == 901 and (got[1], got[700], got[5000], got[2]) == ("b", "new", "first", "b")


def test_of_two_writers_of_one_batch_one_commits(spark):
    t = _table(spark, 10)
    with pytest.raises(RuntimeError):
        t._claim(0, "x", [])
