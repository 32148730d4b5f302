import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import shared
from tidemark.sources.database import Database
from tidemark.streaming import subscriptions as S

LOG = "seq long, collection string, doc_id string, op string, version long, text string, n double"


def events(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("doc_id", "seq").collect()]


def test_changes_and_deltas_of_a_field(spark):
    nan = float("nan")
    log = spark.createDataFrame([
        (1, "c", "a", "put", 1, None, None), (2, "c", "a", "put", 2, "hello", 30.0), (3, "c", "a", "put", 3, "hello", 30.0), (4, "c", "a", "put", 4, "hello world", 31.0),
        (5, "c", "a", "delete", 5, "kept by mistake", 31.0), (6, "c", "a", "put", 1, "x", nan), (7, "c", "a", "put", 2, "y", nan),
    ], LOG)
    assert events(S.field_deltas(log, "text"), "seq", "kind", "old", "new", "added") == [
        (2, "set", None, "hello", None), (4, "append", "hello", "hello world", " world"), (5, "delete", "hello world", None, None), (6, "set", None, "x", None), (7, "replace", "x", "y", None),
    ]
    assert events(S.field_deltas(log, "n"), "seq", "kind") == [(2, "set"), (4, "replace"), (5, "delete"), (6, "set"), (7, "replace")]
    assert S.field_changes(log.limit(0), "n").count() == 0
    assert [r.op for r in S.document(log, "c", "a").orderBy("seq").collect()][4] == "delete"


@pytest.mark.parametrize("chunk", [3, 1 << 20])
def test_stored_log_against_a_loop(spark, chunk):
    r = random.Random(chunk)
    data = [(i, "c", r.choice(["a", "b", None]), r.choice(["put", "put", "put", "delete"]), i, r.choice([None, "", "a", "ab", "abc", "b"]), None) for i in range(200)]
    old, want = {}, []
    for seq, _, d, op, _, t, _ in data:
        new = t if op == "put" else None
        if new != old.get(d):
            want.append((seq, old.get(d), new))
        old[d] = new
    got = S.field_changes(spark.createDataFrame(data, LOG), "text", chunk=chunk).orderBy("seq").collect()
    assert [(x.seq, x.old, x.new) for x in got] == want


def test_stream_gives_what_the_stored_log_gives(spark):
    r = random.Random(9)
    data = [(i, "c", r.choice("abc"), r.choice(["put", "put", "delete"]), i, r.choice([None, "a", "ab", "abc", "b"]), None) for i in range(120)]
    log = spark.createDataFrame(data, LOG)
    root = shared.fresh_folder(spark, "sub")
    got = []
    for part in range(3):  # three runs over a growing log, restarted from the checkpoint
        log.filter((F.col("seq") >= part * 40) & (F.col("seq") < part * 40 + 40)).coalesce(1).write.mode("append").parquet(f"{root}/log")
        stream = spark.readStream.schema(log.schema).parquet(f"{root}/log")
        q = S.deliver(S.stream_deltas(stream, "text"), lambda b, n: got.extend(map(tuple, b.collect())), f"{root}/state", availableNow=True)
        q.awaitTermination()
    want = S.field_deltas(log, "text").select("collection", "doc_id", "seq", "version", "kind", "old", "new", "added")
    assert sorted(got, key=lambda t: t[2]) == [tuple(x) for x in want.orderBy("seq").collect()]


def test_subscription_to_a_document(spark):
    db, got = Database(spark, shared.fresh_folder(spark, "db")), []
    db.put("c", "a", n=1)
    db.put("c", "b", n=2)
    db.delete("c", "a")
    q = db.subscribe("c", "a", lambda b, n: got.extend((r.op, r.n) for r in b.orderBy("seq").collect()), f"{db.root}/sub", availableNow=True)
    q.awaitTermination()
    assert got == [("put", 1), ("delete", None)]
