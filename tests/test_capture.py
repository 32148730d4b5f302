import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.sources import shared
from tidemark.streaming import capture as C

LOG = "seq long, collection string, doc_id string, op string, version long, change_id string, hlc struct<wall:long,counter:long,node:string>"
MARKS = "mark_id long, run_id long, collection string, doc_id string, version long, change_id string"
RUNS = "run_id long, status string"


def change(seq, doc, op="put", version=1, cid="x", hlc=(1, 0, "n")):
    return (seq, "c", doc, op, version, cid, hlc)


def test_heads(spark):
    log = spark.createDataFrame([
        change(1, "a", hlc=(5, 0, "n"), version=2), change(2, "a", hlc=(4, 9, "z")), change(3, "b", hlc=None), change(4, "b", " roDELETE", hlc=(0, 0, "a"), version=7),
        change(5, "d", cid=None), change(6, "d", cid=" Y "), change(7, "d", cid=""), change(8, "e", op="other"), change(9, "e", op=None), (10, None, None, "put", 1, "q", None),
        change(11, "f", hlc=(1, 1, "Z"), version=1), change(12, "f", hlc=(1, 1, "a"), version=2),
    ], LOG)
    got = {(r.collection, r.doc_id): (r.op, r.version, r.change_id, r.hlc and tuple(r.hlc)) for r in C.heads(log).collect()}
    assert got == {
        ("c", "a"): ("put", 2, "x", (5, 0, "n")), ("c", "b"): ("delete", 7, "x", (0, 0, "a")), ("c", "d"): ("put", 1, "y", (1, 0, "n")),
        (None, None): ("put", 1, "q", None), ("c", "f"): ("put", 2, "x", (1, 1, "a")),
    }


def test_due(spark):
    log = spark.createDataFrame([change(i, d, version=v, cid=c) for i, (d, v, c) in enumerate([("new", 1, "a"), ("same", 1, "A "), ("ver", 2, "a"), ("cid", 1, "b"), ("failed", 1, "a"), ("old", 1, "a"), ("void", 1, None)])], LOG)
    marks = spark.createDataFrame([
        (1, 1, "c", "same", 1, " a"), (2, 1, "c", "same", 1, "a"), (3, 1, "c", "ver", 1, "a"), (4, 1, "c", "cid", 1, "a"), (5, 2, "c", "failed", 1, "a"),
        (6, 1, "c", "old", 1, "a"), (7, 3, "c", "old", 9, "a"), (8, 1, "c", "void", 1, ""), (9, 4, "c", "new", 1, "a"), (10, None, "c", "new", 1, "a"),
    ], MARKS)
    runs = spark.createDataFrame([(1, "succeeded"), (2, "failed"), (3, "succeeded"), (3, "succeeded"), (4, None)], RUNS)
    assert {r.doc_id for r in C.due(spark, log, marks, runs).collect()} == {"new", "ver", "cid", "failed", "old"}
    assert C.due(spark, log.limit(0), marks, runs).count() == 0
    assert C.due(spark, log, marks.limit(0), runs.limit(0)).count() == 7


def test_due_over_runs_on_one_root(spark):
    data = [change(1, "late", version=1, cid="l1", hlc=(5, 0, "n")), change(2, "new", version=1, cid="n1", hlc=(1, 0, "n")), change(3, "still", version=1, cid="s1")]
    more = [change(4, "late", version=9, cid="l0", hlc=(2, 0, "n")), change(5, "new", version=2, cid="n2", hlc=(3, 0, "n")), change(6, "first", version=1, cid="f1"), change(7, "none", cid=None, hlc=None)]
    last = [change(8, "none", version=4, cid="q", hlc=(1, 0, "n")), change(9, "first", op="delete", version=2, cid="f2", hlc=(2, 0, "n"))]
    log, root = lambda rows: spark.createDataFrame(rows, LOG), shared.fresh_folder(spark, "t")
    runs = spark.createDataFrame([(1, "succeeded"), (2, "failed")], RUNS)
    mark = lambda i, run, doc, version, cid: (i, run, "c", doc, version, cid)
    took = lambda rows, marks: {(r.doc_id, r.version, r.change_id, r.op) for r in C.due(spark, log(rows), spark.createDataFrame(marks, MARKS), runs, root).collect()}
    late, still = ("late", 1, "l1", "put"), ("still", 1, "s1", "put")
    assert took(data, []) == {late, ("new", 1, "n1", "put"), still}
    seen = [mark(1, 1, "late", 1, "l1"), mark(2, 1, "new", 1, "n1"), mark(3, 2, "still", 1, "s1")]  # the run that took "still" failed
    second = {("new", 2, "n2", "put"), ("first", 1, "f1", "put"), ("none", 1, None, "put"), still}
    assert took(data + more, seen) == second  # "late" came again with an older clock
    assert took(data + more, seen) == second  # nothing new in the log, nothing recorded
    c = C.ChangeCapture(spark, root, ["collection", "doc_id"])
    assert c.plan(log(data + more + last[:1]))["batch"] == 2  # this call is lost before its commit
    whole = data + more + last
    third = {("new", 2, "n2", "put"), ("first", 2, "f2", "delete"), ("none", 4, "q", "put"), still}
    assert took(whole, seen) == third and c._batches("plans") == c._batches("commits") == [0, 1, 2, 3]
    assert {(r.doc_id, r.version, r.change_id, r.op) for r in C.due(spark, log(whole), spark.createDataFrame(seen, MARKS), runs).collect()} == third


def test_runs_survive_failures_without_gaps_or_repeats(spark):
    r = random.Random(3)
    data = [(i, "c", f"d{r.randrange(30)}", "put", i, str(i), (i, 0, "n")) for i in range(300)]
    log = spark.createDataFrame(data, LOG)
    c = C.ChangeCapture(spark, shared.fresh_folder(spark, "t"), ["collection", "doc_id"], partitions=7)
    seen = []

    def work(rows):
        seen.append({x.seq for x in rows.select("seq").collect()})
        return rows

    def broken(rows):
        work(rows).write.parquet(f"{c.root}/sink/batch=1")  # the work is out, the commit isn't
        raise RuntimeError

    assert c.run(log.filter("seq < 100"), work) == 0
    with pytest.raises(RuntimeError):
        c.run(log.filter("seq < 200"), broken)
    assert c.sink().filter("seq >= 100").count() == 0  # not committed, so not seen
    assert c.run(log, work) == 1  # the plan again, though the log has grown
    assert c.run(log, work) == 2
    assert c.run(log, work) is None
    assert seen[1] == seen[2] == set(range(100, 200)) and seen[3] == set(range(200, 300))
    last = {}
    for s, _, d, *_ in data:
        last[d] = s
    assert {r.doc_id: r.seq for r in c.sink().collect()} == last


def test_rows_without_offset_and_empty_log(spark):
    log = spark.createDataFrame([(None, "c", "a", "put", 1, "x", None)], LOG)
    c = C.ChangeCapture(spark, shared.fresh_folder(spark, "t"), ["doc_id"], partitions=3)
    assert c.run(log, lambda r: r) is None and c.run(log.limit(0), lambda r: r) is None and c.sink() is None


def test_latest_by_takes_nulls_as_equal_and_one_of_ties(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 1, "b"), ("k", 2, "c")], "k string, o int, v string")
    assert rows(C.latest_by(df, ["k"], [F.col("o")]), "k") == [(None, 1, "b"), ("k", 2, "c")]


def test_plans_of_another_number_of_partitions_are_refused(spark):
    log = spark.createDataFrame([change(1, "a"), change(2, "b")], LOG)
    root = shared.fresh_folder(spark, "t")
    C.ChangeCapture(spark, root, ["doc_id"], partitions=3).run(log, lambda r: r)
    with pytest.raises(ValueError):
        C.ChangeCapture(spark, root, ["doc_id"], partitions=5).plan(log)


def test_of_two_runs_that_plan_at_once_both_work_on_one_plan(spark, monkeypatch):
    log = spark.createDataFrame([change(i, f"d{i}") for i in range(20)], LOG)
    root = shared.fresh_folder(spark, "t")
    a, b = (C.ChangeCapture(spark, root, ["doc_id"], partitions=3) for _ in range(2))
    create, first = shared.create_text, []

    def late(*args):
        if not first:
            first.append(1)
            assert b.plan(log.filter("seq < 10"))["batch"] == 0  # the other run plans in between
        return create(*args)

    monkeypatch.setattr(shared, "create_text", late)
    assert a.plan(log)["to"] == b.plan(log)["to"] and max(x for x in a.plan(log)["to"] if x is not None) == 9


def test_due_when_a_run_fails_in_each_phase(spark, monkeypatch):
    r = random.Random(4)
    data = [change(i, f"d{r.randrange(12)}", version=i, cid=f"c{i}", hlc=(r.randrange(50), 0, "n")) for i in range(90)]
    marks, runs = spark.createDataFrame([], MARKS), spark.createDataFrame([], RUNS)
    root, write = shared.fresh_folder(spark, "t"), shared.create_text
    got = lambda n, root: {(x.doc_id, x.version) for x in C.due(spark, spark.createDataFrame(data[:n], LOG), marks, runs, root).collect()}
    assert got(30, root) == got(30, None)
    for n, phase in ((60, "plans"), (75, "work"), (90, "commits")):
        def broken(s, at, text, phase=phase):
            if f"/{phase}/" in at:
                raise RuntimeError
            return write(s, at, text)

        with monkeypatch.context() as m:
            if phase == "work":
                m.setattr(C, "heads", lambda rows: (_ for _ in ()).throw(RuntimeError()))
            else:
                m.setattr(shared, "create_text", broken)
                m.setattr(shared, "write_text", broken)
            with pytest.raises(RuntimeError):
                got(n, root)
        assert got(n, root) == got(n, None)
