import random

import pytest

from tidemark.operators.grid import missing_periods, regular_grid
from tidemark.plans import problems

INFO = "series_id string, period_ms long, active_from long, active_to long"
BLOCKS = "series_id string, block_seq long, start_ts long, sample_count long, min_val double, max_val double"


def brute(info, blocks, gap):
    out = {}
    for s, p, f, t in set(info):
        if None in (s, p, f, t) or p <= 0:
            continue
        got, once = {}, {}
        for b, q, st, n, lo, hi in blocks:
            if b == s and n is not None and n > 0 and st is not None and f <= st < t:
                k = (q, (st - f) // p)
                o = once.get(k, (0, None, None))
                once[k] = (max(o[0], n), lo if o[1] is None else o[1] if lo is None else min(o[1], lo), hi if o[2] is None else o[2] if hi is None else max(o[2], hi))
        for (_, k), (n, lo, hi) in once.items():
            o = got.get(k, (0, None, None))
            got[k] = (o[0] + n, lo if o[1] is None else o[1] if lo is None else min(o[1], lo), hi if o[2] is None else o[2] if hi is None else max(o[2], hi))
        last = None
        for k in range(-(-(t - f) // p)):
            last = k if k in got else last
            if last == k:
                out[s, f + k * p] = (*got[k], "observed")
            elif last is not None and k - last <= gap:
                out[s, f + k * p] = (0, *got[last][1:], "carried")
            else:
                out[s, f + k * p] = (0, None, None, "missing")
    return out


@pytest.mark.parametrize("chunk,gap", [(4, 3), (8, 0), (512, 3), (5, 5)])
def test_grid_is_that_of_a_plain_loop(spark, chunk, gap):
    r = random.Random(chunk)
    info = [("a", 10, 5, 405), ("b", 7, 0, 100), ("c", 10, 0, 1), ("hot", 1, 0, 900), ("none", 10, 0, 50), (None, 1, 0, 5), ("x", 0, 0, 5), ("y", None, 0, 5), ("z", 1, 5, 5), ("b", 7, 0, 100)]
    val = lambda: r.choice([None, 1.5, float(r.randrange(9))])
    blocks = [(s, r.randrange(80), r.choice([None, r.randrange(-20, 1000)]), r.choice([None, 0, -1, 1, 5]), val(), val()) for s in ["a", "b", "c", "hot", "unknown", None] for _ in range(60)]
    blocks += blocks[:30]
    got = {(x.series_id, x.slot_ms): (x.samples, x.low, x.high, x.status) for x in regular_grid(spark.createDataFrame(info, INFO), spark.createDataFrame(blocks, BLOCKS), gap, chunk).collect()}
    want = brute(info, blocks, gap)
    assert got == want
    gone = missing_periods(spark.createDataFrame(info, INFO), spark.createDataFrame(blocks, BLOCKS), max_gap=gap, chunk=chunk)
    assert {tuple(x) for x in gone.collect()} == {k for k, v in want.items() if v[3] != "observed"}


def test_empty_tables_and_extra_columns(spark):
    info, blocks = spark.createDataFrame([("a", 10, 0, 30)], INFO), spark.createDataFrame([], BLOCKS)
    assert regular_grid(info, blocks).filter("status = 'missing'").count() == 3
    assert regular_grid(info.limit(0), blocks).count() == 0
    clash = spark.createDataFrame([("a", 1, 5, 1, 1.0, 1.0, "t", "p")], BLOCKS + ", t string, p string")
    assert regular_grid(info.selectExpr("*", "1 as start_ts", "2 as f"), clash).filter("status = 'observed'").count() == 1


def test_gap_must_fit_the_chunk(spark):
    with pytest.raises(ValueError):
        regular_grid(spark.createDataFrame([], INFO), spark.createDataFrame([], BLOCKS), 9, 8)


def test_a_nan_observes_its_period_and_stays_out_of_low_and_high(spark):
    n = float("nan")
    blocks = [("a", 1, 0, 2, n, 3.0), ("a", 2, 1, 3, 1.0, n), ("a", 3, 10, 4, n, n), ("a", 3, 10, 4, n, 7.0), ("a", 4, 20, 5, n, n)]
    got = regular_grid(spark.createDataFrame([("a", 10, 0, 40)], INFO), spark.createDataFrame(blocks, BLOCKS)).orderBy("slot_ms").collect()
    assert [tuple(r)[1:] for r in got] == [(0, 5, 1.0, 3.0, "observed"), (10, 4, None, 7.0, "observed"), (20, 5, None, None, "observed"), (30, 0, None, None, "carried")]


def test_the_registered_grid_and_missing_periods_agree(spark):
    d = "/root/testdata/sf0.01"
    grid = problems.p3_grid(spark, d).filter("status <> 'observed'").select("series_id", "slot_ms")
    gone = problems.p3_found(spark, d)
    assert gone.count() > 0 and grid.exceptAll(gone).count() == 0 and gone.exceptAll(grid).count() == 0
