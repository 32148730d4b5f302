import math
import random

import numpy as np
import pytest

from tidemark.operators import spikes
from tidemark.sources.shared import written

INFO = "series_id string, period_ms long, phys_min double, phys_max double"
BLOCKS = "series_id string, block_seq long, min_val double, max_val double"


def brute(info, blocks):
    out = {}
    limits = {s: (lo, hi) for s, _, lo, hi in info}
    by = {}
    for s, q, lo, hi in blocks:
        if s is not None and q is not None:
            o = by.setdefault(s, {}).get(q, (None, None))
            top = lambda a, b: b if a is None else a if b is None else (a if math.isnan(a) else b if math.isnan(b) else max(a, b))
            by[s][q] = (top(o[0], lo), top(o[1], hi))
    for s, rows in by.items():
        least, most = limits.get(s, (None, None))
        flags = {q: [False, False, False] for q in rows}
        for q, (lo, hi) in rows.items():
            for v in (lo, hi):
                if v is not None and (not math.isfinite(v) or least is not None and v < least or most is not None and v > most):
                    flags[q][0] = True
            if None not in (lo, hi) and not any(map(math.isnan, (lo, hi))) and lo > hi:
                flags[q][0] = True
        order, run = sorted(rows), []
        for q in [*order, None]:
            if run and q is not None and None not in rows[q] and rows[q] == rows[run[-1]]:
                run.append(q)
                continue
            if len(run) >= 8:
                for x in run:
                    flags[x][1] = True
            run = [q] if q is not None and None not in rows[q] else []
        for i in (0, 1):
            ok = sorted(r[i] for r in rows.values() if r[i] is not None and math.isfinite(r[i]))
            if ok:
                m = ok[(len(ok) - 1) // 2]
                d = sorted(abs(v - m) for v in ok)
                spread = 1.4826 * d[(len(d) - 1) // 2]
                for q, r in rows.items():
                    if spread > 0 and r[i] is not None and math.isfinite(r[i]) and abs(r[i] - m) > 10 * spread:
                        flags[q][2] = True
        out |= {(s, q): tuple(f) for q, f in flags.items() if any(f)}
    return out


def made(seed):
    r = random.Random(seed)
    blocks = []
    for s, n in (("a", 300), ("hot", 1200), ("tiny", 3), ("flat", 60)):
        for q in range(n):
            base = math.sin(q / 24 * 6.28) * 3 + r.gauss(0, 0.5) + 20
            v = (5.0, 5.0) if s == "flat" else (round(base, 2), round(base + r.random(), 2))
            u = r.random()
            if u < 0.02:
                v = (v[0], v[1] + r.choice([-1, 1]) * 10 ** r.uniform(2, 6))
            elif u < 0.04:
                v = r.choice([(None, v[1]), (v[0], None), (None, None), (float("nan"), v[1]), (v[0], float("inf")), (v[1], v[0] - 1), (1e300, v[1])])
            blocks.append((s, q, *v))
    for start in (17, 60, 250, 505, 1019):  # stretches that meet the ends of chunks in all ways
        for q in range(start, start + r.choice([7, 8, 9, 40])):
            blocks = [b if (b[0], b[1]) != ("hot", q) else ("hot", q, 7.0, 8.0) for b in blocks]
    blocks += [blocks[i] for i in range(0, 300, 7)] + [(None, 1, 1.0, 1.0), ("a", None, 1.0, 1.0)]
    r.shuffle(blocks)
    return blocks


INFOS = [("a", 3_600_000, 0.0, 100.0), ("hot", 60_000, None, 1e4), ("tiny", None, None, None), ("other", 1, 0.0, 1.0)]


@pytest.mark.parametrize("chunk", [16, 64, 4096])
def test_flags_are_those_of_a_plain_loop(spark, chunk):
    blocks = made(chunk)
    got = spikes.implausible(spark.createDataFrame(INFOS, INFO), spark.createDataFrame(blocks, BLOCKS), chunk)
    assert {(r.series_id, r.block_seq): (r.impossible, r.stuck, r.spike) for r in got.collect()} == brute(INFOS, blocks)


def test_long_run_over_many_chunks(spark):
    blocks = [("a", q, 1.0, 2.0) if 3 <= q < 45 or 60 <= q < 67 else ("a", q, float(q), float(q)) for q in range(100)]
    b = written(spark.createDataFrame(blocks, BLOCKS).selectExpr("*", "block_seq div 10 as chunk"), "t")
    assert sorted(r.block_seq for r in spikes.stuck_runs(b).collect()) == list(range(3, 45))


def test_robust_pca_separates_spikes_from_a_profile():
    r = np.random.default_rng(0)
    low = np.outer(1 + 0.1 * r.standard_normal(20), np.sin(np.arange(24) / 24 * 6.28))
    spikes_ = np.zeros_like(low)
    spikes_[3, 5], spikes_[11, 20] = 30, -25
    got, sparse = spikes.robust_pca(low + spikes_)
    assert np.abs(got - low).max() < 0.2 and set(zip(*np.nonzero(np.abs(sparse) > 5))) == {(3, 5), (11, 20)}
    assert not spikes.robust_pca(np.zeros((3, 3)))[0].any()


def test_empty_tables(spark):
    info, blocks = spark.createDataFrame(INFOS, INFO), spark.createDataFrame([], BLOCKS)
    assert spikes.implausible(info, blocks).count() == 0
    one = spark.createDataFrame([("a", 1, -5.0, 1.0)], BLOCKS)
    assert spikes.implausible(info.limit(0), one).count() == 0 and spikes.implausible(info, one).count() == 1


@pytest.mark.parametrize("chunk", [240, 4096])
def test_separation_judges_by_the_time_of_day_at_start_ts(spark, chunk):
    r, hour = random.Random(5), 3_600_000
    usual = lambda k: 80.0 if 6 <= k % 24 < 14 else 20.0  # a third of each day lies far from the level
    ks = [k for k in range(20 * 24) if r.random() < 0.9 or k == 10 * 24 + 7]  # gaps, so order and time of day part
    value = {k: usual(k) + r.gauss(0, 1) for k in ks}
    value[10 * 24 + 7] = 20.0  # near the level, but not at that hour
    value[ks[40]], value[ks[300]] = 300.0, -200.0
    blocks = [("a", q, 1000 + k * hour + r.randrange(hour), value[k], value[k]) for q, k in enumerate(ks)]
    blocks += [("a", 9000, None, 500.0, 500.0), ("a", 9001, 0, 20.0, 20.0), ("a", 9002, 1000 + 30 * 24 * hour, 20.0, -500.0), ("b", 1, None, 1.0, 1.0)]
    df = spark.createDataFrame(blocks + blocks[:50], "series_id string, block_seq long, start_ts long, min_val double, max_val double")
    info = spark.createDataFrame([("a", hour, 1000, 1000 + 20 * 24 * hour)], "series_id string, period_ms long, active_from long, active_to long")
    got = {x.block_seq for x in spikes.separated(info, df, chunk).collect()}
    assert got == {ks.index(10 * 24 + 7), 40, 300, 9000, 9002}
    assert spikes.separated(info, df.limit(0)).count() == 0


def test_separation_without_days_or_info(spark):
    r = random.Random(6)
    values = [r.gauss(20, 1) for _ in range(200)]
    values[77] = 90.0
    blocks = spark.createDataFrame([(s, q, q * 60_000, v, v) for s in "abc" for q, v in enumerate(values)], "series_id string, block_seq long, start_ts long, min_val double, max_val double")
    info = spark.createDataFrame([("a", 60_000, 0, 12_000_000), ("b", 0, 0, 12_000_000)], "series_id string, period_ms long, active_from long, active_to long")
    assert sorted(tuple(x) for x in spikes.separated(info, blocks).collect()) == [("a", 77), ("b", 77), ("c", 77)]


def test_level_and_spread_are_exact_for_a_million_values_in_one_series(spark):
    from pyspark.sql import functions as F

    n = 1_000_000
    x = F.expr("case when id % 3 = 0 then 20.5 when id % 7 = 0 then cast(null as double) when id % 1001 = 1 then double('NaN') else 20 + sqrt(rand(3)) * 100 * (id % 2 - 0.4) end")
    b = written(spark.range(n).select(F.when(F.col("id") % 50 == 0, "short").otherwise("long").alias("series_id"), F.col("id").alias("block_seq"), x.alias("min_val"), F.expr("rand(4) * rand(5) * 1e6").alias("max_val")), "t")
    b = b.filter("series_id = 'long' or block_seq < 90000")
    got = {r.series_id: r for r in spikes.usual_values(b).collect()}
    for name, part in b.toPandas().groupby("series_id"):
        for i, f in enumerate(spikes.FIELDS):
            v = np.sort(part[f].to_numpy()[np.isfinite(part[f].to_numpy())])
            level = v[(len(v) - 1) // 2]
            off = np.sort(np.abs(v - level))
            assert (got[name][f"level{i}"], got[name][f"spread{i}"]) == (level, spikes.NORMAL * off[(len(off) - 1) // 2])


@pytest.mark.parametrize("few", [5, 200])
def test_exact_middle_with_ties_and_groups_of_all_sizes(spark, few):
    r = random.Random(few)
    data = [("one", 1, 4.0), ("none", 1, None), (None, 1, 2.0), (None, 1, 9.0)]
    data += [("ties", 1, r.choice([1.0, 2.0, 2.0, 2.0, 3.0])) for _ in range(700)] + [("atom", 2, 5.0 if i % 2 else -float(i)) for i in range(999)] + [("wide", 2, r.gauss(0, 1e6)) for _ in range(3000)]
    r.shuffle(data)
    got = {(x.g, x.h): x.mid for x in spikes.exact_middle(spark.createDataFrame(data, "g string, h int, x double").filter("g is not null"), ["g", "h"], few).collect()}
    want = {}
    for g, h, x in data:
        if g is not None and x is not None:
            want.setdefault((g, h), []).append(x)
    assert got == {k: sorted(v)[(len(v) - 1) // 2] for k, v in want.items()}
