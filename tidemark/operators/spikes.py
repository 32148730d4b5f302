"""Implausible block values, judged by what is normal for their series."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.skew import col, lookup_join
from ..session import ship
from ..sources.shared import written

FIELDS = ("min_val", "max_val")
#: A spike is farther from the usual level than FAR times the usual spread; a run of RUN equal blocks is stuck.
FAR, RUN = 10.0, 8
#: Blocks by block_seq in one chunk, places in one matrix; the unit in which a series of any length is spread over tasks.
CHUNK = 4096
#: A sketch's rank is off by one ACCURACY-th of the values at most, so by none up to EXACT of them (less than half of it). Of
#: longer series medians are searched for; FEW values are put in order by one task.
ACCURACY, EXACT, FEW = 5000, 2000, 100_000
#: Makes the median absolute deviation of normal values equal to their standard deviation.
NORMAL = 1.4826
DAY_MS = 86_400_000
#: Distances from the level are cut to this many spreads before a matrix is split, so none outweighs all others.
WILD = 1e4


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _shrunk(m: np.ndarray, by: float) -> np.ndarray:
    """``m`` with its singular values lessened, those up to ``by`` to zero; by the eigenvectors of the smaller product with its
    own transpose, which costs a fraction of a decomposition of ``m``."""
    if m.shape[0] > m.shape[1]:
        return _shrunk(m.T, by).T
    w, u = np.linalg.eigh(m @ m.T)
    d = np.sqrt(np.maximum(w, 0))
    u, d = u[:, d > by], d[d > by]
    return (u * (1 - by / d)) @ (u.T @ m)


def robust_pca(m: np.ndarray, rounds: int = 40, tol: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Principal component pursuit: ``m`` as a low-rank plus a sparse matrix, by the inexact augmented Lagrangian method."""
    norm = np.linalg.norm(m)
    if not norm:
        return np.zeros_like(m), np.zeros_like(m)
    lam = 1 / np.sqrt(max(m.shape))
    top = np.sqrt(max(np.linalg.eigvalsh(m @ m.T if m.shape[0] <= m.shape[1] else m.T @ m)[-1], 0))
    y = m / max(top, np.abs(m).max() / lam)
    mu, s = 1.25 / top, np.zeros_like(m)
    low = s
    for _ in range(rounds):
        low = _shrunk(m - s + y / mu, 1 / mu)
        r = m - low + y / mu
        s = np.sign(r) * np.maximum(np.abs(r) - lam / mu, 0)
        rest = m - low - s
        if np.linalg.norm(rest) <= tol * norm:
            break
        y, mu = y + mu * rest, mu * 1.5
    return low, m - low


def exact_middle(rows: DataFrame, keys: list[str], few: int = FEW) -> DataFrame:
    """(keys, mid): the lower median of ``x`` in each group, however many values it has; nulls have no place in it.

    Sketches give two values between which the median surely lies, with counts of what lies below them. Either it is one of
    the two, or the values strictly between are searched again, some thousandth of the group, until there are ``few`` of them;
    those are put in order. So no task orders more than ``few`` values, and a value that half of the group has ends the search.
    """
    c, found = F.col, []
    names = [f"__k{i}" for i in range(len(keys))]
    left = rows.select(*[col(k).alias(n) for k, n in zip(keys, names)], "x").filter("x is not null")
    wanted = left.groupBy(*names).agg(F.count("x").alias("n")).withColumn("t", F.expr("(n + 1) div 2"))
    while True:
        wanted = written(wanted, "ranks")
        most = wanted.agg(F.max("n")).first()[0] or 0
        if most <= few:
            at = F.row_number().over(Window.partitionBy(*names).orderBy("x"))
            last = lookup_join(left, wanted, names, c("x")).withColumn("at", at).filter("at = t").select(*names, c("x").alias("mid"))
            out = last
            for f in found:
                out = out.unionAll(f)
            return out.withColumnsRenamed(dict(zip(names, keys)))
        sketch = F.percentile_approx("x", F.array(*[F.lit(i / 1000) for i in range(1001)]), ACCURACY)
        ends = written(left.groupBy(*names).agg(sketch.alias("q"), F.min("x").alias("least"), F.max("x").alias("most")).join(wanted, names), "ends")
        # A sketch is off by n / ACCURACY ranks at most; its thousandths on both sides of the rank, one farther, hold it. At
        # the ends of the group they are its least and greatest value.
        p = F.floor(c("t") / c("n") * 1000).cast("int")
        lo, hi = F.when(p < 2, c("least")).otherwise(F.get("q", p - 2)), F.when(p > 997, c("most")).otherwise(F.get("q", p + 3))
        ends = written(ends.select(*names, "t", lo.alias("lo"), hi.alias("hi")), "brackets")
        x = lookup_join(left, ends, names, c("x"))
        n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
        counts = x.groupBy(*names, "t", "lo", "hi").agg(n(c("x") < c("lo")).alias("a"), n(c("x") == c("lo")).alias("b"), n((c("x") > c("lo")) & (c("x") < c("hi"))).alias("i"), n(c("x") == c("hi")).alias("h"))
        counts = written(counts, "counts")
        first, second = c("t") <= c("a") + c("b"), c("t") > c("a") + c("b") + c("i")
        found.append(counts.filter(first | second).select(*names, F.when(first, c("lo")).otherwise(c("hi")).alias("mid")))
        inside = counts.filter(~first & ~second)
        wanted = inside.select(*names, c("i").alias("n"), (c("t") - c("a") - c("b")).alias("t"))
        bounds = written(inside.select(*names, "lo", "hi"), "bounds")
        left = written(lookup_join(left, bounds, names, c("x")).filter((c("x") > c("lo")) & (c("x") < c("hi"))).select(*names, "x"), "between")


def usual_values(b: DataFrame, exact: int = EXACT) -> DataFrame:
    """(series_id, level0, level1, spread0, spread1): median and NORMAL times median absolute deviation of each field's finite
    values. Of series with up to ``exact`` values the sketches that give them are exact; the others' are searched for."""
    c = F.col
    value = [F.when(_finite(c(f)), c(f)) for f in FIELDS]
    mid = lambda v: F.percentile_approx(v, 0.5, ACCURACY)
    level = written(b.groupBy("series_id").agg(*[mid(v).alias(f"level{i}") for i, v in enumerate(value)], F.count(F.lit(1)).alias("blocks")), "levels")
    long = written(level.filter(c("blocks") > exact).select("series_id"), "long-series")
    some = long.limit(1).count() > 0

    def searched(usual: DataFrame, name: str, x: list[Column], of: DataFrame) -> DataFrame:
        """``usual`` with the columns of long series replaced by exact ones."""
        mine = lookup_join(of, long, ["series_id"], c("block_seq"))
        rows = mine.select("series_id", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), v.alias("x")) for i, v in enumerate(x)])).alias("s")).select("series_id", "s.i", "s.x")
        got = exact_middle(rows, ["series_id", "i"]).groupBy("series_id").pivot("i", list(range(len(FIELDS)))).agg(F.first("mid"))
        got = got.select("series_id", *[c(str(i)).alias(f"_{name}{i}") for i in range(len(FIELDS))])
        both = usual.join(long.select(c("series_id").alias("_long")), c("series_id") == c("_long"), "left").join(got, "series_id", "left")
        return both.withColumns({f"{name}{i}": F.when(c("_long").isNotNull(), c(f"_{name}{i}")).otherwise(c(f"{name}{i}")) for i in range(len(FIELDS))}).drop("_long", *[f"_{name}{i}" for i in range(len(FIELDS))])

    if some:
        level = written(searched(level, "level", value, b), "levels")
    off = lookup_join(b, level, ["series_id"], c("block_seq"))
    away = [F.abs(v - c(f"level{i}")) for i, v in enumerate(value)]
    spread = off.groupBy("series_id").agg(*[mid(v).alias(f"spread{i}") for i, v in enumerate(away)])
    if some:
        spread = searched(spread, "spread", away, off)
    spread = spread.select("series_id", *[(NORMAL * c(f"spread{i}")).alias(f"spread{i}") for i in range(len(FIELDS))])
    return level.drop("blocks").join(spread, "series_id")


def implausible(info: DataFrame, blocks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(series_id, block_seq, impossible, stuck, spike) of every block for which one of the three flags holds.

    Copies of a block (same series_id and block_seq) count as one, with the greatest value of each field. Impossible: a
    NaN or infinity, a value outside the limits of ``info`` (a null limit does not bind, nor does a series without
    info), or a minimum above the maximum. Stuck: both fields repeat over at least RUN consecutive blocks; a null ends
    the stretch. Spike: a finite value farther than FAR spreads from its field's median in the series, the spread being
    NORMAL times the median absolute deviation; a field whose spread is zero has no spikes. Nulls alone are no case;
    blocks without a series_id or block_seq are left out.

    These are plain rules; ``separated`` is the verdict of robust principal components. A series is cut by block_seq into
    chunks, in which runs are found and joined over their ends. Level and spread come from mergeable sketches and, where these
    would not be exact, from a search, so no task holds more than a chunk of any series.
    """
    c = F.col
    b = blocks.filter(c("series_id").isNotNull() & c("block_seq").isNotNull()).groupBy("series_id", "block_seq").agg(*[F.max(f).alias(f) for f in FIELDS])
    b = written(b.withColumn("chunk", F.floor(c("block_seq") / chunk)), "blocks")
    limits = info.groupBy("series_id").agg(F.max("phys_min").alias("least"), F.min("phys_max").alias("most"))

    usual = written(usual_values(b).join(limits, "series_id", "left"), "usual")
    known = lookup_join(b, usual, ["series_id"], c("block_seq"))
    far = reduce(lambda x, y: x | y, [_finite(c(f)) & (c(f"spread{i}") > 0) & (F.abs(c(f) - c(f"level{i}")) > FAR * c(f"spread{i}")) for i, f in enumerate(FIELDS)])
    spike = known.filter(far)

    bad = [c(f).isNotNull() & ~_finite(c(f)) for f in FIELDS]
    bad += [x for f in FIELDS for x in (c(f) < c("least"), c(f) > c("most"))]
    impossible = known.filter(reduce(lambda x, y: x | y, [F.coalesce(x, F.lit(False)) for x in [*bad, c("min_val") > c("max_val")]]))

    flags = ("impossible", "stuck", "spike")
    parts = [p.select("series_id", "block_seq", *[F.lit(f == flag).alias(f) for f in flags]) for p, flag in zip((impossible, stuck_runs(b), spike), flags)]
    return reduce(DataFrame.unionAll, parts).groupBy("series_id", "block_seq").agg(*[F.bool_or(f).alias(f) for f in flags])


def _profiles(g: dict[str, np.ndarray]) -> np.ndarray:
    """Of one matrix's blocks those with a value whose distance from the low-rank part of their profiles is beyond FAR; of
    those without a place, from the level."""
    n = len(g["pos"])
    spike, placed = np.zeros(n, bool), ~np.isnan(g["row"])
    row = np.where(placed, g["row"], 0).astype(int)
    row -= row[placed].min() if placed.any() else 0
    pos = np.nan_to_num(g["pos"]).astype(int)
    for i in range(len(FIELDS)):
        level, spread = g[f"level{i}"][0], g[f"spread{i}"][0]
        if not spread > 0:  # null too
            continue
        v = g[FIELDS[i]]
        ok = np.isfinite(v)
        with np.errstate(over="ignore", invalid="ignore"):
            z = (v - level) / spread
        usual = np.zeros(n)
        use = np.flatnonzero(ok & placed)
        if len(use):
            m = np.full((row[use].max() + 1, int(g["width"][0])), np.nan)
            use = use[np.argsort(-np.abs(z[use]), kind="stable")]  # of several in a slot the nearest to the level stays
            m[row[use], pos[use]] = np.clip(z[use], -WILD, WILD)
            ranked, seen = np.sort(m, axis=0), (~np.isnan(m)).sum(axis=0)
            at = np.arange(m.shape[1])
            middle = (ranked[np.maximum(seen - 1, 0) // 2, at] + ranked[np.minimum(seen // 2, len(m) - 1), at]) / 2
            usual_at = np.where(seen > 0, middle, 0)
            low, _ = robust_pca(np.where(np.isnan(m), usual_at, m))  # what is absent lies where its time of day usually does
            usual[use] = low[row[use], pos[use]]
        spike |= ok & (np.abs(np.where(ok, z, 0) - usual) > FAR)
    return spike


def _by_matrix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``_profiles`` of every matrix of a partition whose rows come matrix by matrix; the last of a batch waits for the next."""
    rest, names = None, ["series_id", "block_seq"]
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        ends = _ends(pdf)
        rest = pdf.iloc[ends[-2] :] if len(ends) > 1 else None
        yield _found(pdf, ends[:-1], names)
    if rest is not None:
        yield _found(rest, _ends(rest), names)


def _ends(pdf: pd.DataFrame) -> list[int]:
    """Where matrices begin, and the number of rows."""
    if not len(pdf):
        return [0]
    s, p = pdf["series_id"].to_numpy(object), pdf["part"].to_numpy()
    return [0, *(np.flatnonzero((s[1:] != s[:-1]) | (p[1:] != p[:-1])) + 1).tolist(), len(pdf)]


def _found(pdf: pd.DataFrame, ends: list[int], names: list[str]) -> pd.DataFrame:
    cols = {c: pdf[c].to_numpy(float) for c in pdf.columns if c not in (*names, "part")}
    keep = np.zeros(len(pdf), bool)
    for lo, hi in zip(ends, ends[1:]):
        keep[lo:hi] = _profiles({c: v[lo:hi] for c, v in cols.items()})
    return pdf.loc[keep, names]


def separated(info: DataFrame, blocks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(series_id, block_seq) of every block with a value that robust principal components set apart.

    Values, as distances from their field's level in spreads, are placed by ``start_ts``: a row a day from
    ``active_from``, a column a period of the day. Series active for less than three days, or with fewer than two periods
    a day, have rows of about the root of their periods instead. Rows go to matrices of about ``chunk`` places, three days
    at least. Principal component pursuit splits each; a value farther than FAR from the low-rank part is a case, which
    need not be one of ``implausible`` and the other way round. Blocks whose ``start_ts`` is null or outside the limits of
    the series have no place and are judged by their distance from the level. Copies count as one, with the least start.
    """
    ship(blocks.sparkSession)
    c = F.col
    b = blocks.filter(c("series_id").isNotNull() & c("block_seq").isNotNull()).groupBy("series_id", "block_seq")
    b = written(b.agg(*[F.max(f).alias(f) for f in FIELDS], F.min("start_ts").alias("start_ts")), "placed")
    times = info.groupBy("series_id").agg(*[F.max(f).cast("long").alias(f) for f in ("period_ms", "active_from", "active_to")])
    usual = usual_values(b).join(times, "series_id", "left")
    span, slots = c("active_to") - c("active_from"), F.expr(f"({DAY_MS} + period_ms - 1) div period_ms")
    usual = usual.withColumn("daily", (span >= 3 * DAY_MS) & (c("period_ms") <= DAY_MS // 2))
    root = F.greatest(F.lit(2), F.floor(F.sqrt(F.least(F.expr("(active_to - active_from) div period_ms"), F.lit(chunk)))))
    usual = usual.withColumn("width", F.when(c("period_ms") > 0, F.when(c("daily"), slots).otherwise(root)).cast("long"))
    # Rows of a part; a short last part goes with the one before.
    usual = usual.withColumn("high", F.greatest(F.lit(3), F.expr(f"{chunk} div width")).cast("long"))
    line = F.when(c("daily"), F.lit(DAY_MS)).otherwise(c("width") * c("period_ms"))
    usual = written(usual.withColumn("line", line).withColumn("parts", F.greatest(F.lit(1), F.expr("(active_to - active_from) div (line * high)"))), "profiles")
    x = lookup_join(b, usual, ["series_id"], c("block_seq"))
    t = F.when((c("start_ts") >= c("active_from")) & (c("start_ts") < c("active_to")) & c("width").isNotNull(), c("start_ts") - c("active_from"))
    x = x.withColumn("t", t).withColumns({"row": F.expr("t div line"), "pos": F.expr("(t % line) div period_ms")})
    x = x.withColumn("part", F.coalesce(F.least(F.expr("row div high"), c("parts") - 1), -1 - F.floor(F.abs("block_seq") / chunk)))
    x = x.select("series_id", "block_seq", *FIELDS, *[f"{k}{i}" for i in range(len(FIELDS)) for k in ("level", "spread")], "width", "row", "pos", "part")
    ordered = x.repartition("series_id", "part").sortWithinPartitions("series_id", "part")
    return ordered.mapInPandas(_by_matrix, x.select("series_id", "block_seq").schema)


def stuck_runs(b: DataFrame, least: int = RUN) -> DataFrame:
    """(series_id, block_seq) of the blocks in runs of at least ``least`` equal blocks; ``b`` has one row a block and ``chunk``."""
    c = F.col
    here = Window.partitionBy("series_id", "chunk").orderBy("block_seq")
    whole = F.lit(True)
    for f in FIELDS:
        whole = whole & c(f).isNotNull()
    again = whole
    for f in FIELDS:
        again = again & (F.lag(f).over(here) == c(f))
    runs = (
        b.withColumns({"new": (~F.coalesce(again, F.lit(False))).cast("int"), "whole": whole})
        .withColumn("run", F.sum("new").over(here))
        .groupBy("series_id", "chunk", "run", "whole")
        .agg(F.count(F.lit(1)).alias("n"), F.min("block_seq").alias("a"), F.max("block_seq").alias("z"), *[F.min(f).alias(f) for f in FIELDS])
        .withColumns({"first": c("run") == 1, "last": c("run") == F.max("run").over(Window.partitionBy("series_id", "chunk"))})
    )
    inner = runs.filter(c("whole") & (c("n") >= least))
    # Runs that reach an end of their chunk, two a chunk at most, are joined to those of the next chunk.
    order = Window.partitionBy("series_id").orderBy("a")
    on = F.lag("last").over(order) & c("first") & c("whole")
    for f in FIELDS:
        on = on & (F.lag(f).over(order) == c(f))
    ends = runs.filter(c("first") | c("last")).withColumn("g", F.sum((~F.coalesce(on, F.lit(False))).cast("int")).over(order))
    joined = ends.withColumn("total", F.sum("n").over(Window.partitionBy("series_id", "g"))).filter(c("whole") & (c("n") < least) & (c("total") >= least))
    spans = inner.select("series_id", "chunk", "a", "z").unionAll(joined.select("series_id", "chunk", "a", "z"))
    rows = b.select("series_id", "chunk", "block_seq").join(spans, ["series_id", "chunk"])
    return rows.filter((c("block_seq") >= c("a")) & (c("block_seq") <= c("z"))).select("series_id", "block_seq")
