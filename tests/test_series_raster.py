import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import raster, series
from tidemark.sources import codec, shared

S = "series_id string, append_seq long, ts_ms long, value double"


def made(spark, data, sid="s"):
    return spark.createDataFrame([(sid, i, t, float(v)) for i, (t, v) in enumerate(data)], S)


def test_range_latest_and_ends(spark):
    df = made(spark, [(100 * i, i) for i in range(100)])
    got = series.in_range(df, 2000, 5000).collect()
    assert len(got) == 31 and got[0].ts_ms == 2000 and got[-1].ts_ms == 5000
    assert series.in_range(df, 5000, 2000).count() == 0
    df = made(spark, [(i, 2 * i) for i in range(100)])
    got = series.latest(df, 5).collect()
    assert [r.ts_ms for r in got] == [95, 96, 97, 98, 99] and got[-1].value == 198 and series.latest(df, 0).count() == 0
    back = made(spark, [(1000, 0), (2000, 0), (3000, 0), (2500, 0), (4000, 0)])
    assert [r.ts_ms for r in series.items(back).collect()] == [1000, 2000, 3000, 2500, 4000]
    assert tuple(series.stats(back).first())[1:] == (5, 1000, 4000) and series.block_stats(back).count() == 2


def test_stored_series(spark, tmp_path):
    at = str(tmp_path / "s")
    series.append(made(spark, [(100 * i, i) for i in range(50)], "a"), at)
    series.append(made(spark, [(1, 1)], "b"), at)
    got = spark.read.parquet(at)
    assert got.count() == 51 and series.one(got, "b").count() == 1
    assert "EqualTo(series_id,b)" in series.one(got, "b")._jdf.queryExecution().executedPlan().toString()


def test_retention_keeps_whole_blocks(spark):
    df = made(spark, [(100 * i, i) for i in range(50)])
    kept = series.drop_blocks_before(df, 2500, 10)
    assert kept.count() == 30 and series.items(kept).first().ts_ms == 2000
    assert series.drop_blocks_before(made(spark, [(i, 0) for i in range(15)]), 10**6, 10).count() == 5  # the open block stays
    assert series.drop_blocks_before(made(spark, [(i, 0) for i in range(20)]), 10**6, 10).count() == 0


@pytest.mark.parametrize("chunk", [7, 50, 1 << 16])
def test_blocks_are_those_of_one_append_after_another(spark, chunk):
    r = random.Random(chunk)
    data = [(s, i, r.choice([i, i, i, i - 5]), 0.0) for s in ("a", "b") for i in range(200)]
    want, state = {}, {}
    for s, i, t, _ in data:
        seg, n, last = state.get(s, (0, 0, None))
        if last is not None and t < last:
            seg, n = seg + 1, 0
        want[s, i] = (seg, n // 6)
        state[s] = (seg, n + 1, t)
    got = {(x.series_id, x.append_seq): (x.seg, x.part) for x in series.with_blocks(spark.createDataFrame(data, S), 6, chunk).collect()}
    assert got == want


def test_blocks_round_trip_in_their_binary_form(spark):
    r = random.Random(1)
    t, data = 1_700_000_000_000, []
    for i in range(500):
        t += r.randrange(900, 1100)
        data.append((t, r.choice([math.sin(i), 1.0, float("nan"), -0.0, float("inf"), 1e-300])))
    ts, vs = codec.decode_block(codec.encode_block(*zip(*data)))
    assert ts == [x for x, _ in data] and [repr(v) for v in vs] == [repr(v) for _, v in data]
    constant = codec.encode_block([1000 * i for i in range(4096)], [5.0] * 4096)
    assert len(constant) * 8 / 4096 < 2.2
    wild = [(r.randrange(-(1 << 62), 1 << 62), r.random()) for _ in range(50)]
    assert codec.decode_block(codec.encode_block(*zip(*wild))) == ([x for x, _ in wild], [v for _, v in wild])
    assert codec.decode_block(codec.encode_block([], [])) == ([], [])
    with pytest.raises(ValueError):
        codec.decode_block(constant[:100])
    df = made(spark, [(x, i) for i, (x, _) in enumerate(data)])
    b = codec.encode_blocks(series.with_blocks(df, 64))
    assert b.count() == 8 and [r.ts_ms for r in codec.decode_blocks(b).orderBy("part", "pos").collect()] == [x for x, _ in data]


def test_values_round_trip_in_their_binary_form():
    import io

    r = random.Random(2)

    def tree(d):
        kinds = [lambda: None, lambda: r.random() < 0.5, lambda: r.randrange(-(1 << 63), 1 << 63), r.random, lambda: "é" * r.randrange(4), lambda: bytes(r.randrange(5))]
        if d:
            kinds += [lambda: [tree(d - 1) for _ in range(r.randrange(4))], lambda: {f"k{i}": tree(d - 1) for i in range(r.randrange(4))}]
        return r.choice(kinds)()

    trees = [tree(3) for _ in range(300)]
    assert [codec.decode_value(codec.encode_value(t)) for t in trees] == trees
    f = io.BytesIO()
    for t in trees:
        codec.write_framed(f, t)
    assert list(codec.read_framed(io.BytesIO(f.getvalue()))) == trees
    with pytest.raises(ValueError):
        list(codec.read_framed(io.BytesIO(f.getvalue()[:-1] or b"\x05")))
    with pytest.raises(ValueError):
        codec.decode_value(bytes([codec.TAGS["array"], 0xFF, 0xFF, 0xFF, 0x7F]))


def cell(spark, g, x, y):
    r = spark.range(1).select(g.cell_at(F.lit(float(x)), F.lit(float(y))).alias("c")).first().c
    assert g.cell_of(x, y) == (tuple(r) if r else None)
    return tuple(r) if r else None


def test_cells(spark):
    g = raster.Grid(0, 0, 10, 10, 5, 5)
    assert cell(spark, g, 5, 5) == (2, 2) and cell(spark, g, -1, 5) is None and cell(spark, g, 5, 100) is None
    g = raster.Grid(0, 0, 10, 10, 4, 4)
    assert cell(spark, g, 0, 10) == (0, 0) and cell(spark, g, 10, 0) == (3, 3)
    g = raster.Grid(0, 0, 10, 10, 10, 10)
    m = raster.mesh(spark, g).select("row", "col", g.cell_center(F.col("row"), F.col("col")).alias("p"))
    assert m.filter(g.cell_at(F.col("p.x"), F.col("p.y")) != F.struct("row", "col")).count() == 0
    assert cell(spark, raster.Grid(0, 0, 0, 10, 4, 4), 0, 0) is None
    assert raster.Grid(0, 0, 1, 1, 1, 1, 2, ("a", "b")).channel_index("b") == 1 and g.channel_index("x") == -1
    with pytest.raises(ValueError):
        raster.Grid(0, 0, 1, 1, 1, 1, 2, ("a",))


def test_samples_and_documents(spark):
    g = raster.Grid(0, 0, 2, 2, 2, 2, 3, ("rain", "snow", "clear"))
    data = [0.7, 0.1, 0.2] + [float(i) for i in range(9)]
    df = spark.createDataFrame([(data,)], "d array<double>")
    at = lambda x, y: raster.vector_at(F.col("d"), g, F.lit(x), F.lit(y))
    assert df.select(at(0.5, 1.5)).first()[0] == [0.7, 0.1, 0.2] and df.select(at(9.0, 9.0)).first()[0] == []
    doc = df.select(raster.to_document(F.col("d"), g).alias("m"))
    assert doc.select(raster.read_document(F.col("m"))).first()[0] == data and doc.select(F.octet_length("m.data")).first()[0] == 96
    assert doc.select(raster.read_document(F.col("m").withField("rows", F.lit(3).cast("long")))).first()[0] is None
    pts = spark.createDataFrame([(0.5, 1.5), (5.0, 5.0)], "lon double, lat double")
    got = [r.value for r in raster.value_at(pts, raster.set_cell(raster.mesh(spark, g), 0, 0, 1, 9), g, 1).orderBy("lon").collect()]
    assert got[0] == 9 and math.isnan(got[1])
    with pytest.raises(IndexError):
        raster.value_at(pts, raster.mesh(spark, g), g, 3)


def test_chunks_of_tiles(spark):
    g = raster.Grid(0, 0, 4, 4, 4, 4, tile_size=2, chunk_size=3)
    order = [0, 1, 2, 3, 1, 2, 5]  # goes back once
    frames = [(t, r, c, 0, 1.0, i) for i, t in enumerate(order) for r in range(4) for c in range(4)]
    df = spark.createDataFrame(frames, "ts_ms long, row int, col int, channel int, value double, append_seq long")
    assert [tuple(r) for r in raster.chunk_counts(df, g).orderBy("tile_r", "tile_c").collect()] == [(r, c, 3, 0) for r in range(2) for c in range(2)]
    assert raster.chunk_counts(df.filter("append_seq < 5"), g).filter("chunks = 2 and active = 1").count() == 4
    ts, cells = [100 * i for i in range(200)], [[math.sin(0.1 * i + c) for i in range(200)] for c in range(4)]
    assert codec.decode_tile(codec.encode_tile(ts, cells)) == (ts, cells) and codec.decode_tile(codec.encode_tile([], [])) == ([], [])


def test_stack_on_disk(spark):
    root = shared.fresh_folder(spark, "stack")
    g = raster.Grid(0, 0, 8, 8, 4, 6, 2, ("a", "b"), tile_size=4)
    assert g.tile_dims() == (1, 2) and g.tile_extent(0, 1) == (4, 2)
    assert raster.Grid(0, 0, 1, 1, 50, 70, tile_size=32).tile_dims() == (2, 3)
    raster.create_stack(spark, root, g)
    with pytest.raises(FileExistsError):
        raster.create_stack(spark, root, g)
    frames = [(100 * i, r, c, ch, float(100 * i + 4 * r + c) + ch, i) for i in range(20) for r in range(4) for c in range(6) for ch in range(2) if (r, c) != (3, 3)]
    raster.append_frames(root, spark.createDataFrame(frames, "ts_ms long, row int, col int, channel int, value double, append_seq long"), g)
    h, cells = raster.open_stack(spark, root)
    assert h == g
    f = raster.read_frame(cells, h, 500).collect()
    assert len(f) == 48 and all(r.value == (0 if (r.row, r.col) == (3, 3) else 500 + 4 * r.row + r.col + r.channel) for r in f)
    assert raster.read_frame(cells, h, 501).count() == 0
    assert raster.read_frames(cells, h, 500, 1500).select("ts_ms").distinct().count() == 11
    hist = raster.point_history(cells, h, 0.1, 7.9, 300, 700, 1)
    assert [tuple(r) for r in hist.collect()] == [(100 * i, 100 * i + 1.0) for i in range(3, 8)]
    assert "tile_r" in hist._jdf.queryExecution().executedPlan().toString()
    assert raster.point_history(cells, h, 99, 0, 0, 10**6).count() == 0 and raster.latest_ts(cells).first()[0] == 1900
    with pytest.raises(Exception, match="outside the grid"):
        raster.append_frames(root, spark.createDataFrame([(1, 9, 0, 0, 1.0, 1)], cells.select("ts_ms", "row", "col", "channel", "value", "append_seq").schema), g)
