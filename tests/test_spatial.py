import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators import neighbours, spatial

PLACES = [("sf", -122.42, 37.77), ("oak", -122.27, 37.80), ("la", -118.24, 34.05), ("ny", -74.00, 40.71), ("lon", -0.13, 51.50)]
P = "doc_id string, lon double, lat double"


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame([*PLACES, ("void", None, 1.0)], P)


def ids(df, c="doc_id"):
    return [r[c] for r in df.collect()]


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def square(a, b):
    return [[a, a], [b, a], [b, b], [a, b]]


def test_boxes_and_radius(places):
    assert set(ids(spatial.find_in_box(places, -130, 30, -70, 45))) == {"sf", "oak", "la", "ny"}
    assert ids(spatial.find_in_box(places, -130, 30, -70, 45, 2)) == ["la", "ny"]
    assert ids(spatial.find_within_radius(places, -122.42, 37.77, 50_000)) == ["sf", "oak"]
    assert ids(spatial.find_within_radius(places, -122.42, 37.77, 1_000_000)) == ["sf", "oak", "la"]
    assert ids(spatial.find_within_radius(places, -122.42, 37.77, 1_000_000, limit=1)) == ["sf"]


def test_nearest(places, spark):
    got = [(r.doc_id, r.distance) for r in spatial.find_nearest(places, -122.42, 37.77, 3, "geographic").collect()]
    assert [g[0] for g in got] == ["sf", "oak", "la"] and got[0][1] < 1 and 10_000 < got[1][1] < 20_000 and got[2][1] > 500_000
    line = spark.createDataFrame([(f"p{i:02}", float(i), 0.0) for i in range(100)], P)
    got = ids(spatial.find_nearest(line, 25.4, 0, 3))
    assert got[0] == "p25" and set(got) == {"p24", "p25", "p26"}
    assert spatial.find_nearest(line, 0, 0, 0).count() == 0
    assert spatial.find_in_box(line, 9.5, -1, 20.5, 1).count() == 11
    assert spatial.find_nearest_within(line, 50, 0, 3).count() == 7 and spatial.find_nearest_within(line, 50, 0, -1).count() == 0
    assert ids(spatial.find_nearest(line, 50, 0, 9, most=1)) == ["p50", "p49", "p51"]
    grid = spark.createDataFrame([(str(i), float(i % 100), float(i // 100)) for i in range(1000)], P)
    assert spatial.find_in_box(grid, 10, 0, 20, 5).count() == 66


def test_box_of_a_radius_is_narrower_than_the_circle(spark):
    north = 0.9995 * 100_000 / (6371008.8 * math.pi / 180)
    df = spark.createDataFrame([("n", 0.0, north), ("w", -179.9, 0.0)], P)
    assert spatial.find_within_radius(df, 0, 0, 100_000).count() == 0
    assert ids(spatial.find_within_radius(df, 0, 0, 100_000, exact=True)) == ["n"]
    assert ids(spatial.find_within_radius(df, 179.9, 0, 100_000, exact=True)) == ["w"]


def test_stored_places_prune_by_box(spark, places, tmp_path):
    spatial.write_places(places.filter("lon is not null"), str(tmp_path / "p"), files=3)
    stored = spark.read.parquet(str(tmp_path / "p"))
    assert ids(spatial.find_in_box(stored, -10, 40, 10, 60)) == ["lon"]
    assert "GreaterThanOrEqual(lon" in spatial.find_in_box(stored, -10, 40, 10, 60)._jdf.queryExecution().executedPlan().toString()
    assert tuple(one(spark, geo.point(1, 2))) == (1, 2)


def test_expressions(spark):
    assert 110_000 < one(spark, geo.haversine(0, 0, 0, 1)) < 112_000
    b = geo.box(0, 0, 1, 1)
    assert one(spark, geo.haversine_to_box(0.5, 0.5, b)) == 0
    assert one(spark, geo.haversine_to_box(5, 0.5, b)) > one(spark, geo.haversine_to_box(1.5, 0.5, b)) > 0
    assert one(spark, geo.box_distance(4, 5, b)) == 5
    empty = geo.box(1, 1, 0, 0)
    assert one(spark, geo.box_area(empty)) == 0 and one(spark, geo.box_area(geo.box_union(empty, geo.box(0, 0, 2, 3)))) == 6
    assert one(spark, geo.boxes_meet(b, geo.box(1, 1, 2, 2))) and not one(spark, geo.boxes_meet(b, geo.box(1.1, 0, 2, 2)))
    assert one(spark, geo.radius_box(0, 90, 1000)["max_x"]) == 180


def polygon(v):
    return geo.read_polygon(F.array(*[F.array(*[F.lit(float(x)) for x in p]) for p in v]))


def test_polygons(spark):
    tri = polygon([(0, 0), (10, 0), (5, 10)])
    ell = polygon([(0, 0), (10, 0), (10, 5), (5, 5), (5, 10), (0, 10)])
    cases = [(tri, (5, 1), True), (tri, (5, 5), True), (tri, (0, 5), False), (tri, (10, 5), False), (tri, (5, 11), False), (tri, (5, -1), False), (ell, (2, 2), True), (ell, (2, 8), True), (ell, (8, 8), False)]
    assert [one(spark, geo.in_polygon(*p, c)) for c, p, _ in cases] == [w for *_, w in cases]
    assert tuple(one(spark, geo.polygon_box(polygon([(0, 0), (10, 0), (5, 8)])))) == (0, 0, 10, 8)
    assert one(spark, polygon([(0, 0), (1, 1)])) is None and one(spark, polygon([(0, 0), (1, 1), (2,)])) is None
    assert one(spark, polygon([(0, 0, 9), (1, 1), (2, 0)])) is not None
    zones = spark.createDataFrame([("z1", square(0.0, 10.0)), ("z2", square(20.0, 30.0)), ("z3", square(40.0, 50.0)), ("bad", [[1.0]]), ("null", None)], "doc_id string, shape array<array<double>>")
    z = spatial.with_polygons(zones)
    assert z.count() == 3
    assert ids(spatial.find_polygons_containing(z, 5, 5)) == ["z1"] and ids(spatial.find_polygons_containing(z, 25, 25)) == ["z2"]
    assert spatial.find_polygons_containing(z, 100, 100).count() == 0
    assert ids(spatial.find_polygons_meeting(z, 0, 0, 35, 35)) == ["z1", "z2"]


def test_points_in_a_diamond_and_joins_against_brute_force(spark):
    diamond = [(5, 2), (8, 5), (5, 8), (2, 5)]
    pts = spark.createDataFrame([(f"{x},{y}", x + 0.1, y + 0.2) for x in range(10) for y in range(10)], P)
    want = {f"{x},{y}" for x in range(10) for y in range(10) if abs(x + 0.1 - 5) + abs(y + 0.2 - 5) < 3}
    assert set(ids(spatial.find_points_in_polygon(pts, diamond))) == want
    assert spatial.find_points_in_polygon(pts, diamond[:2]).count() == 0
    r = random.Random(2)
    data = [(f"p{i}", r.uniform(-50, 50), r.uniform(-50, 50)) for i in range(1000)]
    boxes = [(i, *(c := (r.uniform(-50, 50), r.uniform(-50, 50))), r.uniform(1, 12)) for i in range(40)]
    z = spark.createDataFrame([(i, [[x, y - h], [x + h, y], [x, y + h], [x - h, y]]) for i, x, y, h in boxes], "zone int, shape array<array<double>>")
    df = spark.createDataFrame(data, P)
    got = {(r.doc_id, r.zone) for r in spatial.points_in_polygons(df, spatial.with_polygons(z), cell=7).collect()}
    assert got == {(k, i) for k, x, y in data for i, cx, cy, h in boxes if abs(x - cx) + abs(y - cy) < h}
    assert tuple(spatial.union_box(spatial.with_polygons(z).limit(0)).select("area").first()) == (0.0,)


def arc(a, b):
    lon, lat, lon2, lat2 = map(math.radians, (*a, *b))
    h = math.sin((lat2 - lat) / 2) ** 2 + math.cos(lat) * math.cos(lat2) * math.sin((lon2 - lon) / 2) ** 2
    return 2 * 6371008.8 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("metric,dist", [("planar", math.dist), ("geographic", arc)])
def test_neighbours_against_brute_force(spark, metric, dist):
    r = random.Random(3)
    data = [(f"p{i:04}", r.uniform(-180, 180), r.uniform(-90, 90)) for i in range(400)] + [(f"hot{i:04}", 10 + r.random() * 1e-3, 50.0) for i in range(300)] + [("pole", 0.0, 90.0), ("tie1", 7.0, 7.0), ("tie0", 7.0, 7.0)]
    asked = [(i, r.uniform(-180, 180), r.uniform(-90, 90)) for i in range(60)] + [(90, 10.0, 50.0), (91, 179.99, -89.9), (92, -179.99, 0.0), (93, 7.0, 7.0), (94, 500.0 if metric == "planar" else 0.0, 0.0)]
    df = spark.createDataFrame([*data, ("void", None, 3.0)], P)
    q = spark.createDataFrame([*asked, (99, 1.0, None)], "query_id int, qx double, qy double")
    for k in (1, 5, 2000):
        got = {}
        for row in neighbours.nearest_join(q, df, k, metric).orderBy("query_id", "rank").collect():
            got.setdefault(row.query_id, []).append(row.doc_id)
        want = {i: [n for _, n in sorted((dist((px, py), (x, y)), n) for n, px, py in data)][:k] for i, x, y in asked}
        assert {i: (len(v), sorted(v)[:3]) for i, v in got.items()} == {i: (len(v), sorted(v)[:3]) for i, v in want.items()} if k > 5 else got == want
    assert neighbours.nearest_join(q, df, 0, metric).count() == neighbours.nearest_join(q, df.limit(0), 3, metric).count() == neighbours.nearest_join(q.limit(0), df, 3, metric).count() == 0
    most = 20.0 if metric == "planar" else 2_000_000.0
    got = {(x.query_id, x.doc_id) for x in neighbours.radius_join(q, df, most, metric).collect()}
    assert got == {(i, n) for i, x, y in asked for n, px, py in data if dist((px, py), (x, y)) <= most}
    assert neighbours.radius_join(q, df, -1, metric).count() == 0
    assert neighbours.radius_join(q, df, F.when(F.col("query_id") == 93, 0.0).otherwise(-1), metric).count() == 2


@pytest.fixture
def shuffled(monkeypatch):
    """Joins as they are done where neither side fits a broadcast, with crowds split from a few rows on."""
    from tidemark.plans import skew

    for m in (neighbours, spatial):
        monkeypatch.setattr(m, "fits", lambda df: False)
        monkeypatch.setattr(m, "crowded", lambda df, on, *_: skew.crowded(df, on, 0.01, 5))
    monkeypatch.setattr(neighbours, "SHARE", 0.01)


@pytest.mark.parametrize("metric,dist", [("planar", math.dist), ("geographic", arc)])
def test_neighbours_by_shuffle_with_crowded_cells(spark, metric, dist, shuffled):
    test_neighbours_against_brute_force(spark, metric, dist)


def test_polygon_join_by_shuffle_with_crowded_cells(spark, shuffled):
    r = random.Random(12)
    data = [(f"p{i}", r.uniform(-50, 50), r.uniform(-50, 50)) for i in range(400)] + [(f"h{i}", 3.0, 4.0) for i in range(200)]
    boxes = [(i, *(c := (r.uniform(-50, 50), r.uniform(-50, 50))), 10 ** r.uniform(-3, 1.8)) for i in range(60)] + [(100 + i, 3.0, 4.0, 5.0) for i in range(20)]
    z = spatial.with_polygons(spark.createDataFrame([(i, [[x, y - h], [x + h, y], [x, y + h], [x - h, y]]) for i, x, y, h in boxes], "zone int, shape array<array<double>>"))
    got = [(x.doc_id, x.zone) for x in spatial.points_in_polygons(spark.createDataFrame(data, P), z).collect()]
    assert sorted(got) == sorted((k, i) for k, x, y in data for i, cx, cy, h in boxes if abs(x - cx) + abs(y - cy) < h)
    assert spatial.points_in_polygons(spark.createDataFrame(data, P), z.limit(0)).count() == 0


@pytest.mark.parametrize("metric", ["planar", "geographic"])
def test_what_a_query_is_held_against_does_not_grow_with_the_data(spark, metric):
    from tidemark.operators.neighbours import _coordinates, asked_cells, cells

    per = []
    for n in (20_000, 200_000):
        p = spark.range(n).select(F.expr("rand(1) * 360 - 180").alias("lon"), F.expr("degrees(asin(2 * rand(2) - 1))").alias("lat"))
        c = _coordinates(metric, F.col("lon"), F.col("lat"))
        grid = cells(p, c, metric)
        assert grid.total == n and grid.counts[grid.leaf].sum() == n and grid.counts[grid.leaf].max() <= neighbours.POPULATION
        at = [f"a{i}" for i in range(len(c))]
        q = p.limit(500).select(*[x.alias(a) for x, a in zip(c, at)], F.lit(-1.0).alias("r"))
        asked = asked_cells(q, grid, 4, at, "r", "cell").groupBy("cell").count().collect()
        held = dict(zip(grid.numbers, grid.counts))
        per.append(sum(held[r["cell"]] * r["count"] for r in asked) / 500)
    assert per[1] < 1.5 * per[0] and max(per) < 30 * neighbours.POPULATION
