"""Queries over collections, places, series, rasters, vectors, logs and schemas, and their SQL.

The driver's tables stand in: customers are places, nations zones, events a series, a change log and raster frames.
Coordinates come from the keys by integer arithmetic, which both engines do alike; no point lies on a zone's edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, linalg
from ..operators import access, changelog, matrix, neighbours, raster, replication, series, spatial, txn, validators
from ..sources import shared
from ..streaming import subscriptions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- stand-ins ---------------------------------------------------------------------------------------------------------
PLACES = """places AS (SELECT c_custkey AS doc_id, (c_custkey * 7919 % 36000) / CAST(100 AS DOUBLE) - 180 AS lon,
  (c_custkey * 104729 % 17000) / CAST(100 AS DOUBLE) - 85 AS lat FROM customer)"""
ZONES = """zones AS (SELECT n_nationkey AS zone, CAST(n_nationkey * 1373 % 340 - 170 AS DOUBLE) + 0.003 AS cx,
  CAST(n_nationkey * 977 % 150 - 75 AS DOUBLE) + 0.004 AS cy, CAST(3 + n_nationkey % 7 AS DOUBLE) AS h FROM nation)"""
EVENTS = """ev AS (SELECT user_id AS series_id, event_id AS append_seq, epoch_us(ts) // 1000 AS ts_ms, value FROM events)"""
LOG = """log AS (SELECT 'c' || CAST(user_id % 3 AS VARCHAR) AS collection, user_id AS doc_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op,
  event_id AS seq, value, props, 'n' || CAST(event_id % 4 AS VARCHAR) AS origin_node, CASE WHEN event_id % 11 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS change_id FROM events)"""
VERSIONS = (
    LOG
    + """, e AS (SELECT *, sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY collection, doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ep FROM log),
  v AS (SELECT *, row_number() OVER (PARTITION BY collection, doc_id, coalesce(ep, 0) ORDER BY seq) AS version FROM e),
  versions AS (SELECT collection, doc_id, seq, op, value, CAST(version AS BIGINT) AS version FROM v WHERE op = 'put' OR version > 1)"""
)
HAV = "2 * 6371008.8 * atan2(sqrt({h}), sqrt(greatest(0, 1 - ({h}))))"


def _hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    h = f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)"
    return HAV.format(h=h)


def places(spark, d):
    c = _t(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("doc_id"), F.expr("(c_custkey * 7919 % 36000) / cast(100 as double) - 180").alias("lon"), F.expr("(c_custkey * 104729 % 17000) / cast(100 as double) - 85").alias("lat"))


def zones(spark, d):
    n = _t(spark, d, "nation").selectExpr("n_nationkey as zone", "cast(n_nationkey * 1373 % 340 - 170 as double) + 0.003D as cx", "cast(n_nationkey * 977 % 150 - 75 as double) + 0.004D as cy", "cast(3 + n_nationkey % 7 as double) as h")
    n = n.withColumn("shape", F.expr("array(array(cx, cy - h), array(cx + h, cy), array(cx, cy + h), array(cx - h, cy))"))
    return spatial.with_polygons(n).drop("shape")


def samples(spark, d):
    ms = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) div 1000")
    return _t(spark, d, "events").select(F.col("user_id").alias("series_id"), F.col("event_id").alias("append_seq"), ms.alias("ts_ms"), "value")


def log(spark, d):
    e = _t(spark, d, "events")
    return e.selectExpr(
        "concat('c', cast(user_id % 3 as string)) as collection", "user_id as doc_id", "if(event_type = 'error', 'delete', 'put') as op", "event_id as seq", "value", "props",
        "concat('n', cast(event_id % 4 as string)) as origin_node", "if(event_id % 11 = 0, '', cast(event_id as string)) as change_id",
    )


# -- point and bulk reads ----------------------------------------------------------------------------------------------
@query("SELECT * FROM customer WHERE c_custkey = 42")
def get_one(spark, d):
    return access.get(_t(spark, d, "customer"), 42, "c_custkey")


@query("SELECT c.* FROM customer c JOIN (VALUES (5), (3), (5), (999999999)) v(k) ON c_custkey = k")
def get_many(spark, d):
    return access.get_many(_t(spark, d, "customer"), [5, 3, 5, 999_999_999], "c_custkey")


@query("SELECT o_orderkey, o_totalprice, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def get_many_bulk(spark, d):
    """As many lookups in one job as there are line items."""
    ids = _t(spark, d, "lineitem").selectExpr("l_orderkey as o_orderkey", "l_linenumber")
    return access.get_many(_t(spark, d, "orders"), ids, "o_orderkey").select("o_orderkey", "o_totalprice", "l_linenumber")


@query("SELECT c_custkey, c_name, pos FROM customer JOIN (VALUES (0, 9), (1, 2), (2, 7)) v(pos, k) ON c_custkey = k")
def get_many_in_order(spark, d):
    return access.get_many(_t(spark, d, "customer"), [9, 2, 7], "c_custkey", "pos").select("c_custkey", "c_name", "pos").orderBy("pos")


@query("SELECT c_custkey, c_acctbal FROM customer")
def get_all_projection(spark, d):
    return access.get_all(_t(spark, d, "customer")).select("c_custkey", "c_acctbal")


@query(f"WITH {VERSIONS} SELECT CAST(coalesce((SELECT max_by(version, seq) FROM versions WHERE doc_id = 8), 0) AS BIGINT) AS version")
def current_version(spark, d):
    state = changelog.with_versions(log(spark, d).filter("doc_id = 8"))  # no other document is versioned
    return access.current_version(changelog.latest_by(state, ["doc_id"], [F.col("seq")]), 8)


# -- equality and range ------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def find_by_eq(spark, d):
    return access.find_by(_t(spark, d, "orders"), {"o_orderpriority": "1-URGENT"}, key="o_orderkey").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'F'")
def find_by_composite(spark, d):
    return access.find_by(_t(spark, d, "orders"), {"o_orderpriority": "2-HIGH", "o_orderstatus": "F"}, key="o_orderkey").select("o_orderkey")


@query("SELECT seq FROM repl_changes WHERE relay_node IS NULL")
def find_by_null(spark, d):
    return access.find_by(_t(spark, d, "repl_changes"), {"relay_node": None}, key="seq").select("seq")


@query("SELECT o_orderkey FROM orders WHERE false")
def find_by_other_kind(spark, d):
    """An int is never equal to a float."""
    return access.find_by(_t(spark, d, "orders"), {"o_totalprice": 1000}, key="o_orderkey").select("o_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 25")
def find_by_limit(spark, d):
    return access.find_by(_t(spark, d, "orders"), {"o_orderstatus": "O"}, 25, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
def range_by_asc(spark, d):
    return access.range_by(_t(spark, d, "orders"), "o_totalprice", 1000.0, 50000.0, key="o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def range_by_desc_limit(spark, d):
    return access.range_by(_t(spark, d, "orders"), "o_totalprice", 1000.0, ascending=False, limit=20, key="o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE c_nationkey > 3 AND c_nationkey < 9")
def range_by_exclusive(spark, d):
    return access.range_by(_t(spark, d, "customer"), "c_nationkey", 3, 9, include_low=False, include_high=False, key="c_custkey").select("c_custkey")


@query("SELECT series_id, block_seq, sample_count FROM blocks WHERE sample_count >= 110 OR sample_count IS NULL")
def range_by_open_int(spark, d):
    """Open above, so nulls, which come after ints, are in it."""
    return access.range_by(_t(spark, d, "blocks"), "sample_count", 110, key="block_seq").select("series_id", "block_seq", "sample_count")


@query("SELECT seq, relay_node FROM repl_changes WHERE relay_node <= 'node-f' OR relay_node IS NULL")
def range_by_open_string(spark, d):
    """Open below, so nulls, which come before strings, are in it."""
    return access.range_by(_t(spark, d, "repl_changes"), "relay_node", None, "node-f", key="seq").select("seq", "relay_node")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority >= '2' AND o_orderpriority < '4'")
def range_by_string(spark, d):
    return access.range_by(_t(spark, d, "orders"), "o_orderpriority", "2", "4", include_high=False, key="o_orderkey").select("o_orderkey")


# -- places ------------------------------------------------------------------------------------------------------------
def _rounded(df, digits=3):
    return df.select("doc_id", F.round("distance", digits).alias("distance"))


@query(f"WITH {PLACES} SELECT doc_id, lon, lat FROM places WHERE lon BETWEEN -130 AND -70 AND lat BETWEEN 30 AND 45")
def bbox_scan(spark, d):
    return spatial.find_in_box(places(spark, d), -130, 30, -70, 45)


@query(f"WITH {PLACES} SELECT doc_id, round(sqrt(pow(lon - 10, 2) + pow(lat - 20, 2)), 9) AS distance FROM places ORDER BY sqrt(pow(lon - 10, 2) + pow(lat - 20, 2)), doc_id LIMIT 10")
def nearest_planar(spark, d):
    return _rounded(spatial.find_nearest(places(spark, d), 10, 20, 10), 9)


@query(f"WITH {PLACES} SELECT doc_id, round({_hav('lon', 'lat', '179.5', '60.0')}, 3) AS distance FROM places ORDER BY {_hav('lon', 'lat', '179.5', '60.0')}, doc_id LIMIT 10")
def nearest_geo(spark, d):
    return _rounded(spatial.find_nearest(places(spark, d), 179.5, 60, 10, "geographic"))


@query(f"""WITH {PLACES} SELECT doc_id, round({_hav('-122.42', '37.77', 'lon', 'lat')}, 3) AS distance FROM places
  WHERE abs(lat - 37.77) <= 3000000 / 111320.0::DOUBLE AND abs(lon + 122.42) <= 3000000 / 111320.0::DOUBLE / cos(radians(37.77)) AND {_hav('-122.42', '37.77', 'lon', 'lat')} <= 3000000""")
def within_radius(spark, d):
    return _rounded(spatial.find_within_radius(places(spark, d), -122.42, 37.77, 3_000_000))


@query(f"WITH {PLACES} SELECT doc_id, round({_hav('178.0', '10.0', 'lon', 'lat')}, 3) AS distance FROM places WHERE {_hav('178.0', '10.0', 'lon', 'lat')} <= 3000000")
def within_radius_exact(spark, d):
    return _rounded(spatial.find_within_radius(places(spark, d), 178, 10, 3_000_000, exact=True))


@query(f"WITH {PLACES} SELECT doc_id, round(sqrt(pow(lon - 50, 2) + pow(lat, 2)), 9) AS distance FROM places WHERE sqrt(pow(lon - 50, 2) + pow(lat, 2)) <= 8.001")
def nearest_within(spark, d):
    return _rounded(spatial.find_nearest_within(places(spark, d), 50, 0, 8.001), 9)


@query(f"WITH {ZONES} SELECT zone FROM zones WHERE abs(cx - (-28.5)) + abs(cy - 20.5) < h")
def polygons_containing(spark, d):
    return spatial.find_polygons_containing(zones(spark, d), -28.5, 20.5, key="zone").select("zone")


@query(f"WITH {ZONES} SELECT zone FROM zones WHERE cx - h <= 35 AND cx + h >= -60 AND cy - h <= 40 AND cy + h >= -10")
def polygons_intersecting(spark, d):
    return spatial.find_polygons_meeting(zones(spark, d), -60, -10, 35, 40, key="zone").select("zone")


@query(f"WITH {PLACES} SELECT doc_id FROM places WHERE abs(lon - 20.003) + abs(lat - 10.004) < 25")
def points_in_polygon(spark, d):
    v = [(20.003, -14.996), (45.003, 10.004), (20.003, 35.004), (-4.997, 10.004)]
    return spatial.find_points_in_polygon(places(spark, d), v).select("doc_id")


@query(f"WITH {PLACES}, {ZONES} SELECT doc_id, zone FROM places JOIN zones ON abs(lon - cx) + abs(lat - cy) < h")
def zone_join(spark, d):
    return spatial.points_in_polygons(places(spark, d), zones(spark, d)).select("doc_id", "zone")


@query(f"""WITH {PLACES}, {ZONES} SELECT zone, doc_id, CAST(r AS BIGINT) AS rank FROM (SELECT zone, doc_id,
  row_number() OVER (PARTITION BY zone ORDER BY sqrt(pow(lon - cx, 2) + pow(lat - cy, 2)), doc_id) AS r FROM places, zones) WHERE r <= 5""")
def knn_join(spark, d):
    got = neighbours.nearest_join(zones(spark, d).select("zone", "cx", "cy"), places(spark, d), 5, query_key="zone", x="cx", y="cy")
    return got.select("zone", "doc_id", F.col("rank").cast("long").alias("rank"))


_ARC = _hav("a.lon", "a.lat", "b.lon", "b.lat")


@query(f"""WITH {PLACES} SELECT query_id, doc_id, CAST(r AS BIGINT) AS rank, round(d, 3) AS distance FROM (SELECT a.doc_id AS query_id, b.doc_id, {_ARC} AS d,
  row_number() OVER (PARTITION BY a.doc_id ORDER BY {_ARC}, b.doc_id) AS r FROM places a, places b) WHERE r <= 4""")
def knn_self_join(spark, d):
    """The four nearest of every place by great circle, itself included."""
    p = places(spark, d)
    got = neighbours.nearest_join(p.select(F.col("doc_id").alias("query_id"), F.col("lon").alias("qx"), F.col("lat").alias("qy")), p, 4, "geographic")
    return got.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 3).alias("distance"))


@query(f"WITH {PLACES} SELECT a.doc_id AS query_id, b.doc_id, round({_ARC}, 3) AS distance FROM places a, places b WHERE {_ARC} <= 300000")
def radius_self_join(spark, d):
    """All places within 300 km of every place."""
    p = places(spark, d)
    got = neighbours.radius_join(p.select(F.col("doc_id").alias("query_id"), F.col("lon").alias("qx"), F.col("lat").alias("qy")), p, 300_000)
    return got.select("query_id", "doc_id", F.round("distance", 3).alias("distance"))


@query(f"WITH {ZONES} SELECT round(min(cx - h), 6) AS min_x, round(min(cy - h), 6) AS min_y, round(max(cx + h), 6) AS max_x, round(max(cy + h), 6) AS max_y, round((max(cx + h) - min(cx - h)) * (max(cy + h) - min(cy - h)), 3) AS area FROM zones")
def bbox_union_area(spark, d):
    u = spatial.union_box(zones(spark, d))
    return u.select(*[F.round(c, 6).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")], F.round("area", 3).alias("area"))


@query(f"WITH {ZONES} SELECT zone, round({_hav('10.0', '45.0', 'least(greatest(10.0, cx - h), cx + h)', 'least(greatest(45.0, cy - h), cy + h)')}, 3) AS meters FROM zones")
def haversine_min_metres(spark, d):
    return zones(spark, d).select("zone", F.round(geo.haversine_to_box(10, 45, F.col("box")), 3).alias("meters"))


# -- vectors and matrices ----------------------------------------------------------------------------------------------
_V = "CAST(embedding AS DOUBLE[])"
_PAIRS = f"(SELECT a.vec_id, {_V.replace('embedding', 'a.embedding')} AS a, {_V.replace('embedding', 'b.embedding')} AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", linalg.vector(F.col("embedding")).alias("a"))


def _pairs(spark, d):
    v = _vectors(spark, d)
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


@query(f"SELECT vec_id, round(list_sum(list_transform(a, lambda x: x)) + list_sum(b), 6) AS s FROM {_PAIRS}")
def vec_add(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(F.aggregate(linalg.add(F.col("a"), F.col("b")), F.lit(0.0), lambda s, x: s + x), 6).alias("s"))


@query(f"SELECT vec_id, round(list_dot_product(a, b), 9) AS dot FROM {_PAIRS}")
def vec_dot(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(linalg.dot(F.col("a"), F.col("b")), 9).alias("dot"))


@query(f"SELECT vec_id, round(sqrt(list_dot_product({_V}, {_V})), 9) AS norm FROM embeddings")
def vec_norm(spark, d):
    return _vectors(spark, d).select("vec_id", F.round(linalg.norm(F.col("a")), 9).alias("norm"))


@query(f"SELECT vec_id, round(list_distance(a, b), 9) AS distance FROM {_PAIRS}")
def vec_euclid(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(linalg.euclidean(F.col("a"), F.col("b")), 9).alias("distance"))


@query(f"SELECT vec_id, round({_V}[1] / sqrt(list_dot_product({_V}, {_V})), 9) AS first FROM embeddings")
def vec_normalize(spark, d):
    return _vectors(spark, d).select("vec_id", F.round(linalg.normalize(F.col("a"))[0], 9).alias("first"))


_Q = ", ".join(f"{(i % 5) - 2}.0::DOUBLE" for i in range(64))


@query(f"SELECT vec_id, round(list_cosine_similarity({_V}, [{_Q}]), 9) AS similarity FROM embeddings ORDER BY list_cosine_similarity({_V}, [{_Q}]) DESC, vec_id LIMIT 10")
def vec_cosine_topk(spark, d):
    got = matrix.most_similar(_t(spark, d, "embeddings"), [float((i % 5) - 2) for i in range(64)], 10, key="vec_id")
    return got.select("vec_id", F.round("similarity", 9).alias("similarity"))


_M = f"m AS (SELECT vec_id AS i, unnest(range(0, 64)) AS j, unnest({_V}) AS v FROM embeddings)"


def _matrix(spark, d):
    return matrix.from_rows(_t(spark, d, "embeddings"), "vec_id", "embedding")


@query(f"WITH {_M} SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY a.j, b.j")
def mat_mul(spark, d):
    m = _matrix(spark, d)
    return matrix.matmul(matrix.transpose(m), m).select("i", "j", F.round("v", 6).alias("v"))


@query(f"WITH {_M} SELECT j AS i, i AS j, round(v, 9) AS v FROM m")
def mat_transpose(spark, d):
    return matrix.transpose(_matrix(spark, d)).select("i", "j", F.round("v", 9).alias("v"))


@query(f"WITH {_M} SELECT round(sum(v * v), 6) AS trace FROM m")
def mat_trace(spark, d):
    m = _matrix(spark, d)
    return matrix.trace(matrix.matmul(matrix.transpose(m), m)).select(F.round("trace", 6).alias("trace"))


@query(f"WITH {_M} SELECT i, round(sum(v * (j + 1)), 6) AS v FROM m GROUP BY i")
def mat_vec(spark, d):
    x = spark.range(64).select(F.col("id").alias("j"), (F.col("id") + 1).cast("double").alias("x"))
    return matrix.matvec(_matrix(spark, d), x).select("i", F.round("v", 6).alias("v"))


@query(f"WITH {_M} SELECT i, j, round(v + v - 3 * v, 9) AS v FROM m")
def mat_add_sub_scale(spark, d):
    m = _matrix(spark, d)
    return matrix.sub(matrix.add(m, m), matrix.scale(m, 3)).select("i", "j", F.round("v", 9).alias("v"))


# -- series ------------------------------------------------------------------------------------------------------------
@query(f"WITH {EVENTS} SELECT * FROM ev WHERE ts_ms BETWEEN 1704500000000 AND 1704900000000")
def series_range(spark, d):
    return series.in_range(samples(spark, d), 1704500000000, 1704900000000)


@query(f"WITH {EVENTS} SELECT * FROM ev ORDER BY append_seq DESC LIMIT 50")
def series_latest(spark, d):
    return series.latest(samples(spark, d), 50)


@query(f"WITH {EVENTS} SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY append_seq DESC) <= 3")
def series_latest_each(spark, d):
    return series.latest_each(samples(spark, d), 3)


@query(f"WITH {EVENTS} SELECT series_id, count(*) AS samples, min_by(ts_ms, append_seq) AS first_ts, max_by(ts_ms, append_seq) AS last_ts FROM ev GROUP BY series_id")
def series_stats(spark, d):
    return series.stats(samples(spark, d))


def _blocks_sql(src: str, n: int) -> str:
    return f"""s AS (SELECT *, sum(CASE WHEN ts_ms < p THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY append_seq) AS seg
      FROM (SELECT *, lag(ts_ms) OVER (PARTITION BY series_id ORDER BY append_seq) AS p FROM {src})),
    r AS (SELECT *, (row_number() OVER (PARTITION BY series_id, seg ORDER BY append_seq) - 1) // {n} AS part FROM s),
    b AS (SELECT series_id, CAST(seg AS BIGINT) AS seg, part, count(*) AS samples, min_by(ts_ms, append_seq) AS start_ts, max_by(ts_ms, append_seq) AS end_ts,
      min(value) AS min_val, max(value) AS max_val FROM r GROUP BY ALL)"""


@query(f"WITH {EVENTS}, {_blocks_sql('ev', 16)} SELECT * FROM b")
def series_blocks(spark, d):
    return series.block_stats(samples(spark, d), 16)


_SHUFFLED = EVENTS + ", so AS (SELECT series_id, (append_seq * 7919 % 10007) * 1048576 + append_seq AS append_seq, ts_ms, value FROM ev)"


@query(f"WITH {_SHUFFLED}, {_blocks_sql('so', 3)} SELECT * FROM b")
def series_out_of_order(spark, d):
    s = samples(spark, d).withColumn("append_seq", F.expr("(append_seq * 7919 % 10007) * 1048576 + append_seq"))
    rows = series.with_blocks(s, 3, chunk=1 << 30)
    return rows.groupBy("series_id", "seg", "part").agg(F.count(F.lit(1)).alias("samples"), F.min_by("ts_ms", "append_seq").alias("start_ts"), F.max_by("ts_ms", "append_seq").alias("end_ts"), F.min("value").alias("min_val"), F.max("value").alias("max_val"))


@query(f"""WITH {EVENTS}, {_blocks_sql('ev', 16)}, gone AS (SELECT series_id, seg, part FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY seg DESC, part DESC) AS k FROM b)
  WHERE end_ts < 1705500000000 AND NOT (k = 1 AND samples < 16)) SELECT r.series_id, append_seq, ts_ms, value FROM r ANTI JOIN gone g ON r.series_id = g.series_id AND r.seg = g.seg AND r.part = g.part""")
def series_retention(spark, d):
    return series.drop_blocks_before(samples(spark, d), 1705500000000, 16)


# -- rasters -----------------------------------------------------------------------------------------------------------
WORLD = raster.Grid(-180, -90, 180, 90, 18, 36)
TILES = raster.Grid(0, 0, 16, 16, 16, 16, tile_size=6)
_CELL = "CAST(least(floor((90 - lat) / 180 * 18), 17) AS INTEGER) AS row, CAST(least(floor((lon + 180) / 360 * 36), 35) AS INTEGER) AS col"
FRAMES = """frames AS (SELECT (epoch_us(ts) // 1000) // 86400000 * 86400000 AS ts_ms, CAST((user_id // 16) % 16 AS INTEGER) AS row, CAST(user_id % 16 AS INTEGER) AS col,
  round(sum(value), 4) AS value, min(event_id) AS append_seq FROM events GROUP BY ALL)"""
_FRAME = "SELECT g.ts_ms, CAST(g.r AS INTEGER) AS row, CAST(g.c AS INTEGER) AS col, 0 AS channel, coalesce(f.value, 0) AS value FROM (SELECT * FROM (SELECT DISTINCT ts_ms FROM frames WHERE {w}), range(16) a(r), range(16) b(c)) g LEFT JOIN frames f ON f.ts_ms = g.ts_ms AND f.row = g.r AND f.col = g.c"


def frames(spark, d):
    ms = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) div 1000 div 86400000 * 86400000")
    e = _t(spark, d, "events").select(ms.alias("ts_ms"), F.expr("cast((user_id div 16) % 16 as int)").alias("row"), F.expr("cast(user_id % 16 as int)").alias("col"), "value", "event_id")
    return e.groupBy("ts_ms", "row", "col").agg(F.round(F.sum("value"), 4).alias("value"), F.min("event_id").alias("append_seq")).withColumn("channel", F.lit(0))


@query(f"WITH {PLACES} SELECT doc_id, {_CELL} FROM places")
def mesh_cell_at(spark, d):
    at = WORLD.cell_at(F.col("lon"), F.col("lat"))
    return places(spark, d).select("doc_id", at["row"].alias("row"), at["col"].alias("col"))


@query(f"WITH {PLACES} SELECT doc_id, CAST(row * 36 + col AS DOUBLE) AS value FROM (SELECT doc_id, {_CELL} FROM places)")
def mesh_value_at(spark, d):
    cells = raster.mesh(spark, WORLD).withColumn("value", (F.col("row") * 36 + F.col("col")).cast("double"))
    return raster.value_at(places(spark, d), cells, WORLD).select("doc_id", "value")


@query("SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, round(-180 + (c + 0.5) * 10, 6) AS x, round(90 - (r + 0.5) * 10, 6) AS y FROM range(18) a(r), range(36) b(c)")
def mesh_cell_center(spark, d):
    p = WORLD.cell_center(F.col("row"), F.col("col"))
    return raster.mesh(spark, WORLD).select("row", "col", F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))


@query(f"WITH {FRAMES} {_FRAME.format(w='ts_ms = 1704844800000')}")
def tile_frame(spark, d):
    return raster.read_frame(frames(spark, d), TILES, 1704844800000)


@query(f"WITH {FRAMES} {_FRAME.format(w='ts_ms BETWEEN 1704412800000 AND 1705276800000')}")
def tile_frame_range(spark, d):
    return raster.read_frames(frames(spark, d), TILES, 1704412800000, 1705276800000)


@query(f"WITH {FRAMES} SELECT ts_ms, value FROM frames WHERE row = 2 AND col = 5 AND ts_ms BETWEEN 1704412800000 AND 1706000000000")
def tile_point_history(spark, d):
    return raster.point_history(frames(spark, d), TILES, 5.5, 13.5, 1704412800000, 1706000000000)


@query("SELECT CAST(3 AS INTEGER) AS tile_rows, CAST(3 AS INTEGER) AS tile_cols, CAST(4 AS INTEGER) AS last_rows, CAST(4 AS INTEGER) AS last_cols")
def tile_grid_dims(spark, d):
    return spark.createDataFrame([(*TILES.tile_dims(), *TILES.tile_extent(2, 2))], "tile_rows int, tile_cols int, last_rows int, last_cols int")


@query(f"WITH {FRAMES} SELECT max(ts_ms) AS ts_ms FROM frames")
def tile_latest_ts(spark, d):
    return raster.latest_ts(frames(spark, d))


# -- state, transactions, replication ----------------------------------------------------------------------------------
@query(f"WITH {LOG} SELECT collection, doc_id, seq, value FROM log QUALIFY row_number() OVER (PARTITION BY collection, doc_id ORDER BY seq DESC) = 1 AND op = 'put'")
def state_current(spark, d):
    return changelog.current(log(spark, d)).select("collection", "doc_id", "seq", "value")


@query(f"WITH {VERSIONS} SELECT * FROM versions")
def state_versions(spark, d):
    return changelog.with_versions(log(spark, d), chunk=4096).select("collection", "doc_id", "seq", "op", "value", "version")


@query(f"WITH {LOG} SELECT collection, doc_id, seq, value FROM log QUALIFY row_number() OVER (PARTITION BY collection, doc_id ORDER BY seq DESC) = 1 AND op = 'put'")
def state_overlay(spark, d):
    rows = log(spark, d)
    half = rows.agg(F.floor(F.max("seq") / 2)).first()[0] or 0
    snapshot = changelog.current(rows.filter(F.col("seq") <= half)).select("collection", "doc_id", "seq", "value")
    return changelog.overlay(snapshot, rows.filter(F.col("seq") > half))


_AT = "QUALIFY row_number() OVER (PARTITION BY collection, doc_id ORDER BY seq DESC) = 1"


@query(f"""WITH {VERSIONS}, half AS (SELECT max(seq) // 2 AS h FROM log), r AS (SELECT * FROM (SELECT * FROM versions WHERE seq <= (SELECT h FROM half) {_AT}) WHERE op = 'put'),
  c AS (SELECT * FROM (SELECT * FROM versions {_AT}) WHERE op = 'put')
  SELECT r.collection, r.doc_id, r.version, coalesce(c.version, 0) AS current FROM r LEFT JOIN c ON r.collection = c.collection AND r.doc_id = c.doc_id WHERE r.version <> coalesce(c.version, 0)""")
def txn_conflicts(spark, d):
    v = changelog.with_versions(log(spark, d))
    half = v.agg(F.max("seq")).first()[0] // 2
    reads = changelog.current(v.filter(F.col("seq") <= half)).select("collection", "doc_id", "version")
    return txn.conflicts(reads, changelog.current(v))


@query(f"WITH {LOG} SELECT collection, doc_id, seq, op, change_id FROM log WHERE seq > 500 AND change_id <> '' AND collection IN ('c0', 'c2') AND collection NOT IN ('c2')")
def export_changes(spark, d):
    return replication.export_changes(log(spark, d), 500, ["c0", "c2"], ["c2"]).select("collection", "doc_id", "seq", "op", "change_id")


@query(f"WITH {LOG} SELECT coalesce(max(seq), 500) AS cursor FROM log WHERE seq > 500 AND change_id <> '' AND collection = 'c1'")
def export_cursor(spark, d):
    return replication.export_cursor(log(spark, d), 500, include=["c1"])


_CLOCKED = LOG + ", k AS (SELECT *, seq * 7919 % 1009 AS wall, seq % 2 AS counter, seq * 31 % 10007 * 1000000 + seq AS pos FROM log)"


def _clocked(spark, d):
    rows = log(spark, d).withColumn("hlc", F.struct((F.col("seq") * 7919 % 1009).alias("wall"), (F.col("seq") % 2).alias("counter"), F.col("origin_node").alias("node")))
    return rows.withColumn("batch_pos", F.col("seq") * 31 % 10007 * 1000000 + F.col("seq"))


def _two_sides(spark, d):
    rows = _clocked(spark, d)
    local = changelog.latest_by(rows.filter("seq % 5 = 0"), ["collection", "doc_id"], [F.col("hlc"), F.col("batch_pos")])
    return local.drop("batch_pos"), rows.filter("seq % 5 <> 0")


_SIDES = _CLOCKED + """, l AS (SELECT * REPLACE (-1 AS pos) FROM k WHERE seq % 5 = 0 QUALIFY row_number() OVER (PARTITION BY collection, doc_id ORDER BY wall DESC, counter DESC, origin_node DESC, pos DESC) = 1),
  u AS (SELECT *, wall * 100 + counter * 10 + CAST(substr(origin_node, 2) AS BIGINT) AS h FROM (SELECT * FROM l UNION ALL SELECT * FROM k WHERE seq % 5 <> 0))"""


@query(f"WITH {_SIDES} SELECT collection, doc_id, seq, op, change_id FROM u QUALIFY row_number() OVER (PARTITION BY collection, doc_id ORDER BY h DESC, pos DESC) = 1")
def apply_changes_lww(spark, d):
    local, incoming = _two_sides(spark, d)
    return replication.apply_changes(local, incoming).select("collection", "doc_id", "seq", "op", "change_id")


@query(f"""WITH {_SIDES}, c AS (SELECT *, h >= coalesce(max(h) OVER (PARTITION BY collection, doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), h) AS cand FROM u),
  a AS (SELECT *, lag(change_id) OVER (PARTITION BY collection, doc_id ORDER BY pos) AS last FROM c WHERE cand)
  SELECT collection, doc_id, seq, change_id FROM a WHERE pos >= 0 AND change_id IS DISTINCT FROM last""")
def apply_changes_accepted(spark, d):
    local, incoming = _two_sides(spark, d)
    return replication.trace(local, incoming, chunk=1 << 30).filter("accepted").select("collection", "doc_id", "seq", "change_id")


@query(f"WITH {LOG} SELECT collection, doc_id, seq FROM log WHERE seq > 700")
def gc_log(spark, d):
    cursors = replication.set_cursor(spark.createDataFrame([("a", 900), ("b", 100)], "peer string, cursor long"), "b", 700)
    return replication.gc_log(log(spark, d), cursors).select("collection", "doc_id", "seq")


@query("""SELECT event_id, wall, CAST(row_number() OVER (PARTITION BY wall ORDER BY event_id) - 1 AS BIGINT) AS counter
  FROM (SELECT event_id, max(epoch_us(ts) // 600000000) OVER (ORDER BY event_id) AS wall FROM events)""")
def hlc_tick(spark, d):
    e = _t(spark, d, "events").select("event_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) div 600000000").alias("now"))
    return replication.tick(e, "now", "event_id", "n1").select("event_id", "hlc.wall", "hlc.counter")


# -- subscriptions -----------------------------------------------------------------------------------------------------
_FIELD = LOG + """, f AS (SELECT *, CASE WHEN op = 'put' THEN substr(props, 1, CAST(1 + seq % 8 AS INTEGER)) END AS new FROM log),
  g AS (SELECT *, lag(new) OVER (PARTITION BY collection, doc_id ORDER BY seq) AS old FROM f), h AS (SELECT * FROM g WHERE old IS DISTINCT FROM new)"""
_DELTAS = f"""WITH {_FIELD} SELECT collection, doc_id, seq, old, new, CASE WHEN old IS NULL THEN 'set' WHEN new IS NULL THEN 'delete' WHEN starts_with(new, old) THEN 'append' ELSE 'replace' END AS kind,
  CASE WHEN old IS NOT NULL AND new IS NOT NULL AND starts_with(new, old) THEN substr(new, length(old) + 1) END AS added FROM h"""


def _texts(spark, d):
    return log(spark, d).withColumn("props", F.expr("substring(props, 1, cast(1 + seq % 8 as int))"))


@query(f"WITH {_FIELD} SELECT collection, doc_id, seq, old, new FROM h")
def field_changes(spark, d):
    return subscriptions.field_changes(_texts(spark, d), "props", chunk=4096).select("collection", "doc_id", "seq", "old", "new")


@query(_DELTAS)
def field_deltas(spark, d):
    return subscriptions.field_deltas(_texts(spark, d), "props").select("collection", "doc_id", "seq", "old", "new", "kind", "added")


@query(_DELTAS)
def field_deltas_streamed(spark, d):
    """The same from a stream of the log, its state kept by document."""
    root = shared.fresh_folder(spark, "stream")
    _texts(spark, d).withColumns({"version": F.lit(0).cast("long"), "doc_id": F.col("doc_id").cast("string")}).write.parquet(f"{root}/log")
    stream = spark.readStream.schema(spark.read.parquet(f"{root}/log").schema).parquet(f"{root}/log")
    events = subscriptions.stream_deltas(stream, "props")
    q = subscriptions.deliver(events, lambda b, n: b.write.mode("overwrite").parquet(f"{root}/out/batch={n}"), f"{root}/state", availableNow=True)
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("collection", F.col("doc_id").cast("long").alias("doc_id"), "seq", "old", "new", "kind", "added")


@query(f"WITH {LOG} SELECT seq, op, value FROM log WHERE collection = 'c2' AND doc_id = 8")
def document_events(spark, d):
    return subscriptions.document(log(spark, d).withColumn("doc_id", F.col("doc_id").cast("string")), "c2", "8").select("seq", "op", "value")


# -- validation --------------------------------------------------------------------------------------------------------
def _page():
    v = validators
    return v.row({
        "lang": v.enum("en", "de", "fr", "es", "ru", "ja"), "source": v.string().min_len(12), "http_status": v.integer().gte(200).lte(299),
        "text": v.string().min_len(1).optional(), "url": v.string().matches("https://[a-z0-9.]+/"),
    })


_ISSUES = """SELECT doc_id, '$.lang' AS path, CASE WHEN lang IS NULL THEN 'wrong kind' ELSE 'none of the choices' END AS message FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'de', 'fr', 'es', 'ru', 'ja')
  UNION ALL SELECT doc_id, '$.source', CASE WHEN source IS NULL THEN 'wrong kind' ELSE 'too short' END FROM documents WHERE source IS NULL OR octet_length(encode(source)) < 12
  UNION ALL SELECT doc_id, '$.http_status', CASE WHEN http_status IS NULL THEN 'wrong kind' WHEN http_status < 200 THEN 'too small' ELSE 'too large' END FROM documents WHERE http_status IS NULL OR http_status NOT BETWEEN 200 AND 299
  UNION ALL SELECT doc_id, '$.text', 'too short' FROM documents WHERE text = ''
  UNION ALL SELECT doc_id, '$.url', CASE WHEN url IS NULL THEN 'wrong kind' ELSE 'no match' END FROM documents WHERE url IS NULL OR NOT regexp_matches(url, '^https://[a-z0-9.]+/')"""


@query(_ISSUES)
def validate_issues(spark, d):
    got = _page().parse(_t(spark, d, "documents"), F.lit(None))
    return got.select("doc_id", F.explode("issues").alias("i")).select("doc_id", "i.path", "i.message")


@query(f"SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_ISSUES}))")
def validate_ok(spark, d):
    good, _ = validators.split(_t(spark, d, "documents"), _page())
    return good.select("doc_id", "value.source")


@query("SELECT seq, CASE WHEN trim(value) = '' THEN NULL ELSE CAST(json_extract(value, '$.age') AS BIGINT) END AS age FROM repl_changes WHERE collection = 'users' AND json_valid(value) AND json_type(value, '$.age') = 'UBIGINT'")
def validate_variant(spark, d):
    rows = _t(spark, d, "repl_changes").withColumn("body", F.try_parse_json("value"))
    schema = validators.obj(age=validators.integer().gte(0))
    return schema.parse(rows, "body", "v", variant=True).filter("ok").select("seq", "v.age")


@query("SELECT seq, CASE WHEN trim(change_id) <> '' THEN lower(trim(change_id)) ELSE coalesce(relay_node, 'none') END AS v FROM repl_changes")
def validate_union(spark, d):
    v = validators
    first = v.string().trim().min_len(1).map(F.lower)
    instead = v.any_value().map(lambda c: F.coalesce("relay_node", F.lit("none")))
    return v.union(first, instead).parse(_t(spark, d, "repl_changes"), "change_id", "v").select("seq", "v")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
