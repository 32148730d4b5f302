"""Queries over the stored database, codecs, stored series and stacks, transactions, matrices and schema builders, and their SQL.

The driver's tables stand in, as in ``reference``. The database's collections come from customers: some are deleted, some
put again, the state is compacted, and further changes follow, so every read meets snapshot and log.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, linalg
from ..functions import values as V
from ..operators import access, changelog, matrix, raster, replication, series, spatial, txn
from ..operators import validators as v
from ..sources import codec, shared
from ..sources.database import Database
from ..streaming import subscriptions
from .reference import _V, EVENTS, FRAMES, LOG, PLACES, VERSIONS, ZONES, _blocks_sql, _FRAME, _PAIRS, _hav, _matrix, _pairs, _t, _vectors, frames, log, places, samples, zones

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _streamed(df: DataFrame) -> DataFrame:
    """What the row iterator gives; for results of a bounded size."""
    return df.sparkSession.createDataFrame(list(access.stream(df)), df.schema)


# -- the stored database -------------------------------------------------------------------------------------------------
PEOPLE = (
    PLACES
    + """, people AS (SELECT CAST(k AS VARCHAR) AS doc_id, CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment AS segment,
  CASE WHEN k % 11 = 0 THEN c_acctbal - 1 WHEN k % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance, CASE WHEN k % 11 = 0 THEN lon + 0.5 ELSE lon END AS lon, lat
  FROM (SELECT *, c_custkey AS k FROM customer) JOIN places p ON p.doc_id = k WHERE k % 13 <> 0 AND (k % 7 <> 0 OR k % 5 = 0 OR k % 11 = 0))"""
)
_made: dict[tuple[str, str], str] = {}


def _people(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").join(places(spark, d).withColumnRenamed("doc_id", "c_custkey"), "c_custkey")
    return c.selectExpr("c_custkey as k", "cast(c_custkey as string) as doc_id", "cast(c_nationkey as bigint) as nation", "c_mktsegment as segment", "c_acctbal as balance", "lon", "lat")


def database(spark: SparkSession, d: str) -> Database:
    """The stand-in, made once an application and folder of tables."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _made or not shared.exists(spark, f"{_made[at]}/manifest"):  # the shared folder may have been cleared
        db = Database(spark, shared.fresh_folder(spark, "database"))
        p = _people(spark, d)
        db.ensure_collection("none")
        db.put_many("people", p.drop("k"))
        db.delete_many("people", p.filter("k % 7 = 0"))
        db.put_many("people", p.filter("k % 5 = 0").withColumn("balance", F.expr("balance + 1")).drop("k"))
        z = zones(spark, d).select(F.col("zone").cast("string").alias("doc_id"), F.transform("polygon", lambda p: F.array(p["x"], p["y"])).alias("shape"))
        db.put_many("zones", z)
        db.create_index("people", "bySegment", "segment")
        db.create_index("people", "byNation", "nation")
        db.create_index("people", "byBoth", "segment, nation")
        db.create_geo_index("people", "byLoc", "lon", "lat")
        db.compact(files=8)
        db.create_polygon_index("zones", "byShape", "shape")  # over a snapshot that is there already
        db.put_many("people", p.filter("k % 11 = 0").withColumns({"balance": F.expr("balance - 1"), "lon": F.expr("lon + 0.5D")}).drop("k"))
        db.delete_many("people", p.filter("k % 13 = 0"))
        _made[at] = db.root
    return Database(spark, _made[at])


@query(f"WITH {PEOPLE} SELECT * FROM people")
def db_state(spark, d):
    """Snapshot and log of a database that was opened anew."""
    return database(spark, d).all("people").select("doc_id", "nation", "segment", "balance", "lon", "lat")


@query(f"WITH {PEOPLE} SELECT doc_id, balance FROM people")
def db_from_env(spark, d):
    before = os.environ.get("TIDEMARK_DIR")
    os.environ["TIDEMARK_DIR"] = database(spark, d).root
    try:
        return Database.from_env(spark).all("people").select("doc_id", "balance")
    finally:
        os.environ.pop("TIDEMARK_DIR") if before is None else os.environ.update(TIDEMARK_DIR=before)


@query(f"WITH {PEOPLE} SELECT doc_id, CAST(CASE WHEN CAST(doc_id AS BIGINT) % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS version FROM people")
def db_versions(spark, d):
    return database(spark, d).versions("people").select("doc_id", "version")


@query("SELECT unnest([0, 1, 0]) AS version, unnest(['1', '11', '13']) AS doc_id")
def db_current_version(spark, d):
    db = database(spark, d)
    got = [db.current_version("people", i).select(F.col("version").cast("int").alias("version"), F.lit(i).alias("doc_id")) for i in ("1", "11", "13")]
    return got[0].unionAll(got[1]).unionAll(got[2])


@query("SELECT unnest(['none', 'people', 'zones']) AS name")
def db_collections(spark, d):
    return spark.createDataFrame([(n,) for n in database(spark, d).collections()], "name string")


@query("""SELECT unnest(['equal', 'equal', 'equal', 'geo', 'polygon']) AS kind, unnest(['people', 'people', 'people', 'people', 'zones']) AS collection,
  unnest(['byBoth', 'byNation', 'bySegment', 'byLoc', 'byShape']) AS name, unnest(['segment,nation', 'nation', 'segment', 'lon,lat', 'shape']) AS spec""")
def db_paths(spark, d):
    return database(spark, d).paths()


@query("SELECT 'people' AS collection, 2 AS batches, (SELECT count(*) FROM customer WHERE c_custkey % 11 = 0) + (SELECT count(*) FROM customer WHERE c_custkey % 13 = 0) AS changes, true AS stored")
def db_log_stats(spark, d):
    return database(spark, d).log_stats().filter("collection = 'people'").select("collection", "batches", "changes", (F.col("bytes") > 0).alias("stored"))


@query(f"WITH {PEOPLE} SELECT doc_id, segment, balance FROM people WHERE doc_id = '17'")
def snapshot_lookup(spark, d):
    """One document: of the snapshot's files only the one whose zone holds the key is read."""
    return database(spark, d).get("people", "17").select("doc_id", "segment", "balance")


@query(f"WITH {PEOPLE} SELECT pos, doc_id, balance FROM people JOIN (VALUES (0, '22'), (1, '3'), (2, '13'), (3, '3')) t(pos, k) ON doc_id = k")
def db_get_many(spark, d):
    return database(spark, d).get_many("people", ["22", "3", "13", "3"], "pos").select("pos", "doc_id", "balance")


@query(f"WITH {PEOPLE} SELECT doc_id FROM people WHERE segment = 'BUILDING'")
def db_find_by(spark, d):
    return database(spark, d).find_by("people", "bySegment", "BUILDING").select("doc_id")


@query(f"WITH {PEOPLE} SELECT doc_id FROM people WHERE segment = 'MACHINERY' AND nation = 7")
def db_find_by_composite(spark, d):
    return database(spark, d).find_by("people", "byBoth", "MACHINERY", 7).select("doc_id")


@query(f"WITH {PEOPLE} SELECT doc_id, nation FROM people WHERE nation >= 3 AND nation < 6")
def db_range_by(spark, d):
    return database(spark, d).range_by("people", "byNation", 3, 6, include_high=False).select("doc_id", "nation")


@query(f"WITH {PEOPLE} SELECT doc_id, lon, lat FROM people WHERE lon BETWEEN -60 AND -20 AND lat BETWEEN -10 AND 25")
def db_bbox(spark, d):
    return database(spark, d).find_in_box("people", "byLoc", -60, -10, -20, 25).select("doc_id", "lon", "lat")


@query(f"WITH {PEOPLE} SELECT doc_id, round(sqrt(pow(lon - 33, 2) + pow(lat + 21, 2)), 9) AS distance FROM people ORDER BY sqrt(pow(lon - 33, 2) + pow(lat + 21, 2)), doc_id LIMIT 12")
def db_nearest(spark, d):
    return database(spark, d).find_nearest("people", "byLoc", 33, -21, 12).select("doc_id", F.round("distance", 9).alias("distance"))


@query(f"WITH {PEOPLE} SELECT doc_id, round({_hav('-179.5', '-40.0', 'lon', 'lat')}, 3) AS distance FROM people ORDER BY {_hav('-179.5', '-40.0', 'lon', 'lat')}, doc_id LIMIT 5")
def db_nearest_geo(spark, d):
    return database(spark, d).find_nearest("people", "byLoc", -179.5, -40, 5, "geographic").select("doc_id", F.round("distance", 3).alias("distance"))


@query(f"""WITH {PEOPLE} SELECT doc_id, round({_hav('12.0', '48.0', 'lon', 'lat')}, 3) AS distance FROM people WHERE abs(lat - 48) <= 2000000 / 111320.0::DOUBLE
  AND abs(lon - 12) <= 2000000 / 111320.0::DOUBLE / cos(radians(48)) AND {_hav('12.0', '48.0', 'lon', 'lat')} <= 2000000""")
def db_within_radius(spark, d):
    return database(spark, d).find_within_radius("people", "byLoc", 12, 48, 2_000_000).select("doc_id", F.round("distance", 3).alias("distance"))


@query(f"WITH {PEOPLE} SELECT doc_id FROM people WHERE abs(lon + 40.003) + abs(lat - 5.004) < 18")
def db_points_in_polygon(spark, d):
    return database(spark, d).find_points_in_polygon("people", "byLoc", [(-40.003, -12.996), (-22.003, 5.004), (-40.003, 23.004), (-58.003, 5.004)]).select("doc_id")


@query(f"WITH {ZONES} SELECT CAST(zone AS VARCHAR) AS doc_id FROM zones WHERE abs(cx - (-28.5)) + abs(cy - 20.5) < h")
def db_polygons_containing(spark, d):
    return database(spark, d).find_polygons_containing("zones", "byShape", -28.5, 20.5).select("doc_id")


@query(f"WITH {ZONES} SELECT CAST(zone AS VARCHAR) AS doc_id FROM zones WHERE cx - h <= 35 AND cx + h >= -60 AND cy - h <= 40 AND cy + h >= -10")
def db_polygons_meeting(spark, d):
    return database(spark, d).find_polygons_meeting("zones", "byShape", -60, -10, 35, 40).select("doc_id")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, n_name AS name FROM nation WHERE n_nationkey % 4 <> 1")
def db_compacted(spark, d):
    """Compacted twice, closed, and opened again after the access path was dropped."""
    db = Database(spark, shared.fresh_folder(spark, "compacted"))
    n = _t(spark, d, "nation").selectExpr("cast(n_nationkey as string) as doc_id", "n_name as name")
    db.put_many("nations", n)
    db.create_index("nations", "byName", "name")
    db.compact()
    db.delete_many("nations", n.filter("cast(doc_id as int) % 4 = 1"))
    db.drop_path("equal", "nations", "byName")
    db.compact()
    db.close()
    return Database(spark, db.root).all("nations").unionByName(db.find_by("nations", "byName", "FRANCE"), allowMissingColumns=True).select("doc_id", "name")


@query("SELECT unnest(['a', 'c']) AS doc_id, unnest([3, 5]) AS n, unnest([NULL, 'x']) AS s")
def db_single_writes(spark, d):
    db = Database(spark, shared.fresh_folder(spark, "single"))
    db.put("t", "a", n=1, s="old")
    db.put("t", "b", n=2)
    db.put("t", "a", n=3)
    db.delete("t", "b")
    db.delete("t", "never")
    db.put("t", "c", n=5, s="x")
    return db.all("t").select("doc_id", F.col("n").cast("int").alias("n"), "s")


@query(f"WITH {PEOPLE} SELECT count(*) AS n, count(*) AS again, true AS held FROM people")
def db_cached(spark, d):
    db = database(spark, d)
    kept = db.cache("people")
    try:
        n, again = kept.count(), kept.count()
        held = db.cache_stats().filter("cached > 0").count() > 0
    finally:
        kept.unpersist()
    return spark.createDataFrame([(n, again, held)], "n long, again long, held boolean")


@query("SELECT unnest(['rolled back', 'over the cap', 'read and wrote', 'read what changed', 'blind']) AS case_, unnest(['invalid', 'invalid', 'ok', 'conflict', 'ok']) AS status")
def db_txn_status(spark, d):
    """How transactions end; each check and append is one step."""
    db = Database(spark, shared.fresh_folder(spark, "txn"))
    db.put("t", "a", n=1)
    out = []
    t = db.begin()
    t.put("t", "a", {"n": 9})
    t.rollback()
    out.append(("rolled back", db.commit(t)))
    t = db.begin(cap=1)
    t.put("t", "a", {"n": 9})
    t.put("t", "b", {"n": 9})
    out.append(("over the cap", db.commit(t)))
    first, second, blind = db.begin(), db.begin(), db.begin()
    for t in (first, second):
        db.read(t, "t", "a")
        t.put("t", "a", {"n": 2 if t is first else 3})
    blind.delete("t", "zzz")
    blind.put("u", "x", {"n": 7})
    out += [("read and wrote", db.commit(first)), ("read what changed", db.commit(second)), ("blind", db.commit(blind))]
    return spark.createDataFrame(out, "case_ string, status string")


@query("SELECT unnest(['t', 't', 'u']) AS collection, unnest(['a', 'c', 'x']) AS doc_id, unnest([2, 4, 7]) AS n")
def db_txn_writes(spark, d):
    """What a commit over two collections leaves; reads don't see staged writes, and of two writes to one document the last counts."""
    db = Database(spark, shared.fresh_folder(spark, "txn"))
    db.put("t", "a", n=1)
    db.put("t", "b", n=1)
    t = db.begin()
    t.put("t", "a", {"n": 5})
    t.put("t", "a", {"n": db.read(t, "t", "a").first().n + 1})
    t.delete("t", "b")
    t.put("t", "c", {"n": 4})
    t.put("u", "x", {"n": 7})
    db.commit(t)
    return db.all("t").select(F.lit("t").alias("collection"), "doc_id", "n").unionAll(db.all("u").select(F.lit("u").alias("collection"), "doc_id", "n")).withColumn("n", F.col("n").cast("int"))


_LIVE = "SELECT collection, CAST(doc_id AS VARCHAR) AS doc_id, version FROM (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY collection, doc_id ORDER BY seq DESC) = 1) WHERE op = 'put'"


@query(f"WITH {VERSIONS} SELECT * FROM ({_LIVE}) WHERE doc_id IN ('8', '3', '5', '9') AND collection = 'c2' OR doc_id = '7' AND collection = 'c1'")
def txn_read_set(spark, d):
    """The versions that reads of single documents and of a list record; documents that aren't found are not recorded."""
    state = changelog.current(changelog.with_versions(log(spark, d).withColumn("doc_id", F.col("doc_id").cast("string")))).select("collection", "doc_id", "version")
    state = shared.written(state, "state")
    t = txn.Txn(spark)
    t.read(state, "c1", "7")
    t.read(state, "c1", "8")
    t.read_many(state, "c2", ["8", "3", "5", "9", "none"])
    t.read_many(state.withColumn("version", F.lit(99).cast("long")), "c2", ["8"])  # the first read counts
    return t.read_set()


@query("SELECT unnest(['a', 'b']) AS doc_id, unnest(['put', 'delete']) AS op, unnest(['{\"n\": 2}', NULL]) AS value")
def txn_write_set(spark, d):
    t = txn.Txn(spark)
    t.put("c", "a", {"n": 1})
    t.delete("c", "b")
    t.put("c", "a", {"n": 2})
    status, rows = t.commit(spark.createDataFrame([], "collection string, doc_id string, version long"))
    return rows.filter(F.lit(status == txn.OK)).select("doc_id", "op", "value")


@query("SELECT seq FROM repl_changes WHERE seq <= (SELECT max(seq) // 2 FROM repl_changes)")
def log_torn(spark, d):
    """A log whose last file is torn is read up to it."""
    rows = _t(spark, d, "repl_changes").select("seq", "op")
    at = shared.fresh_folder(spark, "torn")
    half = rows.agg(F.max("seq")).first()[0] // 2
    changelog.append(f"{at}/log", rows.filter(F.col("seq") <= half).coalesce(1))
    before = set(shared.names(spark, f"{at}/log"))
    changelog.append(f"{at}/log", rows.filter(F.col("seq") > half).coalesce(1))
    torn = next(n for n in shared.names(spark, f"{at}/log") if n.endswith(".parquet") and n not in before)
    shared.remove(spark, f"{at}/log/.{torn}.crc")
    shared.remove(spark, f"{at}/log/{torn}")
    shared.write_text(spark, f"{at}/log/{torn}", "PAR1 what is left")
    return spark.read.schema(rows.schema).option("ignoreCorruptFiles", "true").parquet(f"{at}/log").select("seq")


@query(f"WITH {VERSIONS} SELECT doc_id, coalesce((SELECT version FROM (SELECT * FROM versions v WHERE v.doc_id = t.doc_id ORDER BY seq DESC LIMIT 1) WHERE op = 'put'), 0) AS version FROM (VALUES (3), (8), (-1)) t(doc_id)")
def version_of_documents(spark, d):
    """The versions of single documents, 0 for one that is absent or deleted."""
    got = [changelog.version_of(log(spark, d), i).select(F.lit(i).alias("doc_id"), "version") for i in (3, 8, -1)]
    return got[0].unionAll(got[1]).unionAll(got[2])


# -- streams of rows -------------------------------------------------------------------------------------------------------
@query("SELECT n_nationkey, n_name FROM nation")
def stream_all(spark, d):
    return _streamed(access.get_all(_t(spark, d, "nation")).select("n_nationkey", "n_name"))


@query("SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
def stream_find_by(spark, d):
    return _streamed(access.find_by(_t(spark, d, "nation"), {"n_regionkey": 2}, key="n_nationkey").select("n_nationkey"))


@query("SELECT n_nationkey FROM nation WHERE n_nationkey BETWEEN 4 AND 11")
def stream_range_by(spark, d):
    return _streamed(access.range_by(_t(spark, d, "nation"), "n_nationkey", 4, 11, key="n_nationkey").select("n_nationkey"))


@query(f"""WITH {PLACES}, {ZONES} SELECT 'box' AS twin, doc_id FROM places WHERE lon BETWEEN -20 AND -5 AND lat BETWEEN 0 AND 20
  UNION ALL SELECT 'nearest', doc_id FROM (SELECT doc_id FROM places ORDER BY sqrt(pow(lon - 10, 2) + pow(lat - 20, 2)), doc_id LIMIT 3)
  UNION ALL SELECT 'radius', doc_id FROM places WHERE abs(lat - 10) <= 1000000 / 111320.0::DOUBLE AND abs(lon - 60) <= 1000000 / 111320.0::DOUBLE / cos(radians(10)) AND {_hav('60.0', '10.0', 'lon', 'lat')} <= 1000000
  UNION ALL SELECT 'inside', doc_id FROM places WHERE abs(lon - 20.003) + abs(lat - 10.004) < 9
  UNION ALL SELECT 'containing', zone FROM zones WHERE abs(cx - (-28.5)) + abs(cy - 20.5) < h
  UNION ALL SELECT 'meeting', zone FROM zones WHERE cx - h <= 35 AND cx + h >= -60 AND cy - h <= 40 AND cy + h >= -10""")
def stream_spatial(spark, d):
    """The row iterators of the six spatial reads."""
    p, z = places(spark, d), zones(spark, d).withColumn("doc_id", F.col("zone").cast("long"))
    diamond = [(20.003, 1.004), (29.003, 10.004), (20.003, 19.004), (11.003, 10.004)]
    got = {
        "box": spatial.find_in_box(p, -20, 0, -5, 20), "nearest": spatial.find_nearest(p, 10, 20, 3), "radius": spatial.find_within_radius(p, 60, 10, 1_000_000),
        "inside": spatial.find_points_in_polygon(p, diamond), "containing": spatial.find_polygons_containing(z, -28.5, 20.5), "meeting": spatial.find_polygons_meeting(z, -60, -10, 35, 40),
    }
    return spark.createDataFrame([(k, r.doc_id) for k, df in got.items() for r in access.stream(df.select("doc_id"))], "twin string, doc_id long")


# -- values, keys and codecs -----------------------------------------------------------------------------------------------
@query("""SELECT seq, CASE WHEN json_type(value, '$.age') = 'UBIGINT' THEN CAST(json_extract(value, '$.age') AS BIGINT) END AS age,
  CASE WHEN json_type(value, '$.name') = 'VARCHAR' THEN json_extract_string(value, '$.name') END AS name,
  CASE WHEN json_type(value, '$.done') = 'BOOLEAN' THEN CAST(json_extract(value, '$.done') AS BOOLEAN) END AS done,
  CASE WHEN json_type(value, '$.lon') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN round(CAST(json_extract(value, '$.lon') AS DOUBLE), 6) END AS lon
  FROM repl_changes WHERE value IS NOT NULL AND json_valid(value)""")
def variant_fields(spark, d):
    """Strict accessors at paths of VARIANT values of any layout."""
    rows = _t(spark, d, "repl_changes").withColumn("b", F.try_parse_json("value")).filter("b is not null")
    at = lambda p: V.at_path(F.col("b"), p)
    return rows.select("seq", V.to_int(at("age")).alias("age"), V.to_string(at("name")).alias("name"), V.to_bool(at("done")).alias("done"), F.round(V.to_number(at("lon")), 6).alias("lon"))


@query("""SELECT seq, CASE WHEN json_type(value, '$.name') = 'VARCHAR' THEN 'S|' || json_extract_string(value, '$.name') ELSE 'N|' END AS name_key,
  CASE WHEN json_type(value, '$.age') = 'UBIGINT' THEN 'I|' || lower(lpad(hex(CAST(json_extract(value, '$.age') AS UBIGINT) + 9223372036854775808), 16, '0')) ELSE 'N|' END AS age_key
  FROM repl_changes WHERE value IS NOT NULL AND json_valid(value)""")
def index_keys(spark, d):
    rows = _t(spark, d, "repl_changes").withColumn("b", F.try_parse_json("value")).filter("b is not null")
    return rows.select("seq", *[V.index_key(V.at_path(F.col("b"), p)).alias(f"{p}_key") for p in ("name", "age")])


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS place FROM customer")
def index_key_order(spark, d):
    """Keys of floats order as the floats do."""
    c = _t(spark, d, "customer").select("c_custkey", V.index_key(F.to_variant_object(F.array("c_acctbal")).cast("array<variant>")[0]).alias("k"))
    # The place of a key: that among the keys with its beginning, and all keys with lesser ones.
    part = c.withColumn("p", F.substring("k", 1, 6))
    earlier = F.sum("count").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    before = part.groupBy("p").count().withColumn("b", F.coalesce(earlier, F.lit(0))).select("p", "b")
    place = F.row_number().over(Window.partitionBy("p").orderBy("k", "c_custkey")) + F.col("b")
    return part.join(F.broadcast(before), "p").select("c_custkey", place.cast("long").alias("place"))


def _typed(spark, d):
    return _t(spark, d, "customer").select(F.col("c_custkey"), "c_name", "c_acctbal", (F.col("c_custkey") % 3 == 0).alias("third"), F.array(F.col("c_custkey") * -1, F.lit(0).cast("long")).alias("pair"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"))


_TYPED = "SELECT c_custkey, c_name, c_acctbal, c_custkey % 3 = 0 AS third, -c_custkey AS first, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment FROM customer"
_SCHEMA = "c_custkey long, c_name string, c_acctbal double, third boolean, pair array<long>, segment string"


@query(_TYPED)
def codec_values(spark, d):
    """Rows through the tagged binary form and back."""
    back = codec.decode_rows(codec.encode_rows(_typed(spark, d)), _SCHEMA)
    return back.select("c_custkey", "c_name", "c_acctbal", "third", F.col("pair")[0].alias("first"), "segment")


@query(_TYPED)
def codec_stream(spark, d):
    """The same, framed, many frames to a stream: each task's are strung together first."""
    one = codec.encode_rows(_typed(spark, d), framed=True)
    streams = one.groupBy(F.spark_partition_id()).agg(F.unhex(F.array_join(F.collect_list(F.hex("payload")), "")).alias("payload"))
    back = codec.decode_rows(streams, _SCHEMA, framed=True)
    return back.select("c_custkey", "c_name", "c_acctbal", "third", F.col("pair")[0].alias("first"), "segment")


@query("""SELECT c_custkey, '0801016103' || CASE WHEN z < 128 THEN printf('%02X', z) WHEN z < 16384 THEN printf('%02X%02X', z % 128 + 128, z // 128)
  ELSE printf('%02X%02X%02X', z % 128 + 128, z // 128 % 128 + 128, z // 16384) END AS bytes FROM (SELECT c_custkey, 2 * c_custkey AS z FROM customer)""")
def codec_bytes(spark, d):
    """The bytes of an object with one int, tag by tag."""
    raw = codec.encode_rows(_t(spark, d, "customer").select(F.col("c_custkey").alias("a")))
    return raw.mapInArrow(_decoded, "payload binary, a long").select(F.col("a").alias("c_custkey"), F.hex("payload").alias("bytes"))


def _decoded(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode_value(x)["a"] for x in b.column(0).to_pylist()], pa.int64())], ["payload", "a"])


@query(f"""WITH {EVENTS}, {_blocks_sql('ev', 16)} SELECT series_id, CAST(seg AS BIGINT) AS seg, part, (row_number() OVER (PARTITION BY series_id, seg, part ORDER BY append_seq)) - 1 AS pos, ts_ms, value FROM r""")
def block_codec(spark, d):
    """Every block through its compact form and back, sample by sample."""
    return codec.decode_blocks(codec.encode_blocks(series.with_blocks(samples(spark, d), 16)))


# -- stored series and rasters ---------------------------------------------------------------------------------------------
@query(f"WITH {EVENTS} SELECT * FROM ev")
def series_stored(spark, d):
    """Appended in two parts, read back in order."""
    s = samples(spark, d)
    at = f"{shared.fresh_folder(spark, 'series')}/t"
    half = s.agg(F.max("append_seq")).first()[0] // 2
    series.append(s.filter(F.col("append_seq") <= half), at)
    series.append(s.filter(F.col("append_seq") > half), at)
    return series.items(spark.read.parquet(at)).select("series_id", "append_seq", "ts_ms", "value")


STACK = raster.Grid(0, 0, 16, 16, 16, 16, 1, ("heat",), tile_size=6, chunk_size=4)
DAILY = FRAMES + ", daily AS (SELECT ts_ms, row, col, value, ts_ms // 86400000 AS append_seq FROM frames)"


def _daily(spark, d):
    return frames(spark, d).withColumn("append_seq", F.expr("ts_ms div 86400000"))


def _stack(spark, d):
    at = f"{shared.fresh_folder(spark, 'stack')}/s"
    raster.create_stack(spark, at, STACK)
    f = _daily(spark, d)
    raster.append_frames(at, f.filter("ts_ms < 1704844800000"), STACK)
    raster.append_frames(at, f.filter("ts_ms >= 1704844800000"), STACK)
    return raster.open_stack(spark, at)


@query(f"WITH {FRAMES} {_FRAME.format(w='ts_ms BETWEEN 1704412800000 AND 1705276800000')}")
def stack_stored(spark, d):
    """Frames appended to a stack on disk, opened again."""
    grid, rows = _stack(spark, d)
    return raster.read_frames(rows, grid, 1704412800000, 1705276800000)


@query("SELECT 0::DOUBLE AS min_x, 16::DOUBLE AS max_y, 16 AS rows, 16 AS cols, 1 AS channels, 6 AS tile_size, 4 AS chunk_size, 0 AS heat, -1 AS cold")
def stack_accessors(spark, d):
    g, _ = _stack(spark, d)
    row = (float(g.min_x), float(g.max_y), g.rows, g.cols, g.channels, g.tile_size, g.chunk_size, g.channel_index("heat"), g.channel_index("cold"))
    return spark.createDataFrame([row], "min_x double, max_y double, rows int, cols int, channels int, tile_size int, chunk_size int, heat int, cold int")


@query("SELECT CAST(r AS INTEGER) AS tile_r, CAST(c AS INTEGER) AS tile_c, CAST(least(6, 16 - 6 * r) AS INTEGER) AS rows, CAST(least(6, 16 - 6 * c) AS INTEGER) AS cols FROM range(3) a(r), range(3) b(c)")
def tile_extents(spark, d):
    n, m = STACK.tile_dims()
    return spark.createDataFrame([(r, c, *STACK.tile_extent(r, c)) for r in range(n) for c in range(m)], "tile_r int, tile_c int, rows int, cols int")


@query(f"""WITH {DAILY}, n AS (SELECT row // 6 AS tile_r, col // 6 AS tile_c, count(DISTINCT ts_ms) AS n FROM daily GROUP BY ALL)
  SELECT tile_r, tile_c, n // 4 AS chunks, n % 4 AS active FROM n""")
def tile_chunk_counts(spark, d):
    return raster.chunk_counts(_daily(spark, d), STACK)


@query(f"WITH {DAILY} SELECT ts_ms, row, col, 0 AS channel, value FROM daily WHERE value <> 0")
def tile_codec(spark, d):
    """Every chunk of every tile through its compact form and back; cells that are 0 left out."""
    chunks = codec.encode_tiles(raster.with_chunks(_daily(spark, d), STACK))
    return codec.decode_tiles(chunks).filter("value <> 0")


TWO = raster.Grid(-180, -90, 180, 90, 18, 36, 2, ("u", "v"))
_AT = "CAST(least(floor((90 - lat) / 180 * 18), 17) AS INTEGER) * 36 + CAST(least(floor((lon + 180) / 360 * 36), 35) AS INTEGER)"


def _flat(grid: raster.Grid):
    return F.transform(F.sequence(F.lit(0), F.lit(grid.rows * grid.cols * grid.channels - 1)), lambda i: i * 0.5)


@query(f"WITH {PLACES} SELECT doc_id, CAST({_AT} AS DOUBLE) AS u, {_AT} + 0.5::DOUBLE AS v FROM places")
def mesh_vector_at(spark, d):
    p = places(spark, d).withColumn("data", _flat(TWO).cast("array<double>")).withColumn("x", raster.vector_at(F.col("data"), TWO, F.col("lon"), F.col("lat")))
    return p.select("doc_id", F.col("x")[0].alias("u"), F.col("x")[1].alias("v"))


@query("SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CAST(k AS INTEGER) AS channel, CASE WHEN r = 1 AND c = 2 AND k = 1 THEN 7.5 ELSE 0.25 END::DOUBLE AS value FROM range(4) a(r), range(5) b(c), range(2) e(k)")
def mesh_set_cell(spark, d):
    g = raster.Grid(0, 0, 5, 4, 4, 5, 2, ("u", "v"))
    return raster.set_cell(raster.mesh(spark, g, 0.25), 1, 2, g.channel_index("v"), 7.5).select("row", "col", "channel", "value")


@query("SELECT CAST(i AS INTEGER) AS pos, i * 0.5::DOUBLE AS value, 18 AS rows, 10368 AS bytes FROM range(1296) t(i)")
def mesh_document(spark, d):
    """A mesh as a document's value and back."""
    doc = spark.range(1).select(raster.to_document(_flat(TWO).cast("array<double>"), TWO).alias("doc"))
    return doc.select(F.posexplode(raster.read_document(F.col("doc"))).alias("pos", "value"), F.col("doc.rows").cast("int").alias("rows"), F.octet_length("doc.data").alias("bytes"))


@query(f"WITH {ZONES} SELECT zone, round(pow(greatest(cx - h - 10, 0, 10 - cx - h), 2) + pow(greatest(cy - h - 45, 0, 45 - cy - h), 2), 6) AS d FROM zones")
def bbox_min_dist_sq(spark, d):
    return zones(spark, d).select("zone", F.round(geo.box_distance_sq(10, 45, F.col("box")), 6).alias("d"))


# -- vectors and matrices --------------------------------------------------------------------------------------------------
def _elements(df: DataFrame, vec, digits: int = 9) -> DataFrame:
    return df.select("vec_id", F.posexplode(vec).alias("pos", "v")).select("vec_id", "pos", F.round("v", digits).alias("v"))


def _each(expression: str, src: str = _PAIRS) -> str:
    return f"SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round({expression}, 9) AS v FROM {src}, range(1, 65) t(i)"


@query(_each("a[i] + b[i]"))
def vec_add_elements(spark, d):
    return _elements(_pairs(spark, d), linalg.add(F.col("a"), F.col("b")))


@query(_each("a[i] - b[i]"))
def vec_sub(spark, d):
    return _elements(_pairs(spark, d), linalg.sub(F.col("a"), F.col("b")))


@query(_each("a[i] * b[i]"))
def vec_hadamard(spark, d):
    return _elements(_pairs(spark, d), linalg.hadamard(F.col("a"), F.col("b")))


_ONE = f"(SELECT vec_id, {_V} AS a, sqrt(list_dot_product({_V}, {_V})) AS n FROM embeddings)"


@query(_each("a[i] * -2.5", _ONE))
def vec_scale(spark, d):
    return _elements(_vectors(spark, d), linalg.scale(F.col("a"), -2.5))


@query(_each("a[i] / n", _ONE))
def vec_normalize_elements(spark, d):
    return _elements(_vectors(spark, d), linalg.normalize(F.col("a")))


@query("SELECT CAST(i AS INTEGER) AS pos, 0.0::DOUBLE AS zero, 1.0::DOUBLE AS one FROM range(5) t(i)")
def vec_zeros_ones(spark, d):
    z = spark.range(1).select(F.arrays_zip(linalg.zeros(5).alias("zero"), linalg.ones(5).alias("one")).alias("z"))
    return z.select(F.posexplode("z").alias("pos", "z")).select("pos", F.col("z")["zero"].alias("zero"), F.col("z")["one"].alias("one"))


@query("SELECT r AS i, c AS j, 0.0::DOUBLE AS zero, 1.0::DOUBLE AS one, 2.5::DOUBLE AS filled, CASE WHEN r = c THEN 1.0 ELSE 0.0 END::DOUBLE AS eye FROM range(4) a(r), range(4) b(c)")
def mat_filled(spark, d):
    named = lambda m, n: m.withColumnRenamed("v", n)
    out = named(matrix.filled(spark, 4, 4), "zero")
    for m, n in ((matrix.filled(spark, 4, 4, 1.0), "one"), (matrix.filled(spark, 4, 4, 2.5), "filled"), (matrix.identity(spark, 4), "eye")):
        out = out.join(named(m, n), ["i", "j"])
    return out


@query(f"SELECT i, j, round({_V}[i * 16 + j + 1], 9) AS v FROM embeddings, range(4) a(i), range(16) b(j) WHERE vec_id = 3")
def mat_from_flat(spark, d):
    m = matrix.from_flat(_t(spark, d, "embeddings").filter("vec_id = 3"), "embedding", 4, 16)
    return m.select("i", "j", F.round("v", 9).alias("v"))


@query(f"SELECT (SELECT max(vec_id) + 1 FROM embeddings) AS n, CAST(64 AS BIGINT) AS m, (SELECT round({_V}[6], 9) FROM embeddings WHERE vec_id = 2) AS at, -1.5::DOUBLE AS set_")
def mat_access(spark, d):
    m = _matrix(spark, d)
    n, k = matrix.shape(m)
    at = matrix.get(m, 2, 5).first().v
    changed = matrix.get(matrix.set_cell(m, 2, 5, -1.5), 2, 5)
    return changed.select(F.lit(n).cast("long").alias("n"), F.lit(k).cast("long").alias("m"), F.round(F.lit(at), 9).alias("at"), F.col("v").alias("set_"))


@query("SELECT i, '[' || CAST(i AS VARCHAR) || '.0, ' || CAST(i + 1 AS VARCHAR) || '.0, ' || CAST(i + 2 AS VARCHAR) || '.0]' AS text FROM range(3) t(i)")
def mat_text(spark, d):
    return matrix.to_text(spark.range(3).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j")).select("i", F.col("j").cast("long").alias("j"), (F.col("i") + F.col("j")).cast("double").alias("v")))


@query(f"SELECT vec_id, CAST(j - 1 AS INTEGER) AS pos, round({_V}[j], 9) AS v FROM embeddings, range(1, 65) t(j)")
def mat_value(spark, d):
    """A matrix as a document's value: one array a row."""
    rows = matrix.to_rows(_matrix(spark, d))
    return _elements(rows.withColumnRenamed("i", "vec_id"), F.col("values"))


_JSON = ["[1, 2.5, -3]", "[]", '[1, "7"]', "[[1, 2], [3, 4.5]]", "[[1], [2, 3]]", '"x"', "null", "[null]", '{"a": 1}']


@query("""SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS k, unnest([3, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL]) AS vec_len, unnest([0.5, 0.0, NULL, NULL, NULL, NULL, NULL, NULL, NULL])::DOUBLE AS vec_sum,
  unnest([NULL, 0, NULL, 2, NULL, NULL, NULL, NULL, NULL]) AS rows, unnest([NULL, NULL, NULL, 4.5, NULL, NULL, NULL, NULL, NULL])::DOUBLE AS last""")
def read_numbers(spark, d):
    """Vectors and matrices in VARIANT values; what is none gives null."""
    df = spark.createDataFrame(list(enumerate(_JSON)), "k int, j string").withColumn("x", F.parse_json("j"))
    vec, m = linalg.read_vector(F.col("x")), linalg.read_matrix(F.col("x"))
    df = df.select("k", vec.alias("vec"), m.alias("m"))
    has = lambda c, e: F.when(F.col(c).isNotNull(), e)
    return df.select("k", has("vec", F.size("vec")).alias("vec_len"), has("vec", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)).alias("vec_sum"), has("m", F.size("m")).alias("rows"), F.try_element_at(F.try_element_at("m", F.lit(-1)), F.lit(-1)).alias("last"))


# -- replication and clocks ------------------------------------------------------------------------------------------------
@query("SELECT unnest(['a', 'b', 'c']) AS peer, unnest([40, 900, 0]) AS cursor")
def peer_cursors(spark, d):
    """Cursors that were set, stored and loaded; 0 for a peer that has none."""
    at = f"{shared.fresh_folder(spark, 'cursors')}/peers.json"
    c = replication.load_cursors(spark, at)
    for peer, seq in (("a", 10), ("b", 900), ("a", 40)):
        c = replication.set_cursor(c, peer, seq)
    replication.save_cursors(c, at)
    c = replication.load_cursors(spark, at)
    return spark.createDataFrame([(p, replication.get_cursor(c, p)) for p in "abc"], "peer string, cursor int")


@query("""WITH o AS (SELECT seq, hlc, hlc.wall IS NOT NULL AS has, lead(hlc) OVER (ORDER BY seq) AS other FROM repl_changes), m AS (SELECT seq, CASE WHEN hlc IS NULL THEN other WHEN other IS NULL THEN hlc
  WHEN (other.wall, other.counter, other.node) > (hlc.wall, hlc.counter, hlc.node) THEN other ELSE hlc END AS h FROM o) SELECT seq, h.wall AS wall, h.counter AS counter, h.node AS node FROM m""")
def hlc_merge(spark, d):
    """The greater clock of each change and the one that arrived after it."""
    r = _t(spark, d, "repl_changes").select("seq", "hlc")
    both = r.join(r.select((F.col("seq") - 1).alias("seq"), F.col("hlc").alias("other")), "seq", "left")
    m = both.select("seq", replication.merge_clocks(F.col("hlc"), F.col("other")).alias("h"))
    return m.select("seq", "h.wall", "h.counter", "h.node")


# -- subscriptions -----------------------------------------------------------------------------------------------------------
_WHOLE = LOG + """, f AS (SELECT *, CASE WHEN op = 'put' THEN props END AS new FROM log), g AS (SELECT *, lag(new) OVER (PARTITION BY collection, doc_id ORDER BY seq) AS old FROM f),
  h AS (SELECT * FROM g WHERE old IS DISTINCT FROM new)"""
_KIND = "CASE WHEN old IS NULL THEN 'set' WHEN new IS NULL THEN 'delete' WHEN starts_with(new, old) THEN 'append' ELSE 'replace' END"


@query(f"WITH {_WHOLE} SELECT collection, doc_id, seq, old, new FROM h")
def field_changes_whole(spark, d):
    return subscriptions.field_changes(log(spark, d), "props").select("collection", "doc_id", "seq", "old", "new")


@query(f"WITH {_WHOLE} SELECT collection, doc_id, seq, old, new, {_KIND} AS kind FROM h")
def field_deltas_whole(spark, d):
    return subscriptions.field_deltas(log(spark, d), "props").select("collection", "doc_id", "seq", "old", "new", "kind")


def _stream(spark, d, events) -> DataFrame:
    root = shared.fresh_folder(spark, "stream")
    log(spark, d).withColumns({"version": F.lit(0).cast("long"), "doc_id": F.col("doc_id").cast("string")}).write.parquet(f"{root}/log")
    stream = spark.readStream.schema(spark.read.parquet(f"{root}/log").schema).parquet(f"{root}/log")
    q = subscriptions.deliver(events(stream), lambda b, n: b.write.mode("overwrite").parquet(f"{root}/out/batch={n}"), f"{root}/state", availableNow=True)
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").withColumn("doc_id", F.col("doc_id").cast("long"))


@query(f"WITH {_WHOLE} SELECT collection, doc_id, seq, old, new, {_KIND} AS kind FROM h")
def field_deltas_whole_streamed(spark, d):
    return _stream(spark, d, lambda s: subscriptions.stream_deltas(s, "props")).select("collection", "doc_id", "seq", "old", "new", "kind")


@query(f"""WITH {LOG}, f AS (SELECT *, CASE WHEN op = 'put' THEN value END AS new FROM log), g AS (SELECT *, lag(new) OVER (PARTITION BY collection, doc_id ORDER BY seq) AS old FROM f)
  SELECT collection, doc_id, seq, old, new FROM g WHERE old IS DISTINCT FROM new""")
def field_changes_streamed(spark, d):
    """Of a number, from a stream of the log."""
    return _stream(spark, d, lambda s: subscriptions.stream_changes(s, "value")).select("collection", "doc_id", "seq", "old", "new")


@query("SELECT unnest([1, 2, 3, 1]) AS version, unnest(['put', 'put', 'delete', 'put']) AS op, unnest([1, 2, NULL, 4]) AS n")
def db_subscribed(spark, d):
    """A document's events with their versions, pushed in two runs from one checkpoint."""
    db, got = Database(spark, shared.fresh_folder(spark, "push")), []
    take = lambda: db.subscribe("t", "a", lambda b, n: got.extend((r.version, r.op, r.n) for r in b.collect()), f"{db.root}/push", availableNow=True).awaitTermination()
    db.put("t", "a", n=1)
    db.put("t", "b", n=9)
    db.put("t", "a", n=2)
    take()
    db.delete("t", "a")
    db.delete("t", "a")  # no event: the document is absent
    db.put("t", "a", n=4)
    take()
    return spark.createDataFrame(got, "version int, op string, n int")


@query("SELECT unnest([1, 3, 4]) AS version, unnest([NULL, 1, 5]) AS old, unnest([1, 5, NULL]) AS new, unnest(['set', 'replace', 'delete']) AS kind")
def db_subscribed_field(spark, d):
    db, got = Database(spark, shared.fresh_folder(spark, "push")), []
    db.put("t", "a", n=1)
    db.put("t", "a", n=1, s="x")
    db.put("t", "a", n=5)
    db.delete("t", "a")
    db.subscribe_field("t", "a", "n", lambda b, n: got.extend((r.version, r.old, r.new, r.kind) for r in b.collect()), f"{db.root}/push", deltas=True, availableNow=True).awaitTermination()
    return spark.createDataFrame(got, "version int, old int, new int, kind string")


# -- schema builders ---------------------------------------------------------------------------------------------------------
_JV = "FROM repl_changes WHERE value IS NOT NULL AND json_valid(value)"


def _values(spark, d):
    return _t(spark, d, "repl_changes").withColumn("body", F.try_parse_json("value")).filter("body is not null")


@query(f"""SELECT seq, CASE WHEN json_type(value, '$.age') IS NULL THEN 'missing' ELSE lower(json_type(value, '$.age')) END AS actual {_JV} AND coalesce(json_type(value, '$.age') <> 'UBIGINT', true)""")
def validate_variant_issues(spark, d):
    """The issues of every value that has no int ``age``."""
    got = v.obj(age=v.integer().gte(0)).parse(_values(spark, d), "body", "v", variant=True)
    return got.select("seq", F.explode("issues").alias("i")).select("seq", "i.actual")


_LON = "json_type(value, '$.lon') IN ('DOUBLE', 'UBIGINT', 'BIGINT')"


@query(f"SELECT seq, round(CAST(json_extract(value, '$.lon') AS DOUBLE), 6) AS lon {_JV} AND {_LON} AND abs(CAST(json_extract(value, '$.lon') AS DOUBLE)) < 90")
def validate_number_refined(spark, d):
    """A float, ints being taken as one, that a condition holds for."""
    s = v.obj(lon=v.number().refine(lambda x: F.abs(x) < 90))
    return s.parse(_values(spark, d), "body", "v", variant=True).filter("ok").select("seq", F.round("v.lon", 6).alias("lon"))


@query(f"SELECT seq, CASE WHEN json_type(value, '$.age') = 'UBIGINT' THEN CAST(json_extract(value, '$.age') AS BIGINT) ELSE -1 END AS age {_JV} AND coalesce(json_type(value, '$.age') = 'UBIGINT', true)")
def validate_default(spark, d):
    return v.obj(age=v.integer().default(-1)).parse(_values(spark, d), "body", "v", variant=True).filter("ok").select("seq", "v.age")


@query("SELECT doc_id, lang IS NULL AS none, lang FROM documents WHERE lang IS NULL OR octet_length(encode(lang)) <= 2")
def validate_nullable_max_len(spark, d):
    got = v.row({"lang": v.string().max_len(2).nullable()}).parse(_t(spark, d, "documents"), F.lit(None), "v").filter("ok")
    return got.select("doc_id", F.col("v.lang").isNull().alias("none"), "v.lang")


@query("SELECT doc_id, 'page' AS described, 'at most 2 bytes' AS expected FROM documents WHERE octet_length(encode(lang)) > 2")
def validate_described(spark, d):
    s = v.row({"lang": v.string().max_len(2).nullable()}).describe("page")
    got = s.parse(_t(spark, d, "documents"), F.lit(None), "v").select("doc_id", F.explode("issues").alias("i"))
    return got.select("doc_id", F.lit(s.described).alias("described"), "i.expected")


@query(f"""WITH s AS (SELECT seq, CAST(json_extract(value, '$.shape') AS DOUBLE[][]) AS p {_JV} AND json_type(value, '$.shape') = 'ARRAY')
  SELECT seq, CAST(len(p) AS INTEGER) AS n, p[1][1] AS x FROM s WHERE len(list_filter(flatten(p), lambda x: abs(x) > 170)) = 0""")
def validate_array(spark, d):
    """Arrays of arrays of floats, every element checked."""
    s = v.obj(shape=v.array(v.array(v.number().gte(-170).lte(170))))
    got = s.parse(_values(spark, d), "body", "v", variant=True).filter("ok")
    return got.select("seq", F.size("v.shape").alias("n"), F.col("v.shape")[0][0].alias("x"))


@query(f"SELECT seq, CAST(len(json_keys(value)) AS INTEGER) AS n {_JV} AND json_type(value) = 'OBJECT' AND len(list_filter(json_keys(value), lambda k: json_type(value, '$.' || k) NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE'))) = 0")
def validate_record(spark, d):
    """Objects all of whose values are numbers, whatever their names."""
    got = v.record(v.number()).parse(_values(spark, d), "body", "v", variant=True).filter("ok")
    return got.select("seq", F.size("v").alias("n"))


@query("SELECT n_nationkey, n_name FROM nation")
def validate_or_raise(spark, d):
    s = v.row({"n_name": v.string().min_len(3), "n_regionkey": v.integer().gte(0).lte(4)})
    return s.parse_or_raise(_t(spark, d, "nation"), F.lit(None), "v").select("n_nationkey", "v.n_name")


@query("SELECT '$.n_regionkey: too large' AS message")
def validate_raises(spark, d):
    """What a row that doesn't hold raises."""
    s = v.row({"n_regionkey": v.integer().lte(-1)})
    try:
        s.parse_or_raise(_t(spark, d, "nation").limit(1), F.lit(None), "v").select("v").collect()
        text = "nothing was raised"
    except Exception as e:  # the error class differs between releases; what counts is the message
        text = "$.n_regionkey: too large" if "$.n_regionkey: too large" in str(e) else str(e)[:200]
    return spark.createDataFrame([(text,)], "message string")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
