"""A database: a folder with a log of commits, the snapshots its collections are laid over, and named access paths.

    root/manifest/<v>.json                   versions of the manifest: access paths, and each collection's snapshot
    root/commits/<k>.json                    commits, in order: the batches of changes each adds, and their place in the log
    root/data/<id>                           a batch: the documents' columns, doc_id, op, pos
    root/snapshots/<id>/<layout>/rows        the documents by ranges of doc_id ('key') or of an access path's fields
    root/snapshots/<id>/<layout>/zones       of each of its files the least and greatest value of those fields

Any number of writers: a batch is written first and then claims the next number of commit or manifest by creating its
file, which only one of them can; the others look at what has come and claim the next. Readers see whole commits.
Documents have the columns they were put with; columns that came later are null in earlier ones.

A read takes from the snapshot only the files whose zones meet its condition, and lays the log since that snapshot over
them; compaction keeps that log short.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import geo
from ..functions.values import kind_of_literal
from ..operators import access, changelog, spatial
from ..operators.txn import CONFLICT, INVALID, OK, Txn, conflicts
from ..plans.skew import col
from ..streaming import subscriptions
from . import shared

KEY = access.KEY
#: Columns of a stored batch beside the documents' own.
OP, POS, BATCH = "op", "pos", "__batch"
#: The Spark type of each kind of value that ``put`` takes.
KINDS = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}


class Database:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._known: dict[int, dict] = {}

    @classmethod
    def from_env(cls, spark: SparkSession) -> Database:
        """The folder is that of TIDEMARK_DIR."""
        return cls(spark, os.environ["TIDEMARK_DIR"])

    # -- manifest --------------------------------------------------------------------------------------------------------
    def _numbers(self, kind: str) -> list[int]:
        return [int(n[:-5]) for n in shared.names(self.spark, f"{self.root}/{kind}") if n.endswith(".json")]

    def _manifest(self) -> tuple[int, dict]:
        v = max(self._numbers("manifest"), default=-1)
        return v, json.loads(shared.read_text(self.spark, f"{self.root}/manifest/{v:010d}.json")) if v >= 0 else {"collections": {}, "paths": {}}

    @property
    def manifest(self) -> dict:
        return self._manifest()[1]

    def _change(self, f: Callable[[dict], None]) -> None:
        """Write the next version of the manifest: ``f`` of the newest, again if another writer was faster."""
        while True:
            v, m = self._manifest()
            before = json.dumps(m, sort_keys=True)
            f(m)
            text = json.dumps(m, sort_keys=True)
            if text == before or shared.create_text(self.spark, f"{self.root}/manifest/{v + 1:010d}.json", text):
                return

    def collections(self) -> list[str]:
        return sorted(self.manifest["collections"])

    def ensure_collection(self, name: str) -> None:
        self._change(lambda m: m["collections"].setdefault(name, {"snapshot": None, "upto": -1}))

    # -- log -------------------------------------------------------------------------------------------------------------
    def _commits(self) -> dict[int, dict]:
        """The commits by number; each is read once."""
        for k in self._numbers("commits"):
            if k not in self._known:
                self._known[k] = json.loads(shared.read_text(self.spark, f"{self.root}/commits/{k:010d}.json"))
        return dict(sorted(self._known.items()))

    def _parts(self, name: str, after: int, upto: int | None = None) -> list[dict]:
        return [p for k, c in self._commits().items() if k > after and (upto is None or k <= upto) for p in c["parts"] if p["collection"] == name]

    def _rows(self, parts: list[dict], tolerant: bool = False) -> DataFrame | None:
        """The change rows of batches, with ``seq``, their place in the log; null for none."""
        if not parts:
            return None
        rows = changelog.read(self.spark, [f"{self.root}/data/{p['id']}" for p in parts], tolerant)
        base = ", ".join(f"('{p['id']}', {p['base']}L)" for p in parts)
        rows = rows.join(F.broadcast(self.spark.sql(f"SELECT * FROM VALUES {base} AS t({BATCH}, __base)")), BATCH)  # a row a batch
        return rows.withColumn("seq", col("__base") + col(POS)).drop(BATCH, "__base", POS)

    def log(self, name: str, tolerant: bool = False) -> DataFrame | None:
        """The change rows since the last compaction; null if there are none. ``tolerant`` leaves out files that are torn."""
        m = self.manifest["collections"]
        return self._rows(self._parts(name, m[name]["upto"]), tolerant) if name in m else None

    def log_stats(self) -> DataFrame:
        """(collection, batches, changes, bytes) of the log since each collection's last compaction."""
        out = []
        for name, entry in self.manifest["collections"].items():
            parts = self._parts(name, entry["upto"])
            out.append((name, len(parts), sum(p["rows"] for p in parts), sum(shared.size(self.spark, f"{self.root}/data/{p['id']}") for p in parts)))
        return self.spark.createDataFrame(out, "collection string, batches int, changes long, bytes long")

    def _write(self, name: str, rows: DataFrame, op: str | None, order: str | None = None) -> dict:
        """Store a batch, not yet part of the log. ``op`` null: the rows have it."""
        at = uuid.uuid4().hex
        rows = rows.orderBy(col(order)) if order else rows
        rows = rows if op is None else rows.withColumn(OP, F.lit(op))
        # Partition number and place within it: growing with the order, unique, with gaps.
        rows.withColumns({POS: F.monotonically_increasing_id(), BATCH: F.lit(at)}).write.parquet(f"{self.root}/data/{at}")
        n, last = self.spark.read.schema(f"{POS} long").parquet(f"{self.root}/data/{at}").agg(F.count(POS), F.max(POS)).first()
        return {"collection": name, "id": at, "rows": n, "span": (last or 0) + 1}

    def _append(self, parts: list[dict], check: Callable[[int], bool] | None = None) -> int | None:
        """Make batches part of the log as one commit; returns its number. ``check`` is asked with the number of the last
        commit there is; if it refuses, nothing is appended. If another writer comes first, it is asked again."""
        while True:
            done = self._commits()
            k = max(done, default=-1)
            if check is not None and not check(k):
                return None
            base = done[k]["next"] if done else 1
            placed = []
            for p in parts:
                placed.append(p | {"base": base})
                base += p["span"]
            if shared.create_text(self.spark, f"{self.root}/commits/{k + 1:010d}.json", json.dumps({"parts": placed, "next": base})):
                return k + 1

    def put_many(self, name: str, docs: DataFrame, order: str | None = None) -> None:
        """``docs`` has doc_id; of documents with one id the last in ``order`` wins."""
        self.ensure_collection(name)
        self._append([self._write(name, docs, "put", order)])

    def put(self, name: str, doc_id: str, /, **fields: object) -> None:
        given = {k: v for k, v in fields.items() if v is not None}
        schema = T.StructType([T.StructField(KEY, T.StringType()), *[T.StructField(k, KINDS[type(v)]) for k, v in given.items()]])
        self.put_many(name, self.spark.createDataFrame([(doc_id, *given.values())], schema).coalesce(1))

    def delete_many(self, name: str, ids: DataFrame) -> None:
        self.ensure_collection(name)
        self._append([self._write(name, ids.select(KEY), "delete")])

    def delete(self, name: str, doc_id: str) -> None:
        self.delete_many(name, self.spark.createDataFrame([(doc_id,)], f"{KEY} string"))

    # -- transactions ----------------------------------------------------------------------------------------------------
    def _state(self, keys: Sequence[tuple[str, str]], upto: int) -> DataFrame:
        """(collection, doc_id, version) of those documents that live at a commit."""
        out = self.spark.createDataFrame([], "collection string, doc_id string, version long")
        for name in sorted({c for c, _ in keys}):
            out = out.unionByName(self.versions(name, upto, [d for c, d in keys if c == name]).select(F.lit(name).alias("collection"), KEY, "version"))
        return out

    def begin(self, cap: int = 0) -> Txn:
        return Txn(self.spark, cap)

    def read(self, txn: Txn, name: str, doc_id: str) -> DataFrame:
        """The document, its version recorded by the transaction if it lives."""
        txn.read(self._state([(name, doc_id)], max(self._commits(), default=-1)), name, doc_id)
        return self.get(name, doc_id)

    def commit(self, txn: Txn) -> str:
        """'ok', 'conflict' or 'invalid'. The check of what was read and the append are one step: the commit's number is
        claimed right after the state before it was checked, and both are done again if another writer took it. Writes
        to several collections appear together. Values written must be dicts of a document's columns."""
        if not txn.active or 0 < txn.cap < len(txn.writes):
            return INVALID
        parts = []
        for name in sorted({c for c, _ in txn.writes}):
            self.ensure_collection(name)
            rows = [(d, op, json.loads(v) if v else {}) for (c, d), (op, v) in txn.writes.items() if c == name]
            fields = {f: KINDS[type(x)] for _, _, v in rows for f, x in v.items() if x is not None}
            schema = T.StructType([T.StructField(KEY, T.StringType()), T.StructField(OP, T.StringType()), *[T.StructField(f, t) for f, t in fields.items()]])
            parts.append(self._write(name, self.spark.createDataFrame([(d, op, *[v.get(f) for f in fields]) for d, op, v in rows], schema).coalesce(1), None))

        def unchanged(k: int) -> bool:
            return not txn.reads or not conflicts(txn.read_set(), self._state(list(txn.reads), k)).limit(1).count()

        if self._append(parts, unchanged) is None:
            for p in parts:
                shared.remove(self.spark, f"{self.root}/data/{p['id']}")
            return CONFLICT
        txn.active = False
        return OK

    # -- snapshots -------------------------------------------------------------------------------------------------------
    def _layouts(self, name: str) -> dict[str, list[tuple[str, Column]]]:
        """Of each layout the columns whose least and greatest values its zones keep, the ones it is ordered by first."""
        out = {"key": [(KEY, col(KEY))]}
        for k, spec in self.manifest["paths"].items():
            kind, c, path = k.split("/", 2)
            if c != name:
                continue
            if kind == "equal":
                out[f"{kind}-{path}"] = [(f"f{i}", F.col(f)) for i, f in enumerate(spec)]
            elif kind == "geo":
                x, y = (col(f).cast("double") for f in spec)
                out[f"{kind}-{path}"] = [("z", geo.morton(x, y)), ("x", x), ("y", y)]
            else:
                b = geo.polygon_box(geo.read_polygon(F.col(spec[0])))
                out[f"{kind}-{path}"] = [("z", geo.morton((b["min_x"] + b["max_x"]) / 2, (b["min_y"] + b["max_y"]) / 2)), *[(c, b[c]) for c in ("min_x", "min_y", "max_x", "max_y")]]
        return out

    def _lay_out(self, docs: DataFrame, at: str, zones: list[tuple[str, Column]], files: int | None) -> None:
        """Store documents by ranges of the zones' first column (of all, for an index of several fields), with the zones."""
        order = [c for n, c in zones if n not in ("x", "y", "min_x", "min_y", "max_x", "max_y")]
        ranged = docs.repartitionByRange(files, *order) if files else docs.repartitionByRange(*order)
        ranged.sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{at}/rows")
        stored = self.spark.read.parquet(f"{at}/rows")
        ends = [f(c).alias(f"{n}_{m}") for n, c in zones for f, m in ((F.min, "least"), (F.max, "most"))]
        gaps = [F.max(c.isNull()).alias(f"{n}_gap") for n, c in zones]
        stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), *ends, *gaps).coalesce(1).write.mode("overwrite").parquet(f"{at}/zones")

    def compact(self, name: str | None = None, files: int | None = None, vacuum: bool = True) -> None:
        """Write the state as a new snapshot, laid out by key and for each access path; the log it holds isn't read any
        more. ``files`` of each layout, by default as many as the session's shuffle partitions give."""
        for c in [name] if name else self.collections():
            entry, upto = self.manifest["collections"][c], max(self._commits(), default=-1)
            docs, made = self._at(c, entry, upto), uuid.uuid4().hex
            at = f"{self.root}/snapshots/{made}"
            self._lay_out(docs, f"{at}/key", self._layouts(c)["key"], files)
            stored = self.spark.read.parquet(f"{at}/key/rows")
            for layout, zones in self._layouts(c).items():
                if layout != "key":
                    self._lay_out(stored, f"{at}/{layout}", zones, files)

            def swap(m: dict, c=c, entry=entry, made=made, upto=upto) -> None:
                if m["collections"][c] == entry:  # else another compaction was faster
                    m["collections"][c] = {"snapshot": made, "upto": upto}

            self._change(swap)
        if vacuum:
            self.vacuum()

    def vacuum(self) -> None:
        """Remove snapshots that the manifest doesn't name and batches that all snapshots hold; nobody may be reading them."""
        entries = self.manifest["collections"]
        for s in set(shared.names(self.spark, f"{self.root}/snapshots")) - {e["snapshot"] for e in entries.values()}:
            shared.remove(self.spark, f"{self.root}/snapshots/{s}")
        for k, c in self._commits().items():
            for p in c["parts"]:
                if k <= entries[p["collection"]]["upto"]:
                    shared.remove(self.spark, f"{self.root}/data/{p['id']}")

    def close(self) -> None:
        """Nothing is held open: what was written is there for the next ``Database`` of this folder."""
        self._known.clear()

    def _snapshot(self, entry: dict, layout: str = "key", where: Column | None = None) -> DataFrame | None:
        """The rows of those files of a snapshot whose zones meet ``where``; null without a snapshot, or without that layout."""
        at = f"{self.root}/snapshots/{entry['snapshot']}/{layout}"
        if entry["snapshot"] is None or not shared.exists(self.spark, f"{at}/zones"):
            return None
        if where is None:
            return self.spark.read.parquet(f"{at}/rows")
        files = [r.file for r in self.spark.read.parquet(f"{at}/zones").filter(where).select("file").collect()]
        rows = self.spark.read.parquet(*files) if files else self.spark.read.parquet(f"{at}/rows").limit(0)
        return rows

    def _laid_over(self, snapshot: DataFrame | None, log: DataFrame | None) -> DataFrame:
        empty = self.spark.createDataFrame([], f"{KEY} string")
        if log is None:
            return empty if snapshot is None else snapshot
        live = changelog.current(log, [KEY]).drop(OP, "seq")
        if snapshot is None:
            return live
        kept = snapshot.join(log.select(KEY).distinct(), KEY, "left_anti")
        return kept.unionByName(live, allowMissingColumns=True)

    def _at(self, name: str, entry: dict, upto: int | None = None) -> DataFrame:
        return self._laid_over(self._snapshot(entry), self._rows(self._parts(name, entry["upto"], upto)))

    def _entry(self, name: str) -> dict:
        return self.manifest["collections"].get(name, {"snapshot": None, "upto": -1})

    # -- reads -----------------------------------------------------------------------------------------------------------
    def all(self, name: str) -> DataFrame:
        """The live documents; an empty DataFrame with doc_id for an unknown collection."""
        return self._at(name, self._entry(name))

    def versions(self, name: str, upto: int | None = None, ids: list[str] | None = None) -> DataFrame:
        """(doc_id, version) of the live documents, of those of a list where one is given. Versions count from the last
        compaction, at which a document has version 0; ``upto`` is the last commit that counts."""
        entry = self._entry(name)
        log = self._rows(self._parts(name, entry["upto"], upto))
        stored = self._snapshot(entry)
        out = self.spark.createDataFrame([], f"{KEY} string, version long") if stored is None else stored.select(KEY, F.lit(0).cast("long").alias("version"))
        if log is not None:
            rows = log.select(KEY, OP, "seq")
            mine = rows if ids is None else rows.filter(col(KEY).isin(ids))
            live = changelog.current(changelog.with_versions(mine, [KEY]), [KEY]).select(KEY, "version")
            out = out.join(rows.select(KEY).distinct(), KEY, "left_anti").unionByName(live)
        return out if ids is None else out.filter(col(KEY).isin(ids))

    def current_version(self, name: str, doc_id: str) -> DataFrame:
        """One row (version): 0 if the document is absent or hasn't changed since the last compaction."""
        return access.current_version(self.versions(name, ids=[doc_id]), doc_id)

    def get(self, name: str, doc_id: str) -> DataFrame:
        return access.get(self._lookup(name, [doc_id]), doc_id)

    def get_many(self, name: str, ids: list[str], position: str | None = None) -> DataFrame:
        return access.get_many(self._lookup(name, ids), ids, position=position)

    def _lookup(self, name: str, ids: list[str]) -> DataFrame:
        """The documents among which those of a list are: of the files that may hold one, and of the log's rows of them."""
        entry, wanted = self._entry(name), sorted(set(ids))
        held = F.exists(F.array(*map(F.lit, wanted)).cast("array<string>"), lambda x: (x >= col(f"{KEY}_least")) & (x <= col(f"{KEY}_most")))
        log = self._rows(self._parts(name, entry["upto"]))
        snapshot = self._snapshot(entry, "key", held)
        only = lambda df: df if df is None else df.filter(col(KEY).isin(wanted))
        return self._laid_over(only(snapshot), only(log))

    def cache(self, name: str) -> DataFrame:
        """The live documents, kept in memory and on disk by the executors until ``unpersist()``."""
        return self.all(name).persist()

    def cache_stats(self) -> DataFrame:
        """(name, partitions, cached, memory_bytes, disk_bytes) of what is kept."""
        got = self.spark.sparkContext._jsc.sc().getRDDStorageInfo()
        rows = [(i.name()[:200], i.numPartitions(), i.numCachedPartitions(), i.memSize(), i.diskSize()) for i in got]
        return self.spark.createDataFrame(rows, "name string, partitions int, cached int, memory_bytes long, disk_bytes long")

    # -- access paths ------------------------------------------------------------------------------------------------------
    def _path(self, kind: str, name: str, path: str) -> list | None:
        return self.manifest["paths"].get(f"{kind}/{name}/{path}")

    def _create(self, kind: str, name: str, path: str, spec: list) -> None:
        """Name an access path and, where there is a snapshot, lay its documents out for it."""
        self._change(lambda m: m["paths"].update({f"{kind}/{name}/{path}": spec}))
        entry, layout = self._entry(name), f"{kind}-{path}"
        stored = self._snapshot(entry)
        if stored is not None:
            self._lay_out(stored, f"{self.root}/snapshots/{entry['snapshot']}/{layout}", self._layouts(name)[layout], None)

    def drop_path(self, kind: str, name: str, path: str) -> None:
        self._change(lambda m: m["paths"].pop(f"{kind}/{name}/{path}", None))
        entry = self._entry(name)
        if entry["snapshot"]:
            shared.remove(self.spark, f"{self.root}/snapshots/{entry['snapshot']}/{kind}-{path}")

    def create_index(self, name: str, path: str, fields: str) -> None:
        """Comma-separated dotted paths; ranges need a single one."""
        self._create("equal", name, path, [f.strip() for f in fields.split(",")])

    def create_geo_index(self, name: str, path: str, lon: str, lat: str) -> None:
        self._create("geo", name, path, [lon, lat])

    def create_polygon_index(self, name: str, path: str, shape: str) -> None:
        self._create("polygon", name, path, [shape])

    def paths(self) -> DataFrame:
        """(kind, collection, name, spec) of the access paths."""
        rows = [(*k.split("/", 2), ",".join(v)) for k, v in self.manifest["paths"].items()]
        return self.spark.createDataFrame(rows, "kind string, collection string, name string, spec string")

    def _none(self, name: str) -> DataFrame:
        return self.all(name).limit(0)

    def _via(self, kind: str, name: str, path: str, where: Column) -> DataFrame:
        """The documents among which those of a condition on a path's zones are."""
        entry = self._entry(name)
        snapshot = self._snapshot(entry, f"{kind}-{path}", where)
        return self._laid_over(self._snapshot(entry) if snapshot is None else snapshot, self._rows(self._parts(name, entry["upto"])))

    def find_by(self, name: str, path: str, *key: object, limit: int = 0) -> DataFrame:
        """Empty for an unknown access path."""
        spec = self._path("equal", name, path)
        if not spec:
            return self._none(name)
        where = F.lit(True)
        for i, v in enumerate(key):
            where = where & (col(f"f{i}_gap") if v is None else F.lit(v).between(col(f"f{i}_least"), col(f"f{i}_most")) if self._fits(name, spec[i], v) else F.lit(True))
        return access.find_by(self._via("equal", name, path, where), dict(zip(spec, key, strict=True)), limit)

    def _fits(self, name: str, field: str, v: object) -> bool:
        """Whether zones of the field can be compared with the value: they have its kind."""
        df = self.all(name)
        return field.split(".")[0] in df.columns and access.kind_of(df, field) == kind_of_literal(v)

    def range_by(self, name: str, path: str, low: object = None, high: object = None, **options) -> DataFrame:
        """Empty for an unknown access path and for one of several fields."""
        spec = self._path("equal", name, path)
        if not spec or len(spec) != 1:
            return self._none(name)
        where = F.lit(True)
        if low is not None and self._fits(name, spec[0], low):
            where = where & (col("f0_most") >= F.lit(low))
        if high is not None and self._fits(name, spec[0], high):
            where = where & (col("f0_least") <= F.lit(high))
        return access.range_by(self._via("equal", name, path, F.coalesce(where, F.lit(False)) | col("f0_gap")), spec[0], low, high, **options)

    def _geo(self, name: str, path: str, f, *args, within: Column | None = None, **options) -> DataFrame:
        """``within``: a box the results lie in, as a condition on the zones."""
        spec = self._path("geo", name, path)
        if not spec:
            return self._none(name)
        docs = self.all(name) if within is None else self._via("geo", name, path, within)
        return f(docs, *args, lon=spec[0], lat=spec[1], **options)

    def _meets(self, b: Column) -> Column:
        """Files with points in the box."""
        return F.coalesce((col("x_least") <= b["max_x"]) & (col("x_most") >= b["min_x"]) & (col("y_least") <= b["max_y"]) & (col("y_most") >= b["min_y"]), F.lit(False))

    def find_in_box(self, name: str, path: str, min_x: float, min_y: float, max_x: float, max_y: float, limit: int = 0) -> DataFrame:
        return self._geo(name, path, spatial.find_in_box, min_x, min_y, max_x, max_y, limit, within=self._meets(geo.box(min_x, min_y, max_x, max_y)))

    def find_nearest(self, name: str, path: str, x: float, y: float, k: int, metric: str = "planar") -> DataFrame:
        """In the plane only files near enough to hold one of the nearest are read: those within the distance that the
        farthest corners of files with k documents in all, besides as many as the log may have taken away, give."""
        return self._geo(name, path, spatial.find_nearest, x, y, k, metric, within=self._near(name, path, x, y, k) if metric == "planar" and k > 0 else None)

    def _near(self, name: str, path: str, x: float, y: float, k: int) -> Column | None:
        entry = self._entry(name)
        at = f"{self.root}/snapshots/{entry['snapshot']}/geo-{path}/zones"
        if entry["snapshot"] is None or not shared.exists(self.spark, at):
            return None
        need = k + sum(p["rows"] for p in self._parts(name, entry["upto"]))
        far = [F.greatest(F.abs(F.lit(float(v)) - col(f"{c}_least")), F.abs(col(f"{c}_most") - v)) for c, v in (("x", x), ("y", y))]
        ends = self.spark.read.parquet(at).filter(~col("x_gap") & ~col("y_gap")).select(F.sqrt(far[0] * far[0] + far[1] * far[1]).alias("d"), "rows").orderBy("d").limit(1 << 16).collect()
        held = 0
        for r in ends:
            held += r.rows
            if held >= need:
                d = r.d * (1 + 1e-9)
                return self._meets(geo.box(x - d, y - d, x + d, y + d))
        return None

    def find_within_radius(self, name: str, path: str, x: float, y: float, meters: float, limit: int = 0, exact: bool = False) -> DataFrame:
        return self._geo(name, path, spatial.find_within_radius, x, y, meters, limit, exact, within=None if exact else self._meets(geo.radius_box(x, y, meters)))

    def find_points_in_polygon(self, name: str, path: str, vertices: list[tuple[float, float]], limit: int = 0) -> DataFrame:
        xs, ys = zip(*vertices) if vertices else ((0.0,), (0.0,))
        return self._geo(name, path, spatial.find_points_in_polygon, vertices, limit, within=self._meets(geo.box(min(xs), min(ys), max(xs), max(ys))))

    def _polygons(self, name: str, path: str, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame | None:
        spec = self._path("polygon", name, path)
        if not spec:
            return None
        where = (col("min_x_least") <= max_x) & (col("max_x_most") >= min_x) & (col("min_y_least") <= max_y) & (col("max_y_most") >= min_y)
        return spatial.with_polygons(self._via("polygon", name, path, F.coalesce(where, F.lit(False))), spec[0])

    def find_polygons_containing(self, name: str, path: str, x: float, y: float, limit: int = 0) -> DataFrame:
        df = self._polygons(name, path, x, y, x, y)
        return self._none(name) if df is None else spatial.find_polygons_containing(df, x, y, limit).drop("polygon", "box")

    def find_polygons_meeting(self, name: str, path: str, min_x: float, min_y: float, max_x: float, max_y: float, limit: int = 0) -> DataFrame:
        df = self._polygons(name, path, min_x, min_y, max_x, max_y)
        return self._none(name) if df is None else spatial.find_polygons_meeting(df, min_x, min_y, max_x, max_y, limit).drop("polygon", "box")

    # -- push ----------------------------------------------------------------------------------------------------------------
    def _push(self, name: str, events: Callable[[DataFrame], DataFrame], handler, checkpoint: str, **trigger) -> StreamingQuery:
        """Hand ``handler(batch, number)`` those ``events`` of the collection's log that new commits bring. ``events`` sees
        the log whole, so versions and former values are right; a batch that comes again after a failure is the same."""
        commits = self.spark.readStream.schema("value string").text(f"{self.root}/commits")

        def each(batch: DataFrame, n: int) -> None:
            parts = [p for r in batch.collect() for p in json.loads(r.value)["parts"] if p["collection"] == name]  # a row a commit
            spans = sorted((p["base"], p["base"] + p["span"]) for p in parts)
            log = self.log(name)
            if log is not None and spans:
                fresh = F.lit(False)
                for a, b in spans:
                    fresh = fresh | ((col("seq") >= a) & (col("seq") < b))
                handler(events(log.withColumn("collection", F.lit(name))).filter(fresh), n)

        return subscriptions.deliver(commits, each, checkpoint, **trigger)

    def subscribe(self, name: str, doc_id: str, handler, checkpoint: str, **trigger) -> StreamingQuery:
        """Hand each batch of the document's events, with their ``version``, to ``handler(batch, number)``; ``stop()`` ends it.
        Deletes of an absent document are no events."""
        return self._push(name, lambda log: changelog.with_versions(log.filter(col(KEY) == F.lit(doc_id))), handler, checkpoint, **trigger)

    def subscribe_field(self, name: str, doc_id: str, field: str, handler, checkpoint: str, deltas: bool = False, **trigger) -> StreamingQuery:
        """As ``subscribe``, only where a column of any type changed: with ``old`` and ``new``, and with ``deltas`` what kind
        of change it was."""
        f = subscriptions.field_deltas if deltas else subscriptions.field_changes
        return self._push(name, lambda log: f(changelog.with_versions(log.filter(col(KEY) == F.lit(doc_id))), field), handler, checkpoint, **trigger)
