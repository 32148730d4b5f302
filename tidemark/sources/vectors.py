"""A table of images with delete vectors: changed in place without rewriting files.

Layout under ``root``:

* ``data/<at>`` the images, appended batch by batch and never rewritten;
* ``index/<at>/bucket=<b>`` for each image its key, its order and its place (file name, row position), in buckets by a hash of
  the key;
* ``dv/<at>`` the bits of all files as the batch left them: for each file, words of 64 positions;
* ``log/<n>.json`` the commit of a batch: its name <at>, and the batches it took the place of. Readers see committed batches
  only; of several writers of one number a single one commits, and a batch that failed is done again under another name.

A batch is reduced to one image a key. The places of the images it supersedes come from those buckets of the index that its
keys lie in, their bits are set, the new images are appended, and reads leave out the positions whose bit is set. An image
that is older than the one stored changes nothing, so repeated and late changes are harmless. Deletes are images too: their
order must be kept to tell later a change that is older than the delete. ``compact`` rewrites batches that are mostly superseded.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.skew import BROADCAST_BYTES, col, fits, row_bytes
from . import shared

#: Positions of a word, and buckets of the index of a table that isn't given another number.
WORD, BUCKETS = 64, 16
FILE, POS, OLD_FILE, OLD_POS, BUCKET = "__file", "__pos", "__old_file", "__old_pos", "bucket"


def _set() -> Column:
    return F.coalesce(F.expr(f"(shiftright(__bits, cast(`{POS}` % {WORD} as int)) & 1L) = 1L"), F.lit(False))


def _words(places: DataFrame, file: str, pos: str) -> DataFrame:
    """The bits of places, which repeat nowhere."""
    words = places.groupBy(col(file).alias("__f"), F.expr(f"`{pos}` div {WORD}").alias("__w"))
    return words.agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{pos}` % {WORD} as int))")).alias("__bits"))


class VectorTable:
    """``keys``: columns that name a row, nulls equal to each other. ``order``: columns of which a greater tuple is newer, nulls first.
    ``buckets``: of the index, fixed by the first batch; thousands for a table of billions of rows, so that a batch of few keys
    reads little of it."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], order: list[str], buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.order = spark, root, keys, order
        log = self._log()
        self.buckets = log[0]["buckets"] if log else buckets

    # -- log -----------------------------------------------------------------------------------------------------
    def batches(self) -> list[int]:
        return [int(n[:-5]) for n in shared.names(self.spark, f"{self.root}/log") if n.endswith(".json")]

    def _log(self) -> list[dict]:
        return [json.loads(shared.read_text(self.spark, f"{self.root}/log/{n:010d}.json")) for n in self.batches()]

    def _held(self, log: list[dict]) -> list[str]:
        """The batches that are part of the table."""
        gone = {at for c in log for at in c["instead"]}
        return [c["at"] for c in log if c["at"] not in gone]

    def _read(self, kind: str, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{kind}/{at}" for at in names])

    def _index(self, names: list[str]) -> DataFrame:
        """The index of batches, the bucket being a column that prunes folders."""
        parts = [self.spark.read.option("basePath", f"{self.root}/index/{at}").parquet(f"{self.root}/index/{at}") for at in names]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out

    def _claim(self, n: int, at: str, instead: list[str]) -> int:
        if not shared.create_text(self.spark, f"{self.root}/log/{n:010d}.json", json.dumps({"batch": n, "at": at, "instead": instead, "buckets": self.buckets})):
            raise RuntimeError(f"another writer committed batch {n}; apply the changes again")
        return n

    # -- write ---------------------------------------------------------------------------------------------------
    def _hash(self) -> Column:
        return F.xxhash64(*[col(k) for k in self.keys])

    def _bucket(self) -> Column:
        return F.pmod(self._hash(), F.lit(self.buckets)).cast("int")

    def reduce(self, changes: DataFrame) -> DataFrame:
        """The newest image of each key; of full ties in the order the greatest other columns."""
        rest = [c for c in changes.columns if c not in self.keys and c not in self.order]
        top = F.max(F.struct(F.struct(*[col(c) for c in self.order]).alias("o"), F.struct(*[col(c) for c in rest]).alias("r") if rest else F.lit(0).alias("r")))
        best = changes.groupBy(*[col(k) for k in self.keys]).agg(top.alias("__top"))
        t = F.col("__top")
        return best.select(*[col(k) for k in self.keys], *[t["o"][c].alias(c) for c in self.order], *[t["r"][c].alias(c) for c in rest])

    def touched(self, new: DataFrame) -> list[int]:
        """The buckets of the index that a batch's keys lie in."""
        return sorted(new.agg(F.collect_set(self._bucket()).alias("b")).first().b)  # one bucket each at most

    def few(self, changes: DataFrame, held: list[str]) -> bool:
        """Whether the keys of a batch, by the number of its changes, are few beside the index, and few enough to be sent to every
        task. The index's size is that of its files."""
        stored = sum(shared.size(self.spark, f"{self.root}/index/{at}") for at in held)
        most = min(BROADCAST_BYTES, stored // 4) // row_bytes(changes.select(*[col(k) for k in self.keys]).schema)
        return changes.limit(most + 1).count() <= most

    def with_places(self, new: DataFrame, held: list[str], few: bool) -> DataFrame:
        """``new`` with the order (__o) and place (__old_file, __old_pos) of the newest stored image of each key, nulls where there
        is none. While the keys are ``few``, only the buckets that they lie in are read, and they are sent to the index, which
        isn't shuffled then; a batch of very many, which lie in all buckets, meets the index in one join."""
        one = F.struct(*[col(k) for k in self.keys])  # in which nulls are equal
        index = self._index(held)
        index = index.filter(col(BUCKET).isin(self.touched(new))) if few else index
        place = F.struct(F.struct(*[col(c) for c in self.order]).alias("o"), col(FILE).alias("f"), col(POS).alias("p"))
        index, new = index.select(one.alias("__k"), place.alias("__at")), new.withColumn("__k", one)
        # Of the images of a key the newest is the one whose bit isn't set: none but newer ones were ever appended.
        if few:
            found = index.join(F.broadcast(new.select("__k")), "__k", "left_semi").groupBy("__k").agg(F.max("__at").alias("__at"))
            both = new.join(F.broadcast(found), "__k", "left")  # no more of them than of the keys
        else:
            rest = F.struct(*[col(c) for c in new.columns if c != "__k"])
            both = new.select("__k", rest.alias("__new")).join(index, "__k", "left").groupBy("__k").agg(F.max("__at").alias("__at"), F.any_value("__new").alias("__new")).select("__at", "__new.*")
        at = col("__at")
        return both.withColumns({"__o": at["o"], OLD_FILE: at["f"], OLD_POS: at["p"]}).drop("__k", "__at")

    def apply(self, changes: DataFrame) -> int:
        """Apply one batch of images; returns its number."""
        log = self._log()
        held, n = self._held(log), len(log)
        new = self.reduce(changes)
        if held:
            few = self.few(changes, held)
            new = shared.written(new, "batch") if few else new
            newer = F.col("__o").isNull() | (F.struct(*[col(c) for c in self.order]) > F.col("__o"))
            images = self.with_places(new, held, few).filter(newer).drop("__o")
        else:
            images = new.withColumns({OLD_FILE: F.lit(None).cast("string"), OLD_POS: F.lit(None).cast("long")})
        at = self._store(n, images)
        bits = _words(self._read("data", [at]).filter(col(OLD_FILE).isNotNull()), OLD_FILE, OLD_POS)
        if log:
            bits = self._read("dv", [log[-1]["at"]]).unionAll(bits).groupBy("__f", "__w").agg(F.bit_or("__bits").alias("__bits"))
        bits.write.parquet(f"{self.root}/dv/{at}")
        return self._claim(n, at, [])

    def _store(self, n: int, images: DataFrame) -> str:
        """Write the data and the index of a batch."""
        at = f"{n:010d}-{uuid.uuid4().hex[:12]}"
        images.write.parquet(f"{self.root}/data/{at}")
        place = {FILE: F.col("_metadata.file_name"), POS: F.col("_metadata.row_index")}
        index = self._read("data", [at]).select(*[col(k) for k in self.keys], *[col(c) for c in self.order], *[v.alias(k) for k, v in place.items()])
        index.withColumn(BUCKET, self._bucket()).repartition(BUCKET).sortWithinPartitions(BUCKET, self._hash()).write.partitionBy(BUCKET).parquet(f"{self.root}/index/{at}")
        return at

    def compact(self, dead: float = 0.5) -> list[str]:
        """Rewrite, as one batch, the batches of which at least a share ``dead`` is superseded; returns their names. What took
        their place holds the same images, so nothing changes for readers. The old files stay until ``vacuum``."""
        log = self._log()
        held = self._held(log)
        if not held:
            return []
        of = lambda names: self._data(names).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("at"), FILE, POS)
        live = dict(self._live(of(held), log).groupBy("at").count().collect())  # a row a batch
        all_ = dict(of(held).groupBy("at").count().collect())
        old = [at for at in held if all_.get(at, 0) - live.get(at, 0) >= dead * max(all_.get(at, 0), 1)]
        if not old:
            return []
        kept = self._live(self._data(old), log).drop(FILE, POS, "__f", "__w", "__bits").withColumns({OLD_FILE: F.lit(None).cast("string"), OLD_POS: F.lit(None).cast("long")})
        at = self._store(len(log), kept)
        files = self._data(old).select(col(FILE).alias("__f")).distinct()
        self._read("dv", [log[-1]["at"]]).join(files, "__f", "left_anti").write.parquet(f"{self.root}/dv/{at}")
        self._claim(len(log), at, old)
        return old

    def vacuum(self) -> None:
        """Remove the files of batches that were replaced or never committed; nobody may be reading or writing."""
        log = self._log()
        for kind, kept in (("data", self._held(log)), ("index", self._held(log)), ("dv", [c["at"] for c in log[-1:]])):
            for at in set(shared.names(self.spark, f"{self.root}/{kind}")) - set(kept):
                shared.remove(self.spark, f"{self.root}/{kind}/{at}")

    # -- read ----------------------------------------------------------------------------------------------------
    def deleted(self) -> DataFrame:
        """(__f, __w, __bits): the delete vectors of all files."""
        return self._read("dv", [self._log()[-1]["at"]])

    def _data(self, names: list[str]) -> DataFrame:
        return self._read("data", names).withColumns({FILE: F.col("_metadata.file_name"), POS: F.col("_metadata.row_index")})

    def _live(self, rows: DataFrame, log: list[dict]) -> DataFrame:
        if len(log) == 1:
            return rows  # the first batch supersedes nothing
        bits = self._read("dv", [log[-1]["at"]])
        # The words are few beside the rows; they are broadcast where their number is checked to be small, and else
        # joined by file and word, a key that no more than 64 rows share.
        bits = F.broadcast(bits) if fits(bits) else bits
        return rows.join(bits, (col(FILE) == F.col("__f")) & (F.expr(f"`{POS}` div {WORD}") == F.col("__w")), "left").filter(~_set())

    def read(self) -> DataFrame:
        """The newest image of every key, deletes among them."""
        log = self._log()
        if not log:
            raise FileNotFoundError(f"no batch was committed in {self.root}")
        return self._live(self._data(self._held(log)), log).drop(FILE, POS, OLD_FILE, OLD_POS, "__f", "__w", "__bits")
