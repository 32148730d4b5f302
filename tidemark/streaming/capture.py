"""Log-based change capture: per-partition offsets, a batch plan written ahead, replay, and a sink that deduplicates.

The log is append-only and has an offset that grows (``seq``). It is seen as ``partitions`` partitions by a hash of the
key, so all changes of a key are in one of them. A run

1. plans: for each partition the offsets (from, to] not yet taken, written to ``plans/<batch>.json`` before any work;
2. works on exactly the rows of the plan;
3. writes the result to ``sink/batch=<n>``, replacing whatever a failed try left there;
4. commits by writing ``commits/<batch>.json``.

A plan without a commit is replayed as it stands before anything new is planned, so a failure at any point neither
skips nor repeats rows. Readers of the sink see committed batches only and keep, of each key, the row of the greatest
offset.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import hlc_order, op_kind, same_id
from ..plans.skew import col, fresh
from ..sources import shared

PARTITIONS = 64


class ChangeCapture:
    def __init__(self, spark: SparkSession, root: str, keys: list[str], offset: str = "seq", partitions: int = PARTITIONS):
        self.spark, self.root, self.keys, self.offset, self.partitions = spark, root, keys, offset, partitions

    def partition(self) -> Column:
        return F.pmod(F.xxhash64(*[col(k) for k in self.keys]), F.lit(self.partitions)).cast("int")

    def _batches(self, kind: str) -> list[int]:
        return [int(n[:-5]) for n in shared.names(self.spark, f"{self.root}/{kind}") if n.endswith(".json")]

    def _at(self, kind: str, n: int) -> str:
        return f"{self.root}/{kind}/{n:010d}.json"

    def plan(self, log: DataFrame) -> dict | None:
        """The plan to work on: one that wasn't committed, or else a new one; null if the log has nothing new.

        Rows without an offset can't be placed in the log and are left alone.
        """
        plans, commits = self._batches("plans"), set(self._batches("commits"))
        for n in plans:
            if n not in commits:
                lost = json.loads(shared.read_text(self.spark, self._at("plans", n)))
                self._check(lost["to"])
                return lost
        since = json.loads(shared.read_text(self.spark, self._at("plans", plans[-1])))["to"] if plans else [None] * self.partitions
        self._check(since)
        ends = dict(log.groupBy(self.partition().alias("p")).agg(F.max(col(self.offset)).alias("m")).collect())  # one row a partition
        to = [max((x for x in (since[p], ends.get(p)) if x is not None), default=None) for p in range(self.partitions)]
        if to == since:
            return None
        made = {"batch": plans[-1] + 1 if plans else 0, "from": since, "to": to}
        if not shared.create_text(self.spark, self._at("plans", made["batch"]), json.dumps(made)):
            return self.plan(log)  # another run planned first; its plan is open, so it is the one to work on
        return made

    def _check(self, ends: list) -> None:
        if len(ends) != self.partitions:
            raise ValueError(f"{self.root} has plans of {len(ends)} partitions, not of {self.partitions}")

    def read(self, log: DataFrame, plan: dict) -> DataFrame:
        """Exactly the rows of the plan."""
        p, o = self.partition(), col(self.offset)

        def bound(ends: list, none: int) -> Column:
            return F.element_at(F.array(*[F.lit(none if x is None else x).cast("long") for x in ends]), p + 1)

        most = [x for x in plan["to"] if x is not None]
        least = [x for x in plan["from"] if x is not None]
        rows = log.filter(o <= max(most, default=-(1 << 63)))  # plain bounds reach the files' statistics
        if len(least) == self.partitions:
            rows = rows.filter(o > min(least))
        return rows.filter((o > bound(plan["from"], -(1 << 63))) & (o <= bound(plan["to"], -(1 << 63))))

    def run(self, log: DataFrame, work: Callable[[DataFrame], DataFrame]) -> int | None:
        """One run; returns the batch, or null if there was nothing new. ``work`` must give rows with the keys and the offset."""
        plan = self.plan(log)
        if plan is None:
            return None
        n = plan["batch"]
        work(self.read(log, plan)).write.mode("overwrite").parquet(f"{self.root}/sink/batch={n}")
        shared.write_text(self.spark, self._at("commits", n), json.dumps({"batch": n}))
        return n

    def sink(self) -> DataFrame | None:
        """What the committed batches hold, one row a key: that of the greatest offset. Null before the first commit."""
        done = self._batches("commits")
        if not done:
            return None
        rows = self.spark.read.parquet(*[f"{self.root}/sink/batch={n}" for n in done])
        return latest_by(rows, self.keys, [col(self.offset)])


def latest_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, that of the greatest ``order``; of full ties the one with the greatest other columns.

    A partial aggregate on the map side, so a key with any share of the rows costs one row a task. Nulls in a key are
    equal to each other.
    """
    rest = [c for c in rows.columns if c not in keys]
    (top,) = fresh(rows, "top")
    o = [x.alias(f"o{i}") for i, x in enumerate(order)]
    best = rows.groupBy(*[col(k) for k in keys]).agg(F.max(F.struct(*o, F.struct(*[col(c) for c in rest]).alias("r"))).alias(top))
    return best.select(*[col(k) for k in keys], *[col(top)["r"][c].alias(c) for c in rest]).select(*[col(c) for c in rows.columns])


def heads(changes: DataFrame) -> DataFrame:
    """(collection, doc_id, op, version, change_id, hlc, seq) of each document's head.

    The head is the change with the greatest clock by wall, counter, node; one without a clock is older than any with
    it. Of deliveries of one clock, one that has an identifier is taken first, then the latest. ``op`` is 'put' or
    'delete', ``change_id`` lower case without blanks at the ends; rows whose operation is neither are left out.
    """
    rows = changes.select(
        "collection", "doc_id", op_kind(F.col("op")).alias("op"), "version",
        same_id(F.col("change_id")).alias("change_id"), "hlc", "seq",
    ).filter(F.col("op").isNotNull())
    h = hlc_order(F.col("hlc"))
    best = rows.groupBy("collection", "doc_id").agg(
        F.max(F.struct(h.alias("h"), F.coalesce(F.length("change_id") > 0, F.lit(False)).alias("told"), "seq", "version", "change_id", "op")).alias("b")
    )
    b = F.col("b")
    clock = F.when(b["h"]["has"], F.struct(b["h"]["wall"].alias("wall"), b["h"]["counter"].alias("counter"), b["h"]["node"].alias("node")))
    return best.select("collection", "doc_id", b["op"].alias("op"), b["version"].alias("version"), b["change_id"].alias("change_id"), clock.alias("hlc"), b["seq"].alias("seq"))


def recorded(marks: DataFrame, runs: DataFrame) -> DataFrame:
    """The sink as the runs that succeeded left it: (collection, doc_id, run_id, version, change_id), one row a key.

    Marks repeat; of a key the one of the greatest offset, which is the run, counts, and in it the last mark.
    """
    good = runs.filter(F.col("status") == "succeeded").select("run_id").distinct()
    rows = marks.join(good, "run_id", "left_semi").select("collection", "doc_id", "run_id", "mark_id", "version", same_id(F.col("change_id")).alias("change_id"))
    return latest_by(rows, ["collection", "doc_id"], [F.col("run_id"), F.col("mark_id")]).drop("mark_id")


def stored_heads(capture: ChangeCapture, log: DataFrame) -> DataFrame:
    """The heads that the committed batches of ``capture`` hold, one row a document, in the order of ``heads``."""
    done = capture._batches("commits")
    if not done:
        return heads(log.limit(0))
    rows = capture.spark.read.parquet(*[f"{capture.root}/sink/batch={n}" for n in done])
    if len(done) == 1:
        return rows
    told = F.coalesce(F.length("change_id") > 0, F.lit(False))
    return latest_by(rows, capture.keys, [hlc_order(F.col("hlc")), told, F.col("seq")])


def due(spark: SparkSession, log: DataFrame, marks: DataFrame, runs: DataFrame, root: str | None = None) -> DataFrame:
    """(collection, doc_id, version, change_id, op) of every document the next run must process.

    The new rows of the log are planned ahead under ``root`` (a new folder of the shared one by default), reduced to heads,
    written as a batch and committed; a plan that an earlier call lost is replayed first. The heads of all committed
    batches are held against each other by their clocks, so a late change with an older one stays behind. A head is due
    if no succeeded run recorded the document or the latest that did has another version or another change_id, whichever
    call first saw it: a document comes out until a run that succeeds has recorded it. A missing identifier equals a
    missing or empty one only.
    """
    capture = ChangeCapture(spark, root or shared.fresh_folder(spark, "capture"), ["collection", "doc_id"])
    lost = set(capture._batches("plans")) - set(capture._batches("commits"))
    for _ in range(len(lost) + 1):
        capture.run(log, heads)
    h, r = stored_heads(capture, log).alias("h"), recorded(marks, runs).alias("r")
    same = (F.col("h.collection").eqNullSafe(F.col("r.collection"))) & (F.col("h.doc_id").eqNullSafe(F.col("r.doc_id")))
    known = F.col("r.run_id").isNotNull()
    agree = F.col("h.version").eqNullSafe(F.col("r.version")) & (F.coalesce("h.change_id", F.lit("")) == F.coalesce("r.change_id", F.lit("")))
    return h.join(r, same, "left").filter(~known | ~agree).select("h.collection", "h.doc_id", "h.version", "h.change_id", "h.op")
