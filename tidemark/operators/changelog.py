"""Collections as an append-only change log: state, versions and overlay are queries over it.

A log has (collection, doc_id, op, seq, ...), ``op`` being 'put' or 'delete' and ``seq`` unique and growing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.skew import by_heat, carry, col, in_chunks
from ..sources import shared
from ..streaming.capture import latest_by

KEYS = ["collection", "doc_id"]
#: Span of seq in which ordered work is done at a time.
CHUNK = 1 << 20


def changes(rows: DataFrame, op: str, collection: str, seq: Column) -> DataFrame:
    """Documents as change rows of one collection; deletes carry no value."""
    return rows.withColumns({"collection": F.lit(collection), "op": F.lit(op), "seq": seq.cast("long")})


def append(log: str, rows: DataFrame) -> None:
    """Append change rows to a stored log. One writer at a time; a batch becomes visible at once by its commit."""
    rows.write.mode("append").parquet(log)


def put_many(spark: SparkSession, log: str, rows: DataFrame, collection: str, order: str | None = None) -> None:
    """Append a batch of puts in ``order``, after all that is there. An id that occurs twice is written twice; the last wins."""
    _append_many(spark, log, rows, "put", collection, order)


def delete_many(spark: SparkSession, log: str, ids: DataFrame, collection: str) -> None:
    _append_many(spark, log, ids.select("doc_id"), "delete", collection, None)


def _append_many(spark: SparkSession, log: str, rows: DataFrame, op: str, collection: str, order: str | None) -> None:
    last = 0
    if shared.exists(spark, log):
        last = spark.read.parquet(log).agg(F.max("seq")).first()[0] or 0
    rows = rows.orderBy(col(order)) if order else rows
    # Partition number and place within it: growing with the order, unique, with gaps.
    append(log, changes(rows, op, collection, F.lit(last + 1) + F.monotonically_increasing_id()))


def read(spark: SparkSession, log: str | list[str], tolerant: bool = False) -> DataFrame:
    """A stored log, of one folder or several. ``tolerant`` leaves out files that are torn or corrupt, as a recovery does, instead of failing."""
    reader = spark.read.option("mergeSchema", "true")
    return (reader.option("ignoreCorruptFiles", "true") if tolerant else reader).parquet(*[log] if isinstance(log, str) else log)


def current(log: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The live documents: the last change of each that is a put."""
    return latest_by(log, keys, [col("seq")]).filter(F.col("op") == "put")


def with_versions(log: DataFrame, keys: list[str] = KEYS, chunk: int = CHUNK) -> DataFrame:
    """``log`` with ``version``, without the deletes of absent documents.

    A put's version is one more than that of the document before it, 1 if it was absent; a delete that finds a document
    has one more too, and the count begins again after it. Documents of any number of changes are worked on by chunks of
    seq, with the puts since the last delete carried over.
    """
    return by_heat(log, keys, chunk, lambda rows, hot: _with_versions(rows, keys, chunk, hot))


def _with_versions(log: DataFrame, keys: list[str], chunk: int, hot: bool) -> DataFrame:
    c = F.col
    rows, key, chunk_ = in_chunks(log, keys, "seq", chunk, hot)
    rows = rows.withColumn("_del", (c("op") == "delete").cast("int"))
    rows = rows.withColumn("_epoch", F.sum("_del").over(Window.partitionBy(key, chunk_).orderBy("seq")) - c("_del"))
    rows = rows.withColumn("_puts", F.sum(1 - c("_del")).over(Window.partitionBy(key, chunk_, "_epoch").orderBy("seq")) - (1 - c("_del")))
    if not hot:
        rows = rows.withColumn("version", (c("_puts") + 1).cast("long")).filter((c("_del") == 0) | (c("_puts") > 0))
        return rows.drop(key, chunk_, "_del", "_epoch", "_puts")
    # Of each chunk: whether it has a delete, and the puts since its last.
    s = rows.groupBy(key, chunk_).agg(F.max("_del").alias("d"), F.max_by(F.when(c("_del") == 1, 0).otherwise(c("_puts") + 1), "seq").alias("tail"))
    order = Window.partitionBy(key).orderBy(chunk_)
    s = s.withColumn("g", F.sum("d").over(order)).withColumn("t", F.sum("tail").over(Window.partitionBy(key, "g").orderBy(chunk_)))
    s = s.withColumn("_carry", F.coalesce(F.lag("t").over(order), F.lit(0))).drop("d", "tail", "g", "t")
    before = c("_puts") + F.when(c("_epoch") == 0, c("_carry")).otherwise(0)
    rows = carry(rows, s, key, chunk_).withColumn("version", (before + 1).cast("long")).filter((c("_del") == 0) | (before > 0))
    return rows.drop(key, chunk_, "_del", "_epoch", "_puts", "_carry")


def version_of(log: DataFrame, doc_id: object, keys: list[str] = KEYS) -> DataFrame:
    """One row (version) of a document's live state, 0 if it is absent. Only its own changes are read."""
    mine = log.filter(col(keys[-1]) == F.lit(doc_id))
    last = latest_by(with_versions(mine, keys), [keys[-1]], [col("seq")])
    return last.agg(F.coalesce(F.max(F.when(F.col("op") == "put", F.col("version"))), F.lit(0)).cast("long").alias("version"))


def overlay(snapshot: DataFrame, log: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """A snapshot with the changes since: its documents that no change touched, and the live ones of the log."""
    touched = log.select(*[col(k) for k in keys]).distinct()
    live = current(log, keys).select(*[col(x) for x in snapshot.columns])
    k = [f"_k{i}" for i in range(len(keys))]
    touched = touched.toDF(*k)
    kept = snapshot.join(touched, [col(a).eqNullSafe(F.col(b)) for a, b in zip(keys, k)], "left_anti")
    return kept.unionByName(live)


def write_snapshot(df: DataFrame, path: str, key: str = "doc_id") -> None:
    """Replace a snapshot, stored by ranges of the key and in its order within files, so that lookups skip files and row groups."""
    df.repartitionByRange(col(key)).sortWithinPartitions(col(key)).write.mode("overwrite").parquet(path)


def compact(spark: SparkSession, snapshot: str | None, log: str, to: str) -> int:
    """Write the state as a new snapshot at ``to`` and return the greatest seq it holds; log rows up to it aren't needed
    any more."""
    rows = read(spark, log)
    last = rows.agg(F.max("seq")).first()[0] or 0
    state = overlay(spark.read.parquet(snapshot), rows) if snapshot else current(rows)
    write_snapshot(state, to)
    return last
