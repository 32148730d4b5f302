"""Subscriptions to documents and fields, over a stored log and over a stream of it.

A log has (collection, doc_id, op, version, seq, ...) and the watched field as a column. A field is missing where it is
null and after a delete. Events come where the field differs from what it was before; a NaN differs from everything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.skew import by_heat, carried, col, in_chunks
from ..session import ship

KEYS = ["collection", "doc_id"]
CHUNK = 1 << 20
DELTA = "collection string, doc_id string, seq long, version long, kind string, old string, new string, added string"


def document(log: DataFrame, collection: str, doc_id: str) -> DataFrame:
    """The events of one document: its puts with the value, its deletes with null. Works on a log and on a stream."""
    return log.filter((F.col("collection") == collection) & (F.col("doc_id") == doc_id))


def _differs(old: Column, new: Column, floating: bool) -> Column:
    d = ~old.eqNullSafe(new)
    return d | F.isnan(new) & new.isNotNull() if floating else d


def field_changes(log: DataFrame, field: str, keys: list[str] = KEYS, chunk: int = CHUNK, puts: Column | None = None) -> DataFrame:
    """``log``'s rows at which ``field`` changed, with ``old`` and ``new``, by one pass in the order of seq.

    Documents with many changes are worked on by chunks of seq, with the last value carried over.
    """
    floating = dict(log.dtypes)[field] in ("double", "float")
    put = F.col("op") == "put" if puts is None else puts
    told = log.withColumn("new", F.when(put, col(field))).withColumn("_new", F.struct("new"))
    return by_heat(told, keys, chunk, lambda rows, hot: _changed(rows, keys, chunk, floating, hot))


def _changed(rows: DataFrame, keys: list[str], chunk: int, floating: bool, hot: bool) -> DataFrame:
    rows, key, chunk_ = in_chunks(rows, keys, "seq", chunk, hot)
    rows = carried(rows, key, chunk_, F.max_by("_new", "seq"), "_carry", hot=hot)
    rows = rows.withColumn("old", F.coalesce(F.lag("_new").over(Window.partitionBy(key, chunk_).orderBy("seq")), F.col("_carry"))["new"])
    return rows.filter(_differs(F.col("old"), F.col("new"), floating)).drop(key, chunk_, "_new", "_carry")


def delta(old: Column, new: Column) -> tuple[Column, Column]:
    """(kind, added): 'set' where there was nothing, 'delete' where nothing is left, 'append' with the added end where a
    text got longer, else 'replace'."""
    appended = new.startswith(old)
    kind = F.when(old.isNull(), "set").when(new.isNull(), "delete").when(appended, "append").otherwise("replace")
    return kind, F.when(old.isNotNull() & new.isNotNull() & appended, F.expr("substring(new, length(old) + 1)"))


def field_deltas(log: DataFrame, field: str, keys: list[str] = KEYS, chunk: int = CHUNK, puts: Column | None = None) -> DataFrame:
    """``field_changes`` with ``kind`` and ``added``; of fields that aren't texts none is appended to."""
    rows = field_changes(log, field, keys, chunk, puts)
    if dict(log.dtypes)[field] == "string":
        kind, added = delta(F.col("old"), F.col("new"))
    else:
        kind, added = F.when(F.col("old").isNull(), "set").when(F.col("new").isNull(), "delete").otherwise("replace"), F.lit(None).cast("string")
    return rows.withColumns({"kind": kind, "added": added})


def _deltas_of_key(text: bool, floating: bool):
    names = [f.split()[0] for f in DELTA.split(", ")]

    def each(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        new = rows["value"].astype(object).where((rows["op"] == "put") & rows["value"].notna(), None).to_numpy(object)
        old = np.concatenate(([state.get[0] if state.exists else None], new[:-1]))
        at = old != new
        if floating:
            at = at | (new == "NaN")
        state.update((new[-1],))
        o, n = old[at], new[at]
        was, now = pd.notna(o), pd.notna(n)
        kind = np.select([~was, ~now], ["set", "delete"], "replace").astype(object)
        added = np.full(len(o), None, object)
        if text:
            for i in np.flatnonzero(was & now):  # only where a text took another's place
                if n[i].startswith(o[i]):
                    kind[i], added[i] = "append", n[i][len(o[i]) :]
        out = {k: np.full(len(o), v, object) for k, v in zip(KEYS, key)}
        yield pd.DataFrame(out | {"seq": rows["seq"].to_numpy()[at], "version": rows["version"].to_numpy()[at], "kind": kind, "old": o, "new": n, "added": added}, columns=names)

    return each


def stream_deltas(changes: DataFrame, field: str) -> DataFrame:
    """The events of ``field_deltas`` over a stream of changes, for a field of any atomic type; the last value of each
    document is kept as state. Changes of a document must arrive in the order of seq across batches; inside one they may not."""
    ship(changes.sparkSession)
    kind = dict(changes.dtypes)[field]
    rows = changes.select(*KEYS, "seq", F.col("version").cast("long").alias("version"), "op", col(field).cast("string").alias("value"))
    each = _deltas_of_key(kind == "string", kind in ("double", "float"))
    events = rows.groupBy(*KEYS).applyInPandasWithState(each, DELTA, "old string", "append", "NoTimeout")
    return events.withColumns({c: F.col(c).cast(kind) for c in ("old", "new")})


def stream_changes(changes: DataFrame, field: str) -> DataFrame:
    """The events of ``field_changes`` over a stream: (collection, doc_id, seq, version, old, new)."""
    return stream_deltas(changes, field).select(*KEYS, "seq", "version", "old", "new")


def deliver(events: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Start to hand each batch of events to ``handler(batch, number)``. After a failure a batch comes again under its
    number, so a handler that writes by number delivers once. ``stop()`` of the result unsubscribes."""
    return events.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(**trigger or {"processingTime": "1 second"}).start()
