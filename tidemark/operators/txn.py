"""Optimistic transactions over a collection's state (collection, doc_id, version)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["collection", "doc_id"]
OK, CONFLICT, INVALID = "ok", "conflict", "invalid"


def conflicts(reads: DataFrame, state: DataFrame) -> DataFrame:
    """The reads whose version isn't the current one (0 for an absent document): (collection, doc_id, version, current)."""
    now = state.select(*KEYS, F.col("version").alias("current"))
    return reads.join(now, KEYS, "left").withColumn("current", F.coalesce("current", F.lit(0)).cast("long")).filter(F.col("version") != F.col("current"))


class Txn:
    """Versions read and writes staged, kept by the driver; writes become change rows at the commit.

    The first read of a document counts; a read that finds nothing is not recorded. Of several writes to a document the
    last counts. Reads don't see staged writes, and writes that weren't read never conflict.
    """

    def __init__(self, spark: SparkSession, cap: int = 0):
        self.spark, self.cap, self.reads, self.writes, self.active = spark, cap, {}, {}, True

    def read(self, state: DataFrame, collection: str, doc_id: str) -> DataFrame:
        found = state.filter((F.col("collection") == collection) & (F.col("doc_id") == doc_id))
        for r in found.select("version").limit(1).collect():
            self.reads.setdefault((collection, doc_id), r.version)
        return found

    def read_many(self, state: DataFrame, collection: str, doc_ids: list[str]) -> DataFrame:
        """The documents of a list, each recorded as read if it was found."""
        found = state.filter((F.col("collection") == collection) & F.col("doc_id").isin(doc_ids))
        for r in found.select("doc_id", "version").collect():  # no more than listed
            self.reads.setdefault((collection, r.doc_id), r.version)
        return found

    def put(self, collection: str, doc_id: str, value: object) -> None:
        self.writes[collection, doc_id] = ("put", json.dumps(value))

    def delete(self, collection: str, doc_id: str) -> None:
        self.writes[collection, doc_id] = ("delete", None)

    def rollback(self) -> None:
        self.active = False

    def read_set(self) -> DataFrame:
        return self.spark.createDataFrame([(*k, v) for k, v in self.reads.items()], "collection string, doc_id string, version long")

    def write_set(self) -> DataFrame:
        return self.spark.createDataFrame([(*k, *v) for k, v in self.writes.items()], "collection string, doc_id string, op string, value string")

    def commit(self, state: DataFrame) -> tuple[str, DataFrame | None]:
        """('ok', the change rows to append), ('conflict', the stale reads) or ('invalid', None): not active, or more writes
        than ``cap`` where one is set."""
        if not self.active or 0 < self.cap < len(self.writes):
            return INVALID, None
        stale = conflicts(self.read_set(), state)
        if self.reads and stale.limit(1).count():
            return CONFLICT, stale
        self.active = False
        return OK, self.write_set()
