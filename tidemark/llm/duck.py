"""Run embedded SQL on the Arrow batches of a partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import ship

#: Memory DuckDB may take in a Python worker; what it works on at a time is far smaller, but for a single huge text.
MEMORY = "1GB"
#: Bytes of a batch worked on at a time.
SLICE = 4 << 20


def slices(batches, limit: int = SLICE):
    """The batches in parts of at most ``limit`` bytes, or of one row, so that texts of any length fit in memory."""
    for b in batches:
        todo = [b]
        while todo:
            x = todo.pop()
            if x.nbytes <= limit or x.num_rows < 2:
                yield x
            else:
                half = x.num_rows // 2
                todo += [x.slice(half), x.slice(0, half)]


def connect():
    """A private in-memory database of one thread."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})


def run(con, batch, sql: str):
    """The result of ``sql`` over ``batch`` as an Arrow table."""
    import pyarrow as pa

    con.register("batch", pa.Table.from_batches([batch]))
    try:
        return con.sql(sql).to_arrow_table()
    finally:
        con.unregister("batch")


def in_duckdb(df: DataFrame, sql: str, schema: T.StructType | str) -> DataFrame:
    """``sql`` over each Arrow batch, which it sees as the table ``batch``; one row out for one row in, or fewer."""

    def each(batches):
        con = connect()
        for b in slices(batches):
            yield from run(con, b, sql).to_batches()

    ship(df.sparkSession)
    return df.mapInArrow(each, schema)
