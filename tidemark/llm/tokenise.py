"""Encode a corpus with a public byte-level BPE vocabulary, long texts in overlapping chunks.

A text is cut into chunks that overlap. Each chunk is split into pre-tokens by itself; where the splits of a chunk and
of the next one meet in their overlap, both go on alike from there, because a split depends on what follows only. That
meeting point is where the chunks are stitched: the left one is encoded up to it, and the next one's tokens before it
are dropped. The result equals that of encoding the text at once.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import col
from ..session import ship
from ..sources.shared import written
from .duck import slices

#: Where the vocabulary files are; a parameter of every function here.
FOLDER = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits a text into pre-tokens for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a chunk, and how far it reaches into the next one.
CHUNK, OVERLAP = 4096, 256


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=1)
def splitter():
    import regex

    return regex.compile(PATTERN)


def starts(text: str) -> list[int]:
    """Where the pre-tokens begin."""
    return [m.start() for m in splitter().finditer(text)]


def meeting(text: str, own: list[int], border: int) -> int | None:
    """The first position at or after ``border`` where a pre-token of ``text`` and one of ``text[border:]`` begin, and
    before which a visible character stands (a cut there changes the split on neither side). None if there is none."""
    other = {border + s for s in starts(text[border:])}
    return next((s for s in own if s >= border and s in other and text[s - 1].isprintable() and not text[s - 1].isspace()), None)


def encode_chunk(text: str, first: bool, last: bool, chunk: int, overlap: int, path: str) -> tuple[list[int], int | None, list[int], list[int]]:
    """Of one chunk: its ids up to where the next one takes over; that place, relative to the next chunk's start; and,
    for the stretch where the one before may hand over, the beginnings of pre-tokens and the number of ids before each.
    Without a meeting point the place is None and the ids are void."""
    e = encoder(path)
    own = starts(text)
    end = len(text) if last else meeting(text, own, chunk)
    if end is None:
        return [], None, [], []
    ids, places, counts, at = [], [], [], 0
    if not first:
        for s, z in zip(own, [*own[1:], len(text)]):
            if s >= overlap:
                break
            places.append(s)
            counts.append(len(ids))
            ids += e.encode_ordinary(text[s:z])
            at = z
    ids += e.encode_ordinary(text[at:end])
    return ids, None if last else end - chunk, places, counts


def _whole(path: str):
    def each(batches):
        import pyarrow as pa

        e = encoder(path)
        for b in slices(batches):
            ids = [e.encode_ordinary(t) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return each


def _cut(chunk: int, overlap: int):
    """The chunks of long texts, some at a time; work grows with the text's length."""

    def each(batches):
        import pyarrow as pa

        names = ["id", "same", "k", "m", "text"]
        for b in slices(batches):
            for row, (same, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                m = -(-(len(text) - overlap) // chunk)
                for lo in range(0, m, 256):
                    ks = range(lo, min(lo + 256, m))
                    parts = [text[k * chunk : len(text) if k == m - 1 else (k + 1) * chunk + overlap] for k in ks]
                    n = len(parts)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([row] * n)), pa.array([same] * n, pa.int64()), pa.array(ks, pa.int32()), pa.array([m] * n, pa.int32()), pa.array(parts, pa.string())], names)

    return each


def _chunks(chunk: int, overlap: int, path: str):
    def each(batches):
        import pyarrow as pa

        ints = pa.list_(pa.int32())
        for b in slices(batches):
            k, most, text = (b.column(i).to_pylist() for i in (2, 3, 4))
            got = [encode_chunk(t, i == 0, i == m - 1, chunk, overlap, path) for i, m, t in zip(k, most, text)]
            cols = [pa.array([g[j] for g in got], kind) for j, kind in enumerate((ints, pa.int32(), ints, ints))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), *cols], ["id", "same", "k", "m", "ids", "meet", "places", "counts"])

    return each


def encode(df: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = FOLDER, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids): the ids of every text, without special tokens; their names inside a text are ordinary text.

    An empty and a null text have an empty list. Rows are one for one; those with the same id, or a null one, are kept
    apart. Texts of up to ``chunk + overlap`` characters are one chunk. Longer ones are cut into chunks, which tasks
    encode independently, and stitched; one whose chunks do not meet in an overlap is encoded at once.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("overlap must lie between 1 and chunk")
    ship(df.sparkSession)
    path = f"{folder}/{VOCABULARY}"
    rows = df.select(col(doc_id).alias("id"), col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    long = F.coalesce(F.length("text") > chunk + overlap, F.lit(False))
    out = f"id {kind}, ids array<int>"
    short = rows.filter(~long).mapInArrow(_whole(path), out)

    cut = rows.filter(long).withColumn("same", F.xxhash64("text")).select("id", "same", "text")
    cut = cut.mapInArrow(_cut(chunk, overlap), f"id {kind}, same long, k int, m int, text string").repartition("id", "same", "k")
    done = cut.mapInArrow(_chunks(chunk, overlap, path), f"id {kind}, same long, k int, m int, ids array<int>, meet int, places array<int>, counts array<int>")
    # A text's chunks come together here, as its ids do in the result: one row's worth.
    parts = done.groupBy("id", "same").agg(
        F.array_sort(F.collect_set(F.struct("k", "ids", "meet", "places", "counts"))).alias("p"),
        F.sum((F.col("k") == 0).cast("int")).alias("copies"),
        F.bool_and((F.col("k") == F.col("m") - 1) | F.col("meet").isNotNull()).alias("met"),
    )
    parts = written(parts, "chunks")
    before = "counts[cast(array_position(x.places, p[i - 1].meet) as int) - 1]"
    stitched = F.expr(f"flatten(transform(p, (x, i) -> if(i = 0, x.ids, slice(x.ids, x.{before} + 1, size(x.ids)))))")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    good = parts.filter("met").select("id", stitched.alias("ids"), copies.alias("c")).drop("c")
    torn = parts.filter("not met").select(F.col("id").alias("torn"), F.col("same").alias("torn_same"))
    whole = rows.filter(long).withColumn("same", F.xxhash64("text"))
    whole = whole.join(torn, F.col("id").eqNullSafe(F.col("torn")) & (F.col("same") == F.col("torn_same")), "left_semi")
    result = short.unionAll(good).unionAll(whole.select("id", "text").mapInArrow(_whole(path), out))
    return result.withColumnRenamed("id", doc_id)


def decode(df: DataFrame, ids: str = "ids", out: str = "bytes", folder: str = FOLDER) -> DataFrame:
    """``df`` with BINARY ``out``: the raw bytes of the ids, concatenated. Null for null; an id outside the vocabulary raises."""
    ship(df.sparkSession)
    path = f"{folder}/{VOCABULARY}"

    def each(batches):
        import pyarrow as pa

        back = {v: k for k, v in ranks(path).items()}
        for b in slices(batches):
            text = [None if x is None else b"".join([back[i] for i in x]) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.binary())], [*b.schema.names, out])

    return df.mapInArrow(each, df.withColumn(out, F.lit(None).cast("binary")).schema)
