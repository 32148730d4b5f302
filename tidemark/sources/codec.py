"""Compact binary forms for exchange: blocks of samples and tagged values. For cold paths; tables are Parquet."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship

#: Limits on what is decoded (bytes of a text, items of an array, fields of an object).
MAX_BYTES, MAX_ITEMS, MAX_FIELDS = 16 << 20, 1_000_000, 1_000_000
#: The tag of each kind of value.
TAGS = {"null": 0, "true": 1, "false": 2, "int": 3, "float": 4, "string": 5, "bytes": 6, "array": 7, "object": 8}
_MASK = (1 << 64) - 1


# -- blocks of samples: delta of deltas of the times, XOR of the values ---------------------------------------------------
class Bits:
    """A reader of bits, from the highest of each byte on."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(10), 0, len(data) * 8

    def take(self, width: int) -> int:
        if self.at + width > self.end:
            raise ValueError("the block ends early")
        lo, self.at = self.at, self.at + width
        return int.from_bytes(self.data[lo >> 3 : (lo >> 3) + 10], "big") >> 80 - (lo & 7) - width & (1 << width) - 1


#: Bits of a delta of deltas by its prefix of ones; the last holds any.
WIDTHS = (0, 7, 9, 12, 65)


def _packed(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Numbers of up to 64 bits, each in as many bits as its width, one after the other."""
    owner = np.repeat(np.arange(len(widths)), widths)
    place = np.arange(len(owner)) - (np.cumsum(widths) - widths)[owner]
    return np.packbits((values[owner] >> (widths[owner] - 1 - place).astype(np.uint64) & np.uint64(1)).astype(np.uint8)).tobytes()


def _bit_length(x: np.ndarray) -> np.ndarray:
    n, x = np.zeros(len(x), np.int64), x.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = x >> np.uint64(step) != 0
        n[big] += step
        x[big] >>= np.uint64(step)
    return n + (x != 0)


def encode_block(ts: Iterable[int], values: Iterable[float]) -> bytes:
    """A block of samples of any order and any values, NaN included, bit for bit."""
    t = np.array(list(ts), object)
    v = np.array(values if isinstance(values, (np.ndarray, pd.Series)) else list(values), np.float64).view(np.uint64)
    n = len(t)
    if not n:
        return struct.pack(">I", 0)
    dod = np.diff(np.diff(t, prepend=t[:1]), prepend=0)[1:] if n > 1 else t[:0]
    if n > 1 and max(map(abs, (dod.min(), dod.max()))) < 1 << 62:
        dod = dod.astype(np.int64)
    kind = np.full(n - 1, 4)
    for k in (3, 2, 1):
        kind[(dod >= -(1 << WIDTHS[k] - 1)) & (dod < 1 << WIDTHS[k] - 1)] = k
    kind[dod == 0] = 0
    low = dod.astype(np.int64).view(np.uint64) if dod.dtype != object else np.array([int(d) & _MASK for d in dod], np.uint64)
    x = v[1:] ^ v[:-1]
    lead, tail = 64 - _bit_length(x), _bit_length(x & (~x + np.uint64(1))) - 1
    # The stretch of bits that is written stays while it holds what differs: the one thing that goes from sample to sample.
    fresh, at, width = np.zeros(n - 1, bool), np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64)
    a = w = -1
    for i, zl, zt in zip(some := np.flatnonzero(x), lead[some].tolist(), tail[some].tolist()):
        if a < 0 or zl < a or zt < 64 - a - w:
            a, w, fresh[i] = zl, 64 - zl - zt, True
        at[i], width[i] = a, w
    same = x == 0
    fields = [
        (np.where(kind < 4, (1 << kind + 1) - 2, 15), np.minimum(kind + 1, 4)), (np.array(dod < 0), np.where(kind == 4, 1, 0)), (low, np.where(kind == 4, 64, np.array(WIDTHS)[kind])),
        (np.where(same, 0, np.where(fresh, 3, 2)), np.where(same, 1, 2)), (at, np.where(fresh, 6, 0)), (width - 1, np.where(fresh, 6, 0)), (x >> (np.minimum(64 - at - width, 63)).astype(np.uint64), width),
    ]
    numbers = np.concatenate([np.array([int(t[0]) & _MASK, int(v[0])], np.uint64), np.stack([f.astype(np.uint64) for f, _ in fields], 1).ravel()])
    widths = np.concatenate([np.array([64, 64]), np.stack([g for _, g in fields], 1).ravel()])
    return struct.pack(">I", n) + _packed(numbers, widths)


def _signed(v: int, width: int) -> int:
    return v - (1 << width) if v >> width - 1 else v


def decode_block(data: bytes) -> tuple[list[int], list[float]]:
    n, src = struct.unpack(">I", data[:4])[0], Bits(data[4:])
    take, ts, bits = src.take, [], []
    delta, lead, width = 0, 0, 0
    for i in range(n):
        if not i:
            ts.append(_signed(take(64), 64))
            bits.append(take(64))
            continue
        k = 0
        while k < 4 and take(1):
            k += 1
        delta += _signed(take(WIDTHS[k]), WIDTHS[k]) if k else 0
        ts.append(ts[-1] + delta)
        x = 0
        if take(1):
            if take(1):
                lead, width = take(6), take(6) + 1
            x = take(width) << 64 - lead - width
        bits.append(bits[-1] ^ x)
    return ts, np.array(bits, np.uint64).view(np.float64).tolist()


def encode_blocks(rows: DataFrame) -> DataFrame:
    """(series_id, seg, part, samples, payload) of rows that ``series.with_blocks`` made; a group is one block."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("append_seq")
        first = pdf.iloc[0]
        return pd.DataFrame([[first["series_id"], first["seg"], first["part"], len(pdf), encode_block(pdf["ts_ms"].tolist(), pdf["value"].to_numpy(float))]], columns=["series_id", "seg", "part", "samples", "payload"])

    ship(rows.sparkSession)
    kind = dict(rows.dtypes)["series_id"]
    return rows.groupBy("series_id", "seg", "part").applyInPandas(one, f"series_id {kind}, seg long, part long, samples long, payload binary")


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """(series_id, seg, part, pos, ts_ms, value) of encoded blocks."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [decode_block(bytes(p)) for p in pdf["payload"]]
            n = [len(ts) for ts, _ in got]
            at = pdf.index.repeat(n)
            out = {c: pdf[c].loc[at].to_numpy() for c in ("series_id", "seg", "part")}
            pos = np.concatenate([np.arange(k) for k in n] or [np.zeros(0, int)])
            yield pd.DataFrame(out | {"pos": pos, "ts_ms": np.array([t for ts, _ in got for t in ts], "int64"), "value": np.array([v for _, vs in got for v in vs], float)})

    ship(blocks.sparkSession)
    kind = dict(blocks.dtypes)["series_id"]
    return blocks.select("series_id", "seg", "part", "payload").mapInPandas(each, f"series_id {kind}, seg long, part long, pos long, ts_ms long, value double")


def encode_tile(ts: list[int], cells: list[list[float]]) -> bytes:
    """A chunk of a tile: the frames' times once, then the values of each cell through the frames."""
    parts = [encode_block(ts, [0.0] * len(ts)), *(encode_block(range(len(v)), v) for v in cells)]
    return struct.pack(">I", len(parts)) + b"".join(struct.pack(">I", len(p)) + p for p in parts)


def decode_tile(data: bytes) -> tuple[list[int], list[list[float]]]:
    n, at, parts = struct.unpack(">I", data[:4])[0], 4, []
    for _ in range(n):
        size = struct.unpack(">I", data[at : at + 4])[0]
        parts.append(decode_block(data[at + 4 : at + 4 + size]))
        at += 4 + size
    return parts[0][0], [v for _, v in parts[1:]]


def encode_tiles(rows: DataFrame) -> DataFrame:
    """(tile_r, tile_c, seg, part, frames, payload) of rows that ``raster.with_chunks`` made; a group is one chunk of a tile,
    its cells in the order of row, col and channel. A cell that lacks a frame is 0 in it."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = pdf.pivot_table(index=["ts_ms", "append_seq"], columns=["row", "col", "channel"], values="value", aggfunc="first", dropna=False).sort_index(level="append_seq").sort_index(axis=1).fillna(0.0)
        places = np.array(list(cells.columns), "<i4").tobytes()
        raw = encode_tile([int(t) for t, _ in cells.index], cells.to_numpy().T.tolist())
        key = [pdf[c].iloc[0] for c in ("tile_r", "tile_c", "seg", "part")]
        return pd.DataFrame([[*key, len(cells), struct.pack(">I", len(places)) + places + raw]], columns=["tile_r", "tile_c", "seg", "part", "frames", "payload"])

    ship(rows.sparkSession)
    return rows.groupBy("tile_r", "tile_c", "seg", "part").applyInPandas(one, "tile_r int, tile_c int, seg long, part long, frames long, payload binary")


def decode_tiles(chunks: DataFrame) -> DataFrame:
    """(ts_ms, row, col, channel, value) of encoded chunks of tiles."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["payload"]:
                raw = bytes(raw)
                n = struct.unpack(">I", raw[:4])[0]
                places = np.frombuffer(raw[4 : 4 + n], "<i4").reshape(-1, 3)
                ts, cells = decode_tile(raw[4 + n :])
                out = {c: np.repeat(places[:, i], len(ts)) for i, c in enumerate(("row", "col", "channel"))}
                yield pd.DataFrame({"ts_ms": np.tile(np.array(ts, "int64"), len(places)), **out, "value": np.array(cells, float).ravel()})

    ship(chunks.sparkSession)
    return chunks.select("payload").mapInPandas(each, "ts_ms long, row int, col int, channel int, value double")


# -- tagged values -------------------------------------------------------------------------------------------------------
def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def encode_value(v: object) -> bytes:
    """None, bool, int (64 bits), float, str, bytes, list or dict with text keys."""
    if v is None:
        return bytes([TAGS["null"]])
    if isinstance(v, bool):
        return bytes([TAGS["true" if v else "false"]])
    if isinstance(v, int):
        return bytes([TAGS["int"]]) + _varint((v << 1 ^ v >> 63) & _MASK)
    if isinstance(v, float):
        return bytes([TAGS["float"]]) + struct.pack("<d", v)
    if isinstance(v, (str, bytes)):
        raw = v.encode() if isinstance(v, str) else v
        return bytes([TAGS["string" if isinstance(v, str) else "bytes"]]) + _varint(len(raw)) + raw
    if isinstance(v, list):
        return bytes([TAGS["array"]]) + _varint(len(v)) + b"".join(map(encode_value, v))
    if isinstance(v, dict):
        return bytes([TAGS["object"]]) + _varint(len(v)) + b"".join(_varint(len(k.encode())) + k.encode() + encode_value(x) for k, x in v.items())
    raise TypeError(type(v).__name__)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def raw(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the value ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def varint(self, most: int = _MASK) -> int:
        n = shift = 0
        while True:
            b = self.raw(1)[0]
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
            if shift > 63:
                raise ValueError("a number is too long")
        if n > most:
            raise ValueError(f"{n} is more than {most}")
        return n

    def value(self) -> object:
        tag = self.raw(1)[0]
        if tag == TAGS["null"]:
            return None
        if tag in (TAGS["true"], TAGS["false"]):
            return tag == TAGS["true"]
        if tag == TAGS["int"]:
            n = self.varint()
            return n >> 1 ^ -(n & 1)
        if tag == TAGS["float"]:
            return struct.unpack("<d", self.raw(8))[0]
        if tag == TAGS["string"]:
            return self.raw(self.varint(MAX_BYTES)).decode()
        if tag == TAGS["bytes"]:
            return self.raw(self.varint(MAX_BYTES))
        if tag == TAGS["array"]:
            return [self.value() for _ in range(self.varint(MAX_ITEMS))]
        if tag == TAGS["object"]:
            return {self.raw(self.varint(MAX_BYTES)).decode(): self.value() for _ in range(self.varint(MAX_FIELDS))}
        raise ValueError(f"unknown tag {tag}")


def decode_value(data: bytes) -> object:
    return _Reader(data).value()


def write_framed(stream: BinaryIO, v: object) -> None:
    raw = encode_value(v)
    stream.write(_varint(len(raw)) + raw)


def read_framed(stream: BinaryIO) -> Iterator[object]:
    """All values of a stream; one that ends inside a frame raises."""
    r = _Reader(stream.read())
    while r.at < len(r.data):
        yield decode_value(r.raw(r.varint()))


def encode_rows(df: DataFrame, out: str = "payload", framed: bool = False) -> DataFrame:
    """One row (``out``) a row of ``df``: its columns as the object they make, encoded; ``framed`` with its length before it.
    Columns are of the types that have a kind, or arrays of them."""

    def each(batches: Iterator) -> Iterator:
        import io

        import pyarrow as pa

        for b in batches:
            raw = []
            for r in b.to_pylist():
                if framed:
                    write_framed(stream := io.BytesIO(), r)
                    raw.append(stream.getvalue())
                else:
                    raw.append(encode_value(r))
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], [out])

    ship(df.sparkSession)
    return df.mapInArrow(each, f"`{out}` binary")


def decode_rows(df: DataFrame, schema: str, payload: str = "payload", framed: bool = False) -> DataFrame:
    """The rows that ``encode_rows`` encoded, with the columns of ``schema``; a field that isn't there is null. ``framed``: a
    payload holds any number of them."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def each(batches: Iterator) -> Iterator:
        import io

        import pyarrow as pa

        for b in batches:
            raw = [x for x in b.column(0).to_pylist() if x is not None]
            got = [v for x in raw for v in (read_framed(io.BytesIO(x)) if framed else (decode_value(x),))]
            yield pa.RecordBatch.from_pylist(got, schema=arrow)

    ship(df.sparkSession)
    return df.select(payload).mapInArrow(each, schema)
