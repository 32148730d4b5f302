"""Evaluation passages in training text, found by winnowing.

Texts are brought to one form (look-alikes, width, invisible characters, case) and split into words. Of each text the
hashes of all GRAM consecutive words are made, and of each WINDOW consecutive hashes the least is kept. Any span of
GRAM + WINDOW - 1 words that two texts share holds a whole window, so both keep the same hash from it: no span of SPAN
words is missed. Kept hashes are joined, and each hit is extended to both sides, word by word, to the full span.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import col, crowded, spread_join
from ..session import ship
from ..sources.shared import written
from . import duck
from .lookalike import caseless_table, form_sql

#: Words a leak has at least; words of a fingerprint; fingerprints of a window.
SPAN, GRAM = 12, 5
WINDOW = SPAN - GRAM + 1
#: Evaluation material up to this many characters is sent to the tasks; beyond it, fingerprints are joined by shuffle.
BROADCAST_CHARS = 8_000_000
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_sql(c: str) -> str:
    """The words of a text, as hashes of 63 bits; an empty list for null."""
    form = f"lower({form_sql(c, caseless_table())})"
    return f"list_transform(regexp_extract_all(coalesce({form}, ''), '[\\p{{L}}\\p{{N}}]+'), lambda w: (hash(w) >> 1)::BIGINT)"


def word_lists(con, batch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of a batch in one array, and the offset of each row's in it (one more than rows)."""
    t = duck.run(con, batch, f"SELECT {words_sql(text)} AS w FROM batch").column("w").combine_chunks()
    offsets = t.offsets.to_numpy().astype(np.int64)
    return t.values.to_numpy(zero_copy_only=False).view(np.uint64)[offsets[0] : offsets[-1]], offsets - offsets[0]


def fingerprints(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) that winnowing keeps, all rows of the batch at once. Equal least hashes of a window are all kept."""
    n = len(words)
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    end = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(n)
    g = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(GRAM):
            g = g * np.uint64(0x9E3779B97F4A7C15)
            g[: n - j] += words[j:]
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
    g[at + GRAM > end] = NONE
    least = np.full(n, NONE)
    m = n - WINDOW + 1
    least[:m] = g[:m]
    for j in range(1, WINDOW):
        np.minimum(least[:m], g[j : j + m], out=least[:m])
    full = at + SPAN <= end
    keep = np.zeros(n, bool)
    for j in range(WINDOW):
        keep[j:] |= full[: n - j] & (least[: n - j] == g[j:])
    keep &= at + GRAM <= end
    return at[keep], g[keep]


def extend(a: np.ndarray, a0: np.ndarray, a1: np.ndarray, i: np.ndarray, b: np.ndarray, b0: np.ndarray, b1: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the words of ``a`` around i and of ``b`` around k agree over SPAN words at least, inside [a0, a1) and [b0, b1)."""
    run, right, left = np.zeros(len(i), np.int64), np.ones(len(i), bool), np.ones(len(i), bool)
    for d in range(SPAN):
        right &= (i + d < a1) & (k + d < b1)
        right[right] = a[i[right] + d] == b[k[right] + d]
        run += right
    for d in range(1, SPAN):
        left &= (i - d >= a0) & (k - d >= b0)
        left[left] = a[i[left] - d] == b[k[left] - d]
        run += left
    return run >= SPAN


class Items:
    """The evaluation material as the tasks get it: words, and fingerprints in order of their hash."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, offsets: np.ndarray):
        self.ids, self.words, self.offsets = ids, words, offsets
        pos, h = fingerprints(words, offsets)
        order = np.argsort(h, kind="stable")
        self.hash, self.pos = h[order], pos[order]
        self.item = np.searchsorted(offsets, self.pos, side="right") - 1

    def leaks(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Pairs (row, item), each once."""
        pos, h = fingerprints(words, offsets)
        lo, hi = np.searchsorted(self.hash, h, side="left"), np.searchsorted(self.hash, h, side="right")
        some = hi > lo
        pos, lo, n = pos[some], lo[some], (hi - lo)[some]
        if not len(pos):
            return np.zeros((0, 2), np.int64)
        i = np.repeat(pos, n)
        k = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        row, item = np.searchsorted(offsets, i, side="right") - 1, self.item[k]
        ok = extend(words, offsets[row], offsets[row + 1], i, self.words, self.offsets[item], self.offsets[item + 1], self.pos[k])
        return np.unique(np.stack([row[ok], item[ok]], 1), axis=0)


def _used(df: DataFrame, name: str, text: str) -> DataFrame:
    return df.select(col(name).cast("long").alias("id"), col(text).alias("t")).filter(F.col("id").isNotNull() & (F.length("t") > 0))


def _gather(items: DataFrame) -> Items:
    """The word hashes of the items, made by tasks; called behind a check of their size only."""

    def each(batches):
        con = duck.connect()
        for b in duck.slices(batches):
            yield from duck.run(con, b, f"SELECT id, {words_sql('t')} AS words FROM batch").to_batches()

    got = items.mapInArrow(each, "id long, words array<long>").collect()
    words = [np.array(r.words, np.int64).view(np.uint64) for r in got]
    offsets = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    return Items(np.array([r.id for r in got], np.int64), np.concatenate([*words, np.zeros(0, np.uint64)]), offsets)


def _pairs(ids: np.ndarray, others: np.ndarray, names: tuple[str, str]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others, pa.int64())], list(names))


def _by_broadcast(docs: DataFrame, items: DataFrame) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(_gather(items))

    def each(batches):
        con, held = duck.connect(), sent.value
        for b in duck.slices(batches):
            p = held.leaks(*word_lists(con, b, "t"))
            yield _pairs(b.column(0).to_numpy(zero_copy_only=False)[p[:, 0]], held.ids[p[:, 1]], ("doc_id", "item_id"))

    return docs.mapInArrow(each, "doc_id long, item_id long")


def _prints(df: DataFrame, name: str) -> DataFrame:
    """(name, h): the fingerprints of texts, each once a text."""

    def each(batches):
        con = duck.connect()
        for b in duck.slices(batches):
            words, offsets = word_lists(con, b, "t")
            pos, h = fingerprints(words, offsets)
            row = np.searchsorted(offsets, pos, side="right") - 1
            both = np.unique(np.stack([row, h.view(np.int64)], 1), axis=0)
            yield _pairs(b.column(0).to_numpy(zero_copy_only=False)[both[:, 0]], both[:, 1], (name, "h"))

    return df.mapInArrow(each, f"{name} long, h long")


def _verified(batches):
    """Extend all hits of a batch at once: its documents against the items that any of them may hold."""
    import pyarrow as pa

    con = duck.connect()
    for b in duck.slices(batches):
        held = b.column(2).flatten()
        ids, first = np.unique(held.field(0).to_numpy(zero_copy_only=False), return_index=True)
        texts = pa.RecordBatch.from_arrays([held.field(1).take(pa.array(first))], ["t"])
        found = Items(ids, *word_lists(con, texts, "t"))
        p = found.leaks(*word_lists(con, b, "t"))
        yield _pairs(b.column(0).to_numpy(zero_copy_only=False)[p[:, 0]], ids[p[:, 1]], ("doc_id", "item_id"))


def _by_shuffle(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Fingerprints of both sides are joined, those that many texts share being split; the items that a document shares one
    with are brought to it, each document's text being moved once, and extended word by word."""
    left, right = written(_prints(docs, "doc_id"), "prints"), written(_prints(items, "item_id"), "prints")
    shared = spread_join(left, right, "h", F.col("doc_id"), F.col("item_id"), crowded(left, "h"), crowded(right, "h"))
    hits = written(shared.select("doc_id", "item_id").distinct(), "hits")
    theirs = items.select(F.col("id").alias("item_id"), F.col("t").alias("u"))
    brought = spread_join(hits, theirs, "item_id", F.col("doc_id"), F.lit(0), crowded(hits, "item_id"), {})
    per = brought.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "u")).alias("items"))
    texts = docs.withColumnRenamed("id", "doc_id").join(per, "doc_id")
    return texts.select("doc_id", "t", "items").mapInArrow(_verified, "doc_id long, item_id long")


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", limit: int = BROADCAST_CHARS) -> DataFrame:
    """(doc_id, item_id), each once: the text holds at least SPAN consecutive words of the passage.

    Words are runs of letters and digits, across line ends, without regard to case, punctuation and the differences
    between look-alikes. Rows with a null id, and null, empty and shorter texts, take part in no pair. Items of up to
    ``limit`` characters in all are sent to the tasks, so documents aren't shuffled; more are joined by shuffle.
    """
    ship(docs.sparkSession)
    docs, items = _used(docs, doc_id, text), _used(items, item_id, passage)
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    return (_by_broadcast if chars <= limit else _by_shuffle)(docs, items).distinct()
