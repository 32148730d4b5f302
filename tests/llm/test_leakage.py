import random

import numpy as np
import pytest
import regex

from tidemark.llm import leakage as L
from tidemark.llm import lookalike

WORDS = regex.compile(r"[\p{L}\p{N}]+")


def plain(t):
    table = lookalike.caseless_table()
    t = regex.sub(lookalike.INVISIBLE, "", t)
    return WORDS.findall("".join(table.get(c, c) for c in t).lower())


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = plain(t or "")
        grams = {tuple(w[i : i + L.SPAN]) for i in range(len(w) - L.SPAN + 1)}
        for i, p in items:
            v = plain(p or "")
            if d is not None and i is not None and any(tuple(v[k : k + L.SPAN]) in grams for k in range(len(v) - L.SPAN + 1)):
                out.add((d, i))
    return out


def made(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["Слово", "естЬ", "Öl", "２０"]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    shared = text(15)  # an instruction that items share
    items = [(i, text(r.randrange(5, 40)) + (shared if i % 4 == 0 else [])) for i in range(20)]
    docs = []
    for d in range(80):
        w = text(r.randrange(0, 60))
        for _ in range(r.randrange(3)):
            _, p = r.choice(items)
            n = r.choice([11, 12, 13, 25])
            k = r.randrange(max(1, len(p) - n))
            at = r.randrange(len(w) + 1)
            w = w[:at] + p[k : k + n] + w[at:]
        t = ""
        for x in w:
            x = r.choice([x, x, x.upper(), "\u200b".join(x), x.replace("w", "ｗ"), x.replace("о", "o")])
            t += x + r.choice([" ", "\n", ", ", "\u00a0-- ", "\r\n"])
        docs.append((d, t))
    return docs, [(i, " ".join(p)) for i, p in items]


@pytest.mark.parametrize("limit", [L.BROADCAST_CHARS, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_are_those_of_brute_force(spark, limit, seed):
    docs, items = made(seed)
    docs += [(None, items[0][1]), (100, None), (101, ""), (102, items[3][1]), (102, items[3][1]), (103, "word " * 5000 + items[1][1])]
    items += [(None, docs[0][1]), (50, None), (51, ""), (3, items[3][1])]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    got = [tuple(r) for r in L.leaks(d.selectExpr("*", "1 as id", "2 as t", "3 as item_id"), e.selectExpr("*", "1 as t"), limit=limit).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(docs, items)


@pytest.mark.parametrize("limit", [L.BROADCAST_CHARS, 0])
def test_empty_tables(spark, limit):
    d, e = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, passage string")
    one = spark.createDataFrame([(1, "a " * 20)], "doc_id long, text string")
    assert L.leaks(d, e, limit=limit).count() == L.leaks(one, e, limit=limit).count() == 0


def test_every_span_keeps_a_fingerprint_in_common():
    r = np.random.default_rng(0)
    for _ in range(300):
        span = r.integers(0, 5, L.SPAN).astype(np.uint64)
        kept = []
        for _ in range(2):
            w = np.concatenate([r.integers(0, 5, r.integers(0, 9)), span, r.integers(0, 5, r.integers(0, 9))]).astype(np.uint64)
            kept.append(set(L.fingerprints(w, np.array([0, len(w)]))[1].tolist()))
        assert kept[0] & kept[1]


def test_fingerprints_stay_inside_their_row():
    r = np.random.default_rng(1)
    rows = [r.integers(0, 1000, n).astype(np.uint64) for n in (30, 0, 11, 12, 50)]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
    pos, h = L.fingerprints(np.concatenate(rows), offsets)
    for k, x in enumerate(rows):
        own, alone = (pos >= offsets[k]) & (pos < offsets[k + 1]), L.fingerprints(x, np.array([0, len(x)]))
        assert (pos[own] - offsets[k]).tolist() == alone[0].tolist() and h[own].tolist() == alone[1].tolist()
    assert len(pos) < 0.6 * sum(map(len, rows))


def test_by_shuffle_with_an_item_that_many_documents_hold(spark, monkeypatch):
    from tidemark.llm import leakage
    from tidemark.plans import skew

    monkeypatch.setattr(leakage, "crowded", lambda df, on: skew.crowded(df, on, 0.01, 5))
    shared = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame([(i, f"start{i} {shared if i % 3 else 'nothing'} end{i} " + " ".join(f"d{i}x{j}" for j in range(20))) for i in range(120)], "doc_id long, text string")
    items = spark.createDataFrame([(k, f"{shared} own{k} " + " ".join(f"d{k}x{j}" for j in range(14))) for k in range(6)], "item_id long, passage string")
    want = {(i, k) for i in range(120) for k in range(6) if i % 3 or i == k}
    for limit in (0, 1 << 30):
        got = [tuple(r) for r in leakage.leaks(docs, items, limit=limit).collect()]
        assert len(got) == len(want) and set(got) == want
