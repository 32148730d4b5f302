import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import tokenise as T

PATH = f"{T.FOLDER}/{T.VOCABULARY}"
PIECES = ["a", "word ", "  ", "\n\n", " \t", "日本語、テスト。", "é", "12345", "'s", "'", "🙂", "👨\u200d👩\u200d👧", "<|endoftext|>", "ß ", "\u00a0", "\u2003", "\x1c", "\x85", "мир ", "...", "x" * 40]


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randrange(1, 120))) for _ in range(n)] + ["y" * 900, " " * 700, "\n" * 300 + "a", "ab " * 300]


def whole(t):
    return T.encoder(PATH).encode_ordinary(t) if t else []


@pytest.mark.parametrize("chunk,overlap", [(20, 5), (64, 64), (100, 30), (4096, 256)])
def test_chunks_give_what_the_whole_text_gives(spark, chunk, overlap):
    data = list(enumerate(texts(150, chunk)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.ids for r in T.encode(df, chunk=chunk, overlap=overlap).collect()}
    assert got == {i: whole(t) for i, t in data}


def test_other_library_gives_the_same_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{T.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    data = [x for x in texts(100, 9) if "\x1c" not in x and "\x85" not in x]
    assert [e.ids for e in t.encode_batch(data, add_special_tokens=False)] == [whole(x) for x in data]


def test_null_empty_repeated_rows_and_clashing_names(spark):
    long = "some words " * 50
    data = [(1, None), (2, ""), (3, long), (3, long), (3, long + "!"), (None, long), (None, "a"), (4, " ")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"id": F.lit(1), "same": F.lit(2), "k": F.lit(3), "ids": F.lit(4)})
    got = sorted(((r.doc_id or -1, r.ids) for r in T.encode(df, chunk=100, overlap=20).collect()))
    assert got == sorted((i or -1, whole(t)) for i, t in data)
    assert T.encode(df.limit(0)).count() == 0


def test_texts_that_never_meet_are_encoded_at_once(spark):
    df = spark.createDataFrame([(1, "z" * 500), (2, " " * 500)], "doc_id long, text string")
    assert {r.doc_id: r.ids for r in T.encode(df, chunk=50, overlap=10).collect()} == {1: whole("z" * 500), 2: whole(" " * 500)}


def test_decoding_gives_the_bytes_back(spark):
    data = list(enumerate(texts(60, 4)))
    df = T.decode(T.encode(spark.createDataFrame(data, "doc_id long, text string"), chunk=64, overlap=16))
    assert {r.doc_id: bytes(r.bytes).decode() for r in df.collect()} == dict(data)
    void = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.bytes for r in T.decode(void).collect()] == [None, b""]


def test_other_vocabulary_folder_and_bad_sizes(spark):
    with pytest.raises(ValueError):
        T.encode(spark.createDataFrame([], "doc_id long, text string"), chunk=10, overlap=11)


def test_very_long_text(spark):
    text = "".join(texts(3000, 11))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert T.encode(df).first().ids == whole(text)
