import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemark.llm import lookalike as L

SAME = [
    ("cafe\u0301", "café"), ("а", "a"), ("ё", "ë"), ("е\u0308", "ë"), ("Ａｂｃ１！", "Abc1!"), ("a\u200bb\u00ad", "ab"), ("a\u00a0b\u3000c", "a b c"), ("ο", "o"), ("ɡ", "g"),
    ("e\u200b\u0301", "é"), ("ў", "y\u0306"), ("Ά", "Á"), ("Å", "Å"), ("가", "가"), ("\ufeffx", "x"), ("й", "и\u0306"), ("\uffa0x", "x"),
]
DIFFERENT = [("a", "A"), ("e", "é"), ("2", "²"), ("a b", "a  b"), ("a b", "a\nb"), ("½", "1/2"), ("ﬁ", "fi"), ("и", "й"), ("👨\u200d👩\u200d👧", "👨👩👧"), ("a", "ä"), ("в", "b"), ("", " ")]


def forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.form for r in L.consistent_text(df).orderBy("i").collect()]


def test_what_looks_the_same_gets_one_form_and_nothing_else(spark):
    f = forms(spark, [x for p in SAME + DIFFERENT for x in p])
    n = 2 * len(SAME)
    assert [p for p, a, b in zip(SAME, f[0:n:2], f[1:n:2]) if a != b] == []
    assert [p for p, a, b in zip(DIFFERENT, f[n::2], f[n + 1 :: 2]) if a == b] == []
    assert forms(spark, f) == f  # a form is its own form


def test_null_empty_extra_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, b"x", None), (2, "", None, [1])], "text int, `the text` string, raw binary, l array<int>")
    got = L.consistent_text(df, "the text")
    assert [r.form for r in got.orderBy("text").collect()] == [None, ""] and got.columns == [*df.columns, "form"]
    assert L.consistent_text(df.limit(0), "the text").count() == 0
    with pytest.raises(ValueError):
        L.consistent_text(df.withColumn("Form", F.lit(1)), "the text")


def noisy(t, r):
    back = {}
    for k, v in L.LOOKALIKES.items():
        back.setdefault(v, []).append(k)
    out = ""
    for c in t:
        u = r.random()
        c = r.choice(back[c]) if u < 0.2 and c in back else chr(ord(c) + 0xFEE0) if u < 0.3 and "!" <= c <= "~" else "\u2009" if u < 0.5 and c == " " else c
        out += c + ("\u200d" if r.random() < 0.05 else "")
    return unicodedata.normalize("NFD", out) if r.random() < 0.3 else out


def test_pairs_against_brute_force(spark):
    r = random.Random(5)
    base = ["The quick brown fox é", "Ein Satz über Öl", "Слово и дело", "Same text", "SAME text"]
    docs = [(i, noisy(t, r) if r.random() < 0.6 else t) for i, t in enumerate(r.choice(base) for _ in range(120))]
    docs += [(200, None), (201, None), (202, ""), (203, ""), (None, "Same text"), (204, "\u200b"), (205, "\ufeff")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as form", "2 as raw", "3 as salt", "4 as id")
    table = L.table()

    def form(t):
        t = unicodedata.normalize("NFC", "".join(" " if unicodedata.category(c) == "Zs" else c for c in t if c not in "\u200b\u200d\ufeff"))
        return unicodedata.normalize("NFC", "".join(table.get(c, c) for c in t))

    want = {(a, b) for a, x in docs for b, y in docs if x and y and a is not None and b is not None and a < b and x != y and form(x) == form(y)}
    got = [tuple(p) for p in L.same_looking_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    classes = {r.doc_id: (r.class_id, r.writings) for r in L.classes(df.filter("doc_id is not null")).collect()}
    least, texts = {}, {}
    for i, t in docs:
        if t and i is not None:
            least[form(t)] = min(i, least.get(form(t), i))
            texts.setdefault(form(t), set()).add(t)
    assert classes == {i: (least[form(t)], len(texts[form(t)])) for i, t in docs if t and i is not None}


def test_large_class_of_copies_makes_only_its_pairs(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "cоpy").otherwise("copy").alias("text"))
    assert L.same_looking_pairs(df).count() == 2999
    assert L.same_looking_pairs(df.filter("doc_id <> 7")).count() == 0
    assert L.same_looking_pairs(df.limit(0)).count() == 0


def test_large_batches_are_worked_on_in_parts():
    import pyarrow as pa

    from tidemark.llm import duck

    b = pa.RecordBatch.from_pydict({"i": list(range(100)), "t": ["x" * (10_000 if i == 50 else 100) for i in range(100)]})
    parts = list(duck.slices([b], 2000))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(100)) and max(p.num_rows for p in parts if p.nbytes <= 2000) > 1
    assert [p.num_rows for p in parts if p.nbytes > 2000] == [1]
    assert list(duck.slices([b.slice(0, 0)]))[0].num_rows == 0


def test_very_long_texts(spark):
    df = spark.createDataFrame([(1, "аbc " * 500_000), (2, "abc " * 500_000), (3, "x")], "doc_id long, text string")
    assert [tuple(r) for r in L.same_looking_pairs(df).collect()] == [(1, 2)]


def test_width_forms_numerals_and_mathematical_letters(spark):
    pairs = [("ｶﾞｯｺｳ", "ガッコウ"), ("Ⅷ", "VIII"), ("ⅳ", "iv"), ("𝐇𝖾llo", "Hello"), ("￥5", "¥5"), ("ＡΒС", "ABC"), ("Ꭺpple", "Apple"), ("ıst", "ist")]
    f = forms(spark, [x for p in pairs for x in p])
    assert [p for p, a, b in zip(pairs, f[::2], f[1::2]) if a != b] == []
    apart = [("𝟓", "5"), ("x²", "x2"), ("ﾊﾟ", "ハ"), ("①", "1"), ("½", "1/2")]
    f = forms(spark, [x for p in apart for x in p])
    assert [p for p, a, b in zip(apart, f[::2], f[1::2]) if a == b] == []
