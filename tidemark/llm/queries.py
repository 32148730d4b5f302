"""The text problems' queries and their SQL. Every query runs over all documents and their whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import leakage, lookalike, tokenise


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def p6_ids(spark, d):
    return tokenise.encode(_t(spark, d, "documents"))


def p6_roundtrip(spark, d):
    """Whether the bytes of the ids are those of the text."""
    docs = _t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = tokenise.decode(tokenise.encode(docs)).select("doc_id", "bytes")
    return docs.join(back, "doc_id").select("doc_id", (F.encode("text", "utf-8") == F.col("bytes")).alias("same"))


def p6_method(spark, d):
    """Whether small chunks, which cut every text but the shortest, give the ids of p6_ids."""
    docs = _t(spark, d, "documents")
    small = tokenise.encode(docs, chunk=256, overlap=96).withColumnRenamed("ids", "small")
    return tokenise.encode(docs).join(small, "doc_id").select("doc_id", (F.col("ids") == F.col("small")).alias("same"))


def p7_found(spark, d):
    return leakage.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p7_shuffled(spark, d):
    """The same by the way for evaluation material of any size."""
    return leakage.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"), limit=0)


def p8_found(spark, d):
    return lookalike.same_looking_pairs(_t(spark, d, "documents"))


def p8_form(spark, d):
    return lookalike.consistent_text(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", "form")


def p8_classes(spark, d):
    return lookalike.classes(_t(spark, d, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p6_ids, p6_method, p6_roundtrip, p7_found, p7_shuffled, p8_found, p8_form, p8_classes)}


def oracle_sql() -> dict:
    form = lookalike.form_sql("text")
    words = lambda t: f"regexp_extract_all(lower({lookalike.form_sql(t, lookalike.caseless_table())}), '[\\p{{L}}\\p{{N}}]+')"
    # All runs of twelve words, held against each other as they are.
    spans = f"""WITH d AS (SELECT doc_id, {words("text")} AS w FROM documents WHERE length(text) > 0), e AS (SELECT item_id, {words("passage")} AS w FROM eval_items),
      ds AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS s FROM d),
      es AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS s FROM e)
      SELECT DISTINCT doc_id, item_id FROM ds JOIN es ON ds.s = es.s"""
    return {
        "p6_method": "SELECT doc_id, true AS same FROM documents",
        "p7_found": spans,
        "p7_shuffled": spans,
        "p6_roundtrip": "SELECT doc_id, true AS same FROM documents",
        "p8_found": f"""WITH f AS (SELECT doc_id, text, {form} AS form FROM documents WHERE length(text) > 0)
          SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text""",
        "p8_form": f"SELECT doc_id, {form} AS form FROM documents",
        "p8_classes": f"""WITH f AS (SELECT doc_id, text, {form} AS form FROM documents WHERE length(text) > 0),
          c AS (SELECT form, min(doc_id) AS class_id, count(DISTINCT text) AS writings FROM f GROUP BY form)
          SELECT doc_id, class_id, writings FROM f JOIN c ON f.form = c.form""",
    }
