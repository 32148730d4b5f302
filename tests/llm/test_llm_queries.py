import pytest
from oracle import differences

from tidemark.llm import queries as Q

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    assert differences(spark, Q.queries()[name], Q.oracle_sql()[name], D) == ""


def test_both_ways_to_leaks_agree(spark):
    a, b = ({tuple(r) for r in Q.queries()[n](spark, D).collect()} for n in ("p7_found", "p7_shuffled"))
    assert a == b and a


def test_ids_are_those_of_the_whole_text(spark):
    from tidemark.llm import tokenise

    e = tokenise.encoder(f"{tokenise.FOLDER}/{tokenise.VOCABULARY}")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    assert {r.doc_id: r.ids for r in Q.p6_ids(spark, D).collect()} == {i: e.encode_ordinary(t) if t else [] for i, t in texts.items()}
