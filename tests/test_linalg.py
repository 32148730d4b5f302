import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import linalg as L
from tidemark.operators import matrix as M


def vec(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_vectors(spark):
    a, b = vec(1, 2, 3), vec(4, 5, 6)
    got = spark.range(1).select(L.add(a, b), L.sub(b, a), L.scale(a, 2), L.hadamard(a, b), L.dot(vec(3, 4), vec(3, 4)), L.norm(vec(3, 4)), L.normalize(vec(3, 4)), L.normalize(vec(0, 0))).first()
    assert tuple(got) == ([5, 7, 9], [3, 3, 3], [2, 4, 6], [4, 10, 18], 25, 5, [0.6, 0.8], [0, 0])
    assert one(spark, L.euclidean(vec(1, 0), vec(0, 1))) == math.sqrt(2)
    assert [round(one(spark, L.cosine(vec(1, 0), x)), 12) for x in (vec(0, 1), vec(1, 1), vec(0, 0))] == [0, round(1 / math.sqrt(2), 12), 0]
    assert one(spark, L.zeros(2)) == [0, 0] and one(spark, L.ones(2)) == [1, 1] and one(spark, L.dot(F.lit(None).cast("array<double>"), a)) is None
    for f in (L.add, L.dot, L.euclidean, L.cosine):
        with pytest.raises(Exception, match="lengths differ"):
            one(spark, f(a, vec(1)))


def test_reading(spark):
    df = spark.createDataFrame([(i, j) for i, j in enumerate(["[1,2.5e0]", '[1,"7"]', "[]", "3", "[[1,2],[3,4]]", "[[1],[2,3]]", "[null]"])], "i int, j string").withColumn("v", F.parse_json("j"))
    got = df.orderBy("i").select(L.read_vector(F.col("v")), L.read_matrix(F.col("v"))).collect()
    assert [r[0] for r in got] == [[1, 2.5], None, [], None, None, None, None]
    assert [r[1] for r in got] == [None, None, [], None, [[1, 2], [3, 4]], None, None]


def mat(spark, rows):
    return M.from_rows(spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "i long, r array<double>"), "i", "r")


def dense(m):
    return [r["values"] for r in M.to_rows(m).orderBy("i").collect()]


def test_matrices(spark):
    a, b = mat(spark, [[1, 2], [3, 4]]), mat(spark, [[5, 6], [7, 8]])
    assert dense(M.matmul(a, b)) == [[19, 22], [43, 50]]
    assert dense(M.matmul(mat(spark, [[1, 2, 3]]), mat(spark, [[4], [5], [6]]))) == [[32]]
    assert dense(M.matmul(mat(spark, [[0, 1]]), mat(spark, [[float("inf")], [2]]))) == [[2]]
    assert dense(M.matmul(mat(spark, [[0, 0]]), mat(spark, [[1], [2]]))) == [[0]]
    x = spark.createDataFrame([(0, 7.0), (1, 8.0)], "j long, x double")
    assert [r.v for r in M.matvec(mat(spark, [[1, 2], [3, 4], [5, 6]]), x).orderBy("i").collect()] == [23, 53, 83]
    assert M.trace(mat(spark, [[1, 2, 3], [4, 5, 6], [7, 8, 9]])).first()[0] == 15
    assert dense(M.add(a, b)) == [[6, 8], [10, 12]] and dense(M.sub(b, a)) == [[4, 4], [4, 4]] and dense(M.scale(a, 2)) == [[2, 4], [6, 8]]
    assert dense(M.transpose(mat(spark, [[1, 2, 3]]))) == [[1], [2], [3]] and dense(M.identity(spark, 2)) == [[1, 0], [0, 1]]
    assert M.shape(M.filled(spark, 3, 2, 1)) == (3, 2) and M.get(a, 1, 0).first().v == 3 and dense(M.set_cell(a, 0, 0, 9)) == [[9, 2], [3, 4]]
    assert M.to_text(a).orderBy("i").first().text == "[1.0, 2.0]"
    flat = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "f array<double>")
    assert dense(M.from_flat(flat, "f", 2, 2)) == [[1, 2], [3, 4]]
    for bad in (lambda: M.matmul(a, mat(spark, [[1, 2]])), lambda: M.add(a, mat(spark, [[1]])), lambda: M.trace(mat(spark, [[1, 2]])), lambda: M.matvec(mat(spark, [[1]]), x)):
        with pytest.raises(ValueError):
            bad()
    for lazy in (lambda: M.from_flat(flat, "f", 3, 2).collect(), lambda: mat(spark, [[1], [2, 3]]).collect()):
        with pytest.raises(Exception, match="differ|wrong number"):
            lazy()


def test_most_similar(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [1.0, 1.0, 0.0])], "doc_id string, embedding array<double>")
    assert [r.doc_id for r in M.most_similar(df, [1, 0, 0], 2).collect()] == ["a", "c"] and M.most_similar(df, [1, 0, 0], 0).count() == 0


@pytest.mark.parametrize("side", [1, 3, 64])
def test_products_by_blocks_are_those_of_a_plain_loop(spark, side):
    import math
    import random

    r = random.Random(side)
    n, k, m = 7, 5, 8
    value = lambda: r.choice([0.0, 0.0, 1.0, -2.5, float("inf"), float("-inf"), float("nan"), r.gauss(0, 1)])
    a, b = [[value() for _ in range(k)] for _ in range(n)], [[value() for _ in range(m)] for _ in range(k)]
    got = dense(M.matmul(mat(spark, a), mat(spark, b), side))
    for i in range(n):
        for j in range(m):
            want = sum(a[i][q] * b[q][j] for q in range(k) if a[i][q] != 0)
            assert math.isclose(got[i][j], want, abs_tol=1e-9) or math.isnan(got[i][j]) and math.isnan(want)
