import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from pagemill.operators import dense

V = "vector array<float>"


def test_against_numpy_with_ties_and_a_zero_vector(spark):
    r = np.random.default_rng(3)
    m = r.integers(-2, 3, (60, 4)).astype(float)
    m[5] = 0
    chunks = spark.createDataFrame([(k % 7, k, m[k].tolist()) for k in range(60)], f"page int, chunk bigint, {V}").repartition(5)
    queries = spark.createDataFrame([(k, m[k].tolist()) for k in (0, 5, 9)], f"query bigint, {V}")
    unit = np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    s = np.round(unit @ unit.T, 9)
    want = []
    for q in (0, 5, 9):
        for p in range(7):
            own = [k for k in range(60) if k % 7 == p]
            best = max(own, key=lambda k: (s[q, k], -k))
            want.append((q, p, best, float(s[q, best])))
    assert rows(dense.best_chunk(dense.scored(queries, chunks))) == sorted(want)
    top = dense.scored(queries, chunks, k=3)
    for q in (0, 9):
        got = [(r.chunk, r.score) for r in top.filter(F.col("query") == q).orderBy(F.desc("score"), "chunk").limit(3).collect()]
        assert got == [(k, float(s[q, k])) for k in sorted(range(60), key=lambda k: (-s[q, k], k))[:3]]


def test_blocks_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 2)
    chunks = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [0.0, 1.0]), (None, 3, [1.0, 1.0]), (3, 4, None)], f"page int, chunk bigint, {V}")
    queries = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)] + [(None, [1.0, 1.0])], f"query bigint, {V}")
    assert dense.scored(queries, chunks).count() == 10
    assert dense.scored(queries.limit(0), chunks).count() == 0 and dense.scored(queries, chunks.limit(0)).count() == 0


def test_late_interaction(spark):
    q = spark.createDataFrame([(1, 10, [1.0, 0.0]), (1, 11, [0.0, 1.0])], f"query bigint, part bigint, {V}")
    p = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 2.0]), (2, 2, [1.0, 0.0])], f"page bigint, part bigint, {V}")
    assert rows(dense.late_interaction(q, p)) == [(1, 1, 2.0), (1, 2, 1.0)]


def test_unit_and_hashed(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [list(r[0]) for r in df.select(dense.unit(F.col("v"))).collect()] == [pytest.approx([0.6, 0.8]), [0.0, 0.0]]
    q = spark.createDataFrame([("q", "d", "a b")], "question_id string, doc_id string, question string")
    p = spark.createDataFrame([("d", 1, "b a"), ("d", 2, "")], "doc_id string, page int, text string")
    assert rows(dense.hashed_similarity(q, p)) == [("q", "d", 1, 1.0)]
