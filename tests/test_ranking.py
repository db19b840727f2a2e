import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import index as I
from docloom.operators import ranking as R


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id string, source_name string, rank int, distance double, rrf_score double")


def test_fuse(spark):
    v = spark.createDataFrame([(1, "a", 1, 0.1), (1, "b", 2, 0.2)], "query_id long, chunk_id string, rank int, distance double")
    w = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id long, chunk_id string, rank int")
    out = {r.chunk_id: r for r in R.fuse(v, w).collect()}
    assert out["b"].rank == 1 and out["b"].rrf_score == pytest.approx(1 / 62 + 1 / 61, abs=1e-6)
    assert out["c"].distance == R.NO_VECTOR and out["a"].bm25_rank is None


def test_pool_merge_keeps_best(spark):
    out = R.merge_pools(hits(spark, [(1, "a", "s", 1, 0.5, 0.01), (1, "a", "s", 2, 0.4, 0.02), (1, "b", "s", 3, None, None)])).collect()
    assert {(r.chunk_id, r.distance, r.merged_rank) for r in out} == {("a", 0.4, 0), ("b", None, 1)}


def test_weak_chunks(spark):
    ranked = R.rerank(hits(spark, [(1, "a", "s", 1, 1.7, 0.03), (1, "b", "s", 2, 1.8, 0.0), (2, "c", "s", 1, 0.3, 0.02), (2, "d", "s", 2, 1.5, 0.001)]))
    assert {r.chunk_id for r in R.drop_weak(ranked).collect()} == {"a", "c"}


def test_interleave(spark):
    rows = [(1, f"{s}{i}", s, 10 * "xyz".index(s) + i, 0.5, 0.0) for s in "xyz" for i in range(3)]
    out = R.interleave(hits(spark, rows), 5, "rank").orderBy("context_order").collect()
    assert [r.chunk_id for r in out] == ["x0", "y0", "z0", "x1", "y1"]


def test_gates(spark):
    top = hits(spark, [(1, "a", "s", 1, 1.232, 0.0325), (2, "b", "s", 1, 0.8, 0.001), (3, "c", "s", 1, 1.2, 0.0)])
    got = {r.query_id: (r.strict, r.lookup) for r in top.select("query_id", R.is_useful("strict").alias("strict"), R.is_useful("lookup").alias("lookup")).collect()}
    assert got == {1: (False, True), 2: (True, True), 3: (True, True)}


def test_promotion_takes_first_passing(spark):
    rows = [(1, "far", "s1", 0, 1.5, 0.001), (1, "near", "s2", 1, 0.5, 0.02), (1, "nearer", "s2", 2, 0.4, 0.02)]
    status = spark.createDataFrame([("s1", "ready"), ("s2", "ready")], "source_name string, status string")
    out = R.promote(hits(spark, rows), status, F.lit(False), F.lit(False), "rank").orderBy("promoted_order").collect()
    assert [r.chunk_id for r in out] == ["near", "far", "nearer"] and all(r.grounded for r in out)
    none = R.promote(hits(spark, rows[:1]), status, F.lit(False), F.lit(False), "rank").first()
    assert not none.grounded


def test_trusted(spark):
    status = spark.createDataFrame([("s1", "failed")], "source_name string, status string")
    out = R.trusted(hits(spark, [(1, "a", "s1", 1, 0.1, 0.1), (1, "b", None, 2, 0.1, 0.1), (1, "c", "s2", 3, 0.1, 0.1)]), status).collect()
    assert {r.chunk_id for r in out} == {"b", "c"}


def test_nearest_matches_brute_force(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([0.0, 0.5, 1.0]) for _ in range(8)]) for i in range(300)] + [(900, None), (901, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id % 50 = 0 and vec_id < 300").withColumnRenamed("vec_id", "query_id")
    got = {}
    for x in I.nearest(q, v, 7, "query_id", "vec_id").collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id))
    for i in range(0, 300, 50):
        want = sorted((sum((a - b) ** 2 for a, b in zip(rows[i][1], e)), j) for j, e in rows[:300])[:7]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]


def test_bm25_without_tokens(spark):
    corpus = spark.createDataFrame([("a", "one two"), ("b", "")], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "???"), (2, "two two")], "query_id long, text string")
    assert {(r.query_id, r.chunk_id) for r in I.bm25_top(q, corpus).collect()} == {(2, "a")}
    assert I.bm25_top(q, corpus.limit(0)).count() == 0
