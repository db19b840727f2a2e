import json

from pyspark.sql import functions as F

from docloom.operators import answers as A
from docloom.sources import cases


def test_cases_are_read_and_scored(spark, tmp_path):
    path = tmp_path / "cases.json"
    expected = {"mode_in": ["grounded"], "refusal": False, "answer_substrings_any": ["kiln"], "retrieval_anchors_any": [], "answer_substrings_must_not": ["secret"]}
    path.write_text(json.dumps({"chunk_size": 900, "chunk_overlap": 120, "top_k": 6, "cases": [{"id": "a", "category": "x", "query": "q", "expected": expected}, {"id": "b", "category": None, "query": "q", "expected": {**expected, "refusal": True}}]}, indent=1))
    c = cases.read_cases(spark, str(path))
    turns = c.withColumn("mode", F.lit("grounded")).withColumn("text", F.lit("The kiln is open [SOURCE 1].")).withColumn("hits_text", F.lit("")).withColumn("hit_count", F.lit(1))
    got = {r.id: r for r in A.score(turns).collect()}
    assert got["a"].passed and got["a"].citation_ok and not got["b"].passed and got["b"].citation_ok is None
    total = A.rates(A.score(turns)).first()
    assert (total.cases, total.passed, total.pass_rate) == (2, 1, 0.5)
    assert {r.category: r.failed for r in A.by_category(A.score(turns)).collect()} == {"x": 0, "unknown": 1}


def test_scenarios(spark, tmp_path):
    path = tmp_path / "scenarios.json"
    path.write_text(json.dumps({"scenarios": [{"id": "s1", "user_message": "hi", "expected_routing": "fast", "expected_mode": ["general", "web"]}, {"id": "s1", "user_message": "", "expected_routing": ["a"], "expected_mode": "b"}, {"user_message": "x"}]}))
    s = cases.read_scenarios(spark, str(path))
    rows = s.collect()
    assert rows[0].routings == ["fast"] and rows[0].modes == ["general", "web"]
    assert {(r.id, r.problem) for r in cases.violations(s).collect()} == {("s1", "repeated id"), ("s1", "no message"), (None, "no id"), (None, "no routing"), (None, "no mode")}
    assert [r.m for r in s.select(cases.matches(F.lit("fast"), F.col("routings")).alias("m")).collect()] == [True, False, True]


def test_log(spark, tmp_path):
    for _ in range(2):
        cases.append_log(spark.createDataFrame([(1, "x" * 50)], "turn_id long, note string"), str(tmp_path / "log"), 30)
    assert [len(r.value) for r in spark.read.text(str(tmp_path / "log")).collect()] == [30, 30]
