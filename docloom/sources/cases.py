"""Evaluation cases and scenarios from JSON files, and log sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXPECTED = "struct<mode_in: array<string>, refusal: boolean, answer_substrings_any: array<string>, retrieval_anchors_any: array<string>, answer_substrings_must_not: array<string>>"
CASES = f"chunk_size int, chunk_overlap int, top_k int, corpus_files array<string>, cases array<struct<id: string, category: string, query: string, task_mode: string, expected: {EXPECTED}>>"
MOST_LOGGED = 8192


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row for each case of a JSON file, its expectations as columns, with the file's settings."""
    rows = spark.read.schema(CASES).json(path, multiLine=True)
    each = rows.select("chunk_size", "chunk_overlap", "top_k", F.explode("cases").alias("c")).select("chunk_size", "chunk_overlap", "top_k", "c.*")
    e = F.col("expected")
    return each.select(
        "id", "category", "query", "task_mode", "chunk_size", "chunk_overlap", "top_k", e["mode_in"].alias("mode_in"), e["refusal"].alias("refusal"), e["answer_substrings_any"].alias("any_of"), e["retrieval_anchors_any"].alias("anchors"), e["answer_substrings_must_not"].alias("forbidden")
    )


def as_list(c: Column) -> Column:
    """A JSON value that is a string or a list of strings, as an array; null for anything else."""
    listed = F.try_parse_json(c).try_cast("array<string>") if hasattr(Column, "try_cast") else F.from_json(c, "array<string>")
    return F.when(c.startswith("["), listed).when(c.startswith('"'), F.array(F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v"))).otherwise(F.when(c.isNotNull() & ~c.startswith("{"), F.array(c)))


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """``id, name, user_message, routings, modes`` of scenarios whose expectations may be strings or lists."""
    kind = "scenarios array<struct<id: string, name: string, preconditions: string, user_message: string, expected_routing: string, expected_mode: string, notes: string>>"
    rows = spark.read.schema(kind).json(path, multiLine=True).select(F.explode("scenarios").alias("s")).select("s.*")
    return rows.select("id", "name", "user_message", as_list(F.col("expected_routing")).alias("routings"), as_list(F.col("expected_mode")).alias("modes"))


def violations(scenarios: DataFrame) -> DataFrame:
    """``id, problem``: missing or repeated ids, missing messages, missing expectations."""
    repeated = scenarios.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("problem"))
    empty = lambda c: F.coalesce(F.btrim(c), F.lit("")) == ""
    each = F.array_compact(F.array(F.when(empty("id"), "no id"), F.when(empty("user_message"), "no message"), F.when(F.coalesce(F.size("routings"), F.lit(0)) <= 0, "no routing"), F.when(F.coalesce(F.size("modes"), F.lit(0)) <= 0, "no mode")))
    return scenarios.select("id", F.explode(each).alias("problem")).unionByName(repeated)


def matches(got: Column, expected: Column) -> Column:
    """Whether a value is among the expected ones; true without expectation."""
    return expected.isNull() | F.coalesce(F.array_contains(expected, got), F.lit(False))


def append_log(rows: DataFrame, path: str, most: int = MOST_LOGGED) -> None:
    """Appends rows to a log as JSON lines, each cut at ``most`` characters."""
    rows.select(F.substring(F.to_json(F.struct(*rows.columns)), 1, most).alias("value")).write.mode("append").text(path)
