"""Document tasks (summarize, extract, compare): their default queries, scopes, contexts and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranking

# What a task without a request of its own looks for, and when its coverage is only partial.
DEFAULTS = {"summarize": "main themes key points sections overview", "extract": "deadlines action items requirements decisions entities", "compare": "differences similarities changes across documents"}
FAR, DEPTH = 1.38, 28
NONE_NOTE = "No passage of that file was found; try another file or all documents."
FILE_NOTE, LIBRARY_NOTE = "The summary uses passages of that file; it may not cover all of it.", "The summary uses passages from across the library; it may not cover all of it."


def task_query(task: Column, text: Column) -> Column:
    """The retrieval query of a task: the request, or the task's default."""
    out = F.lit("document")
    for name, default in DEFAULTS.items():
        out = F.when(task == name, F.lit(default)).otherwise(out)
    return F.coalesce(F.nullif(F.btrim(text), F.lit("")), out)


def scope_query(scope: Column) -> Column:
    """The query of the second look into one file."""
    return F.concat(F.lit("content sections text from "), scope)


def contexts(first: DataFrame, second: DataFrame, tasks: DataFrame, vectors: int, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """What each task reads: rows of hits with ``context_order``, and ``query_id, note``.

    ``tasks(query_id, task, scope, top_k)``; ``first`` and ``second`` are reranked hits (``query_id, chunk_id, source_name,
    distance, rrf_score, rerank_order``). A summary of one file (``scope``, in any case; blank or ``all`` is the library)
    keeps that file's hits; where they are fewer than three to five the second look's are put behind them, each chunk
    once. Chunks without id are told apart by their first 40 characters. A query's hits are bounded by its pools.
    """
    scope = F.lower(F.btrim(F.coalesce("scope", F.lit(""))))
    t = tasks.select("query_id", "task", "top_k", F.when((F.col("task") == "summarize") & ~scope.isin("", "all"), scope).alias("_scope"))
    inside = F.col("_scope").isNull() | (F.lower(F.btrim("source_name")) == F.col("_scope"))
    own = first.join(t, "query_id").where(inside).withColumn("_look", F.lit(0))
    few = t.join(own.groupBy("query_id").agg(F.count("*").alias("_c")), "query_id", "left").where(F.col("_scope").isNotNull() & (F.coalesce("_c", F.lit(0)) < F.greatest(F.lit(3), F.least(F.lit(5), F.col("top_k"))))).drop("_c")
    more = second.join(few, "query_id").where(inside).withColumn("_look", F.lit(1))
    key = F.coalesce(F.nullif("chunk_id", F.lit("")), F.substring(F.coalesce(F.col(text), F.lit("")), 1, 40))
    once = own.unionByName(more).withColumn("_n", F.row_number().over(Window.partitionBy("query_id", key).orderBy("_look", "rerank_order"))).where("_n = 1")
    ordered = once.withColumn("task_order", F.row_number().over(Window.partitionBy("query_id").orderBy("_look", "rerank_order", "chunk_id")) - 1).drop("_n", "_look")
    limit = ranking.context_limit(F.col("task"), F.col("top_k"), F.lit(vectors), F.lit(False))
    strong = ranking.drop_weak(ordered, "task_order")
    context = strong.withColumn("context_order", F.row_number().over(Window.partitionBy("query_id").orderBy("task_order"))).where(F.col("context_order") <= limit)
    top = ordered.where("task_order = 0").select("query_id", F.col("distance").alias("_d"))
    far = F.coalesce("_d", F.lit(ranking.NO_VECTOR)) > FAR
    note = F.when(F.col("task") != "summarize", None).when(F.col("_scope").isNotNull() & F.col("_seen").isNull(), NONE_NOTE).when(far & F.col("_seen").isNotNull(), F.when(F.col("_scope").isNotNull(), FILE_NOTE).otherwise(LIBRARY_NOTE))
    notes = t.join(top.withColumn("_seen", F.lit(True)), "query_id", "left").select("query_id", note.alias("note"))
    return context, notes
