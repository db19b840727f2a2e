"""Source references, numbered context and prompts for an optional model behind the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_line, snippet, source_label, window_around

RULES = (
    "Answer only from the numbered sources below and cite them as [SOURCE n]. If they do not tell, say so."
)


def page_label(page: Column) -> Column:
    return F.coalesce(page.cast("string"), F.lit("N/A"))


def source_refs(context: DataFrame) -> DataFrame:
    """``query_id, sources``: each query's chunks in order of ``context_order`` (from 1) as numbered references.

    A query's context is bounded by its limit.
    """
    ref = F.struct(
        F.col("context_order").alias("source_number"), "chunk_id", "source_name", page_label(F.col("page_number")).alias("page_label"), "file_path", source_label(F.col("source_name"), F.col("page_number")).alias("source_label"), snippet(F.col("text")).alias("snippet")
    )
    return context.groupBy("query_id").agg(F.array_sort(F.collect_list(ref)).alias("sources"))


def context_blocks(context: DataFrame, query: str = "query", most: int = 2000) -> DataFrame:
    """``query_id, context``: numbered source blocks with the part of each text that the query is about."""
    block = F.concat(
        F.lit("[SOURCE "), F.col("context_order"), F.lit("] "), F.coalesce("source_name", F.lit("")), F.lit(" · p."), page_label(F.col("page_number")), F.lit("\nText:\n"), window_around(F.col("text"), F.col(query), most)
    )
    return context.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("context_order", block.alias("b")))), lambda x: x["b"]), "\n\n---\n\n").alias("context"))


# What the builders say; the wording is this engine's own.
TASKS = {
    "summarize": "Summarise the sources for the reader in a few paragraphs and cite each as [SOURCE n].",
    "extract": "List what the request asks for, one item a line, each with its [SOURCE n]; leave out what no source tells.",
    "compare": "Compare what the sources say on the request, first in short, then point by point, each with its [SOURCE n].",
}
SECTION_NOTE = "The question is for a named section: a single line that names it is an answer."
SUMMARY_NOTE = "The question is for an overview: tell what the sources are about, not how they are laid out."
SEVERAL_NOTE = "Several sources are given: use every one that bears on the question."
WEB_RULES = "Answer only from the web snippets below and link every claim."
BLENDED_RULES = "Answer from the numbered sources first and cite them as [SOURCE n]; use web snippets only for what they lack, and link those claims."
GENERAL_RULES = "Answer briefly from general knowledge, and say that the library was not used."
ABSTAIN_RULES = "The library does not tell. Say so, and offer what could be asked or added instead."


def _pair(rules: Column, body: Column) -> Column:
    of = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(of("system", rules), of("user", body))


def messages(context: Column, query: Column, sources: Column | None = None, section: Column | None = None, broad: Column | None = None) -> Column:
    """Chat messages for a grounded answer: the rules and what the question needs besides, then context and question."""
    no = F.lit(False)
    section, broad, sources = section if section is not None else no, broad if broad is not None else no, sources if sources is not None else F.lit(1)
    rules = F.concat_ws("\n", F.lit(RULES), F.when(section, F.lit(SECTION_NOTE)), F.when(broad & ~section, F.lit(SUMMARY_NOTE)), F.when(sources >= 2, F.lit(SEVERAL_NOTE)))
    return _pair(rules, F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), query))


def task_messages(task: Column, context: Column, query: Column) -> Column:
    """Chat messages for a document task (``summarize``, ``extract``, ``compare``); null for another."""
    rules = F.lit(None).cast("string")
    for name, text in TASKS.items():
        rules = F.when(task == name, F.lit(text)).otherwise(rules)
    return F.when(rules.isNotNull(), _pair(rules, F.concat(F.lit("Context:\n"), context, F.lit("\n\nRequest: "), query)))


def web_messages(web: Column, query: Column) -> Column:
    return _pair(F.lit(WEB_RULES), F.concat(F.lit("Web:\n"), web, F.lit("\n\nQuestion: "), query))


def blended_messages(context: Column, web: Column, query: Column) -> Column:
    return _pair(F.lit(BLENDED_RULES), F.concat(F.lit("Context:\n"), context, F.lit("\n\n---\n\nWeb:\n"), web, F.lit("\n\nQuestion: "), query))


def general_messages(query: Column) -> Column:
    return _pair(F.lit(GENERAL_RULES), query)


def abstain_messages(query: Column) -> Column:
    return _pair(F.lit(ABSTAIN_RULES), query)


def payload(mode: Column, text: Column, sources: Column, note: Column, web: Column | None = None) -> Column:
    """A turn as a client shows it: ``mode, text, grounded, sources, note, web``; only grounded and blended turns carry sources,
    only web and blended ones web snippets."""
    none = F.lit(None)
    own = mode.isin("grounded", "blended")
    return F.struct(
        mode.alias("mode"), F.coalesce(text, F.lit("")).alias("text"), own.alias("grounded"), F.when(own, sources).alias("sources"), F.nullif(F.btrim(note), F.lit("")).alias("note"), F.when(mode.isin("web", "blended"), web if web is not None else none.cast("string")).alias("web"),
    )


def hit_rows(hits: DataFrame, text: str = "text", order: str = "rank", most: int = 8, preview: int = 120) -> DataFrame:
    """The first hits of each query with the start of their text, for a view of what was found."""
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "chunk_id"))
    return hits.withColumn("_n", at).where(F.col("_n") <= most).select(
        "query_id", F.col("_n").alias("place"), "chunk_id", "source_name", page_label(F.col("page_number")).alias("page_label"), F.round("distance", 4).alias("distance"), F.round("rrf_score", 6).alias("rrf_score"), F.substring(normalize_line(F.col(text)), 1, preview).alias("preview")
    )
