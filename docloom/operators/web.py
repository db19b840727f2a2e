"""Web snippets: query shaping, URL identity, cleaning, scoring and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.queries import TIME_SENSITIVE, has
from ..functions.text import collapse

# Words that do not count in scores, leading phrases of questions, and phrases of page furniture.
STOP = ("the", "and", "for", "are", "was", "what", "when", "how", "why", "this", "that")
LEADING = r"^(please|can you|could you|tell me|i want to know|i need to know|help me)\s+"
BOILERPLATE = r"\b(read more|click here|sign up|subscribe|cookie policy|privacy policy)\b[^.]*\.?"
REPEATED = r"(\b[\w\s,]{12,60}\b)(\.\s*\1)+"


def shape(question: Column, rewritten: Column, year: int) -> Column:
    """A short search query: leading phrases dropped, the rewrite for long questions, the year for timely ones."""
    q, r = F.btrim(question), F.btrim(F.coalesce(rewritten, question))
    base = F.regexp_replace(q, "(?i)" + LEADING, "")
    base = F.when(base == "", r).otherwise(base)
    n = F.char_length(base)
    base = F.when((n > 160) & (F.char_length(r) <= 160), r).when(n > 200, F.regexp_replace(F.substring(base, 1, 200), r" [^ ]*$", "")).otherwise(base)
    base = collapse(base)
    dated = has(q, TIME_SENSITIVE) & ~has(base, r"\b20[2-3]\d\b")
    return F.substring(F.when(dated, F.concat(base, F.lit(f" {year}"))).otherwise(base), 1, 220)


def identity(url: Column) -> Column:
    """Host and path without ``www.``, scheme, query and closing slashes; empty for what is no web address."""
    u = F.regexp_replace(F.btrim(F.coalesce(url, F.lit(""))), r"[).,\]]+$", "")
    u = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)
    rest = F.regexp_replace(F.regexp_extract(u, r"^https?://([^?#]*)", 1), r"/+$", "")
    return F.lower(F.regexp_replace(rest, r"(?i)^www\.", ""))


def terms(query: Column) -> Column:
    """Distinct words of three and more characters without stop words."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0)), lambda t: ~t.isin(*STOP)))


def clean(text: Column, most: int = 280, repeats: bool = True) -> Column:
    """Snippet text on one line without page furniture and repeated sentences, cut at a word."""
    t = F.regexp_replace(collapse(F.coalesce(text, F.lit(""))), "(?i)" + BOILERPLATE, " ")
    if repeats:
        t = F.regexp_replace(t, "(?i)" + REPEATED, "$1")
    t = collapse(t)
    cut = F.when(F.substring(t, 1, most + 1).contains(" "), F.regexp_replace(F.substring(t, 1, most), r" [^ ]*$", "")).otherwise(F.substring(t, 1, most + 1))
    return F.when(F.char_length(t) <= most, t).otherwise(F.concat(F.regexp_replace(cut, r"[,;:]+$", ""), F.lit("…")))


def candidate_score(title: Column, snippet: Column, words: Column) -> Column:
    """Words found, lengths up to a bound, and deductions for thin or empty parts."""
    t, s = F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))
    blob = F.lower(F.concat(t, F.lit(" "), s))
    found = 1.1 * F.size(F.filter(words, lambda w: blob.contains(w)))
    n, m = F.char_length(s), F.char_length(t)
    return (
        found + F.least(n, F.lit(320)) / 320 * 2.4 + F.least(m, F.lit(72)) / 72 * 1.2 - F.when(n < 32, 2.5).otherwise(0.0) - F.when(m < 6, 0.8).otherwise(0.0)
        - F.when(F.regexp_like(t, F.lit(r"^[^\p{L}]+$")), 3.0).otherwise(0.0) - F.when(F.btrim(s).isin("", "..."), 4.0).otherwise(0.0)
    )


def rank_snippets(candidates: DataFrame, keep: int, repeats: bool = True) -> DataFrame:
    """``query_id, url, title, snippet, score, rank`` of ``candidates(query_id, query, arrival, title, url, snippet)``.

    The first of a page's copies counts, by arrival and before any judgement; thin low scores and empty snippets are
    dropped; ties keep the order of arrival.
    """
    scored = candidates.withColumn("_id", identity(F.col("url"))).where("_id <> ''")
    first = scored.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "_id").orderBy("arrival"))).where("_n = 1")
    judged = first.withColumn("score", candidate_score(F.col("title"), F.col("snippet"), terms(F.col("query")))).where(~((F.col("score") < 0.35) & (F.char_length(F.coalesce("snippet", F.lit(""))) < 40)))
    title = F.when(F.btrim(F.coalesce("title", F.lit(""))) == "", F.btrim("url")).otherwise(F.btrim("title"))
    cleaned = judged.select("query_id", "arrival", F.btrim("url").alias("url"), title.alias("title"), clean(F.col("snippet"), repeats=repeats).alias("snippet"), "score").where(~((F.col("snippet") == "") & (F.char_length("title") < 10)))
    return cleaned.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "arrival"))).where(F.col("rank") <= keep)


def strong_enough(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, strong``: whether any kept snippet is worth citing."""
    s = candidate_score(F.col("title"), F.col("snippet"), terms(F.col("query"))) + F.when(F.char_length("snippet") >= 52, 0.35).otherwise(0.0)
    return queries.join(ranked, "query_id", "left").groupBy("query_id").agg(F.coalesce(F.max(s >= 1.2), F.lit(False)).alias("strong"))


def unlink(answer: Column, allowed: Column) -> Column:
    """Markdown links whose page is not among ``allowed`` identities replaced by their text (or address)."""
    parts = F.regexp_extract_all(answer, F.lit(r"(\[[^\]]*\]\([^)]+\))"), F.lit(1))
    text, url = lambda p: F.btrim(F.regexp_extract(p, r"^\[([^\]]*)\]", 1)), lambda p: F.regexp_extract(p, r"\(([^)]+)\)$", 1)
    def replaced(a, p):
        return F.when(F.array_contains(allowed, identity(url(p))) & (identity(url(p)) != ""), a).otherwise(F.replace(a, p, F.when(text(p) == "", url(p)).otherwise(text(p))))
    return F.aggregate(F.array_distinct(parts), answer, replaced)


def formatted(ranked: DataFrame) -> DataFrame:
    """``query_id, block``: numbered web blocks of each query's kept snippets (bounded by ``keep``)."""
    block = F.concat(F.lit("[WEB "), F.col("rank"), F.lit("] "), F.col("title"), F.lit("\n"), F.col("url"), F.lit("\n"), F.col("snippet"))
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("block"))
