"""Queries over texts and query strings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import queries as Q
from ..functions import text as T
from ..operators import index as I
from ..session import table

SP = r"[ \t\n\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
IN = SP.replace(r"\n", "")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def segments(s: SparkSession, d: str) -> DataFrame:
    """One row for each segment with text."""
    return table(s, d, "segments").where("document_id is not null and text is not null").dropDuplicates(["document_id"])


def repeated(s: SparkSession, d: str) -> DataFrame:
    """Segments with text as they are stored. Repeated rows carry the same text, so results are made unique, not texts:
    no text is shuffled."""
    return table(s, d, "segments").where("document_id is not null and text is not null")


def asked(s: SparkSession, d: str) -> DataFrame:
    """Evaluation questions and chat requests as ``query_id, text``."""
    items = table(s, d, "eval_items").select(F.concat(F.lit("i"), F.col("item_id")).alias("query_id"), F.col("query").alias("text"))
    turns = table(s, d, "chat_turns").dropDuplicates(["turn_id"]).select(F.concat(F.lit("t"), F.col("turn_id")).alias("query_id"), F.col("message").alias("text"))
    return items.unionByName(turns).where("query_id is not null and text is not null")


ASKED = "asked AS (SELECT 'i' || item_id AS query_id, query AS text FROM eval_items WHERE item_id IS NOT NULL AND query IS NOT NULL UNION ALL SELECT 't' || turn_id, message FROM (SELECT DISTINCT turn_id, message FROM chat_turns) WHERE turn_id IS NOT NULL AND message IS NOT NULL)"
SEGMENTS = "seg AS (SELECT DISTINCT document_id, source_name, file_type, page_number, text FROM segments WHERE document_id IS NOT NULL AND text IS NOT NULL)"


def collapse_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, {lit(SP + '+')}, ' ', 'g'))"


def normalize_sql(c: str) -> str:
    t = f"regexp_replace({c}, '\\r\\n?', chr(10), 'g')"
    t = f"regexp_replace({t}, {lit(IN + '+')}, ' ', 'g')"
    t = f"regexp_replace({t}, ' ?\\n ?', chr(10), 'g')"
    t = f"regexp_replace({t}, '\\n{{2,}}', chr(10) || chr(10), 'g')"
    return f"trim({t}, ' ' || chr(10))"


def query_sql(c: str) -> str:
    q = f"lower({collapse_sql(c)})"
    for pattern, to in Q.PHRASES:
        q = f"regexp_replace({q}, {lit(pattern)}, {lit(to)}, 'g')"
    for a, b in Q.TYPOS:
        q = f"replace({q}, {lit(a)}, {lit(b)})"
    for pattern, to in Q.NEAR_MISSES:
        q = f"regexp_replace({q}, {lit(pattern)}, {lit(to)}, 'g')"
    return collapse_sql(q)


def has_sql(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {lit(pattern)}, 'i')"


def intents_sql(q: str) -> dict[str, str]:
    h = lambda p: has_sql(q, p)
    n = f"length({q})"
    identity = f"({n} >= 3 AND {h(Q.ASSISTANT_IDENTITY)})"
    concept = f"({n} <= 120 AND {h(Q.SHORT_CONCEPT)})"
    expects = f"({n} >= 4 AND NOT ({identity} OR {concept}) AND (({n} <= 160 AND {h(Q.STRUCTURED_FIELD)}) OR {h(Q.DOCUMENT_SCOPE)}))"
    broad = f"({n} >= 4 AND ({h(Q.SUMMARIZE_ALONE)} OR ({n} >= 6 AND {h(Q.BROAD_OVERVIEW)})))"
    relaxed = f"({broad} OR ({n} >= 10 AND ({h(Q.COMPANY_QUESTION)} OR {h(Q.PROJECT_QUESTION)} OR {h(Q.TECHNOLOGY_QUESTION)} OR ({h(Q.PERFORMANCE_WORDS)} AND {h(Q.VAGUE_DISCUSSION)}))))"
    lookup = f"({n} >= 10 AND NOT {h(Q.LOOKUP_NEGATIVE)} AND ({h(Q.WH_START)} OR {h(Q.LOOKUP_ASK)}) AND {h(Q.ENTITY_LOOKUP)})"
    section = f"({n} >= 12 AND ({' OR '.join(h(p) for p in Q.SECTION_PATTERNS)} OR (contains({q}, 'section') AND {h(Q.SECTION_NUMBER_WORD)}) OR (contains({q}, 'disaster') AND contains({q}, 'recover'))))"
    words = f"len(string_split({q}, ' '))"
    explains = h(r"\b(why|how|explain|compare|summarize|difference)\b")
    skips = f"({n} < 8 OR ({n} <= 52 AND {words} <= 6) OR ({n} <= 80 AND NOT contains({q}, '?') AND {words} <= 12) OR ({n} <= 36 AND NOT {explains}))"
    fast = f"({n} BETWEEN 4 AND 220 AND NOT {expects})"
    return {"assistant_identity": identity, "short_concept": concept, "expects_documents": expects, "broad_overview": broad, "relaxed_gate": relaxed, "entity_lookup": lookup, "section_navigation": section, "skips_rewrite": skips, "fast_path": fast}


def normalized_text(s, d):
    t = T.normalize_text(F.col("text"))
    return repeated(s, d).select("document_id", F.sha2(t.cast("binary"), 256).alias("sha"), F.char_length(t).cast("long").alias("chars"), (F.size(F.split(t, "\n\n"))).cast("long").alias("blocks")).dropDuplicates(["document_id"])


def hyphen_repair(s, d):
    t = T.repair_hyphens(T.normalize_text(F.col("text")))
    return repeated(s, d).where("file_type = 'pdf'").select("document_id", F.char_length(t).cast("long").alias("chars"), F.sha2(t.cast("binary"), 256).alias("sha")).dropDuplicates(["document_id"])


def query_normalize(s, d):
    return asked(s, d).select("query_id", Q.normalize_query(F.col("text")).alias("query"))


def intent_flags(s, d):
    q = asked(s, d).select("query_id", Q.normalize_query(F.col("text")).alias("q"))
    return q.select("query_id", *[f(F.col("q")).alias(n) for n, f in Q.INTENTS.items()], Q.field_kind(F.col("q")).alias("field_kind"))


def query_keywords(s, d):
    return asked(s, d).select("query_id", F.array_join(T.keywords(F.col("text")), " ").alias("keywords"))


def tokenize_stats(s, d):
    t = T.tokens(F.col("text"))
    rows = table(s, d, "chunks").where("chunk_id is not null and text is not null")
    return rows.select("chunk_id", F.size(t).cast("long").alias("tokens"), F.size(F.array_distinct(t)).cast("long").alias("distinct_tokens"), F.size(T.content_tokens(F.col("text"))).cast("long").alias("content_tokens")).dropDuplicates(["chunk_id"])


def snippets(s, d):
    t = F.col("text")
    return repeated(s, d).select(
        "document_id", T.snippet(t).alias("snippet"), T.source_label(F.col("source_name"), F.col("page_number")).alias("label"), T.path_hint(F.coalesce("file_path", F.lit(""))).alias("file"), T.html_note(F.substring(T.normalize_line(t), 1, 80)).alias("note")
    ).dropDuplicates(["document_id"])


def evidence_windows(s, d):
    """The part of each hit's chunk that a prompt would show for its request."""
    hits = table(s, d, "hits").where("turn_id is not null and chunk_id is not null").select("turn_id", "chunk_id").distinct()
    turns = table(s, d, "chat_turns").dropDuplicates(["turn_id"]).select("turn_id", "message")
    chunks = I.stored(table(s, d, "chunks")).select("chunk_id", "text")
    w = T.window_around(F.col("text"), F.col("message"), 300)
    return hits.join(turns, "turn_id").join(chunks, "chunk_id").select("turn_id", "chunk_id", F.sha2(w.cast("binary"), 256).alias("window_sha"), F.char_length(w).cast("long").alias("chars"))


FUNCTION_STOP = "[" + ", ".join(lit(w) for w in T.STOP_WORDS) + "]"
KEYWORD_STOP = "[" + ", ".join(lit(w) for w in [*T.STOP_WORDS, *T.POSSESSIVES]) + "]"
DISTINCT_IN_ORDER = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def keywords_sql(c: str) -> str:
    found = f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9]{{3,}}'), lambda x: NOT list_contains({KEYWORD_STOP}, x))"
    return f"({DISTINCT_IN_ORDER.format(found)})[1:8]"


STORED = "stored AS (SELECT DISTINCT ON (chunk_id) * FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL)"

QUERIES = {
    "normalized_text": (normalized_text, f"WITH {SEGMENTS}, n AS (SELECT document_id, {normalize_sql('text')} AS t FROM seg) SELECT document_id, sha256(t) AS sha, length(t) AS chars, len(string_split(t, chr(10) || chr(10))) AS blocks FROM n"),
    "hyphen_repair": (hyphen_repair, f"WITH {SEGMENTS}, n AS (SELECT document_id, regexp_replace({normalize_sql('text')}, '([\\pL\\pN_])-\\n([\\pL\\pN_])', '\\1\\2', 'g') AS t FROM seg WHERE file_type = 'pdf') SELECT document_id, length(t) AS chars, sha256(t) AS sha FROM n"),
    "query_normalize": (query_normalize, f"WITH {ASKED} SELECT query_id, {query_sql('text')} AS query FROM asked"),
    "intent_flags": (
        intent_flags,
        f"WITH {ASKED}, n AS (SELECT query_id, {query_sql('text')} AS q FROM asked) SELECT query_id, {', '.join(f'{v} AS {k}' for k, v in intents_sql('q').items())}, CASE {' '.join(f'WHEN {has_sql('q', p)} THEN {lit(k)}' for k, p in Q.FIELD_KINDS)} END AS field_kind FROM n",
    ),
    "query_keywords": (query_keywords, f"WITH {ASKED} SELECT query_id, coalesce(array_to_string({keywords_sql('text')}, ' '), '') AS keywords FROM asked"),
    "tokenize_stats": (
        tokenize_stats,
        f"WITH {STORED}, t AS (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS a, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')), lambda x: NOT list_contains({FUNCTION_STOP}, x)) AS c FROM stored) SELECT chunk_id, len(a) AS tokens, len(list_distinct(a)) AS distinct_tokens, len(c) AS content_tokens FROM t",
    ),
    "snippets": (
        snippets,
        f"WITH {SEGMENTS}, n AS (SELECT s.document_id, s.source_name, s.page_number, {collapse_sql('s.text')} AS t, p.file_path FROM seg s JOIN (SELECT document_id, max(file_path) AS file_path FROM segments WHERE text IS NOT NULL GROUP BY 1) p USING (document_id)) "
        "SELECT document_id, CASE WHEN length(t) <= 220 THEN t ELSE rtrim(t[1:219]) || '…' END AS snippet, "
        "(CASE WHEN b = '' THEN 'Source' ELSE b END) || (CASE WHEN page_number IS NULL THEN '' ELSE ' · p.' || page_number END) AS label, string_split(coalesce(file_path, ''), '/')[-1] AS file, "
        "replace(replace(replace(replace(replace(t[1:80], '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS note "
        "FROM (SELECT *, regexp_replace(trim(coalesce(source_name, '')), '\\.(pdf|txt|docx)$', '', 'i') AS b FROM n)",
    ),
    "evidence_windows": (evidence_windows, None),
}
