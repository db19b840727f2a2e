"""Queries over routing, follow-ups and conversations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import queries as Q
from ..operators import chat as C
from ..session import strip_blanks, table
from .text_queries import ASKED, asked, has_sql, intents_sql, lit, query_sql

BLANK = "' ' || chr(9) || chr(10) || chr(13)"
# The same limits, terms and boosts as the operators', written out on their own.
_TERMS = "('rag','ml','llm','nlp','sql','api','aws','etl','gpu','cpu','cdn','http','https','json','xml','csv','pdf','gpt')"
_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")


def _all(s, d):
    """Evaluation questions, chat requests and the users' chat messages as normalised queries."""
    said = C.messages(table(s, d, "chat_messages")).where("role = 'user' and content is not null").select(F.concat(F.lit("m"), F.col("id")).alias("query_id"), F.col("content").alias("text"))
    return asked(s, d).unionByName(said).select("query_id", Q.normalize_query(F.col("text")).alias("q"))


ALL = (
    f"{ASKED}, um AS (SELECT DISTINCT ON (id) id, lower(trim(role, {BLANK})) AS role, content FROM chat_messages WHERE id IS NOT NULL), "
    f"n AS (SELECT query_id, {query_sql('text')} AS q FROM (SELECT * FROM asked UNION ALL SELECT 'm' || id, content FROM um WHERE role = 'user' AND content IS NOT NULL))"
)


def routing_flags(s, d):
    q = _all(s, d)
    return q.select("query_id", *[f(F.col("q")).alias(n) for n, f in Q.ROUTING.items()], C.is_short_deictic(F.col("q")).alias("short_deictic"))


def _routing_sql() -> str:
    h = lambda p: has_sql("q", p)
    of = {
        "asks_for_file": h(Q.METADATA_QUESTION), "asks_about_document": h(Q.ABOUT_DOCUMENT), "asks_for_contact": h("(details|contact|more\\s+info|information|what\\s+else)"),
        "expands": h("^\\s*(tell\\s+me\\s+more|continue|details|elaborate|more\\s+details|expand|what\\s+else|more|further)\\s*[!.?]*\\s*$"), "confirms": h("^\\s*(yes|yeah|yep|yup|ok|okay|sure|go\\s+on|continue)\\s*[!.?]*\\s*$"),
        "wants_blended_web": f"(NOT {intents_sql('q')['entity_lookup']} AND NOT {h('\\b(technologies|technology\\s+stack|projects?\\s+mentioned|employees|headcount|workforce)\\b')} AND {h('\\b(today|latest|news|current|recent|price|stock|market|weather|breaking|who is|who was|when did|2024|2025|2026)\\b')})",
        "short_deictic": f"(length(q) <= 88 AND {h(C.DEICTIC)})",
    }
    return f"WITH {ALL} SELECT query_id, {', '.join(f'{v} AS {k}' for k, v in of.items())} FROM n"


def follow_ups(s, d):
    q, forced = _all(s, d), F.pmod(F.length("q"), F.lit(2)) == 0
    return q.select("query_id", C.is_follow_up(F.col("q")).alias("follow_up"), C.expects_documents_in_turn(F.col("q"), forced).alias("expects_documents"))


def _follow_sql() -> str:
    h = lambda p: has_sql("q", p)
    of = intents_sql("q")
    term = r"^\s*what\s+is\s+([A-Za-z][A-Za-z0-9\-]{1,32})\s*\??\s*$"
    anchors = " OR ".join(h(p) for p in (
        r"\b(his|her|their|its|he|she|they|him)\b",
        r"\b(the|this|my|that|your)\s+(loan|application|file|document|upload|library|amount|balance|name|number|address|city|email|phone|record|policy|packet|form|memo|brief|playbook)\b",
        r"\b(my|your)\s+(loan|file|document|application|upload|policy|library)\b",
    ))
    starts = h(r"^\s*(what|who|when|where|which|how|did|does|do|is|are|was|were|can|could|would)\b")
    general = h(r"^\s*what\s+is\s+(rag\b|retrieval[-\s]?augmented\s+generation|embeddings?\b|vector\s+database|vectordb|llm\b|large\s+language\s+model)\s*\??\s*$")
    bypass = f"({of['assistant_identity']} OR {of['short_concept']})"
    goes_on = (
        f"{' OR '.join(h(p) for p in C.FOLLOW_UPS)} OR {h(Q.METADATA_QUESTION)} OR ({h(r'\b(address|street|zip|postal|location)\b')} AND length(q) < 160) OR ({h(r'\b(include|included|mention|mentions|list|lists)\b')} AND length(q) < 180) "
        f"OR (length(q) <= 72 AND {h(term)} AND regexp_extract(lower(q), {lit(term)}, 1, 'i') NOT IN {_TERMS}) OR (length(q) <= 100 AND {starts} AND ({anchors}))"
    )
    return f"WITH {ALL} SELECT query_id, q <> '' AND NOT {bypass} AND NOT {general} AND ({goes_on}) AS follow_up, NOT {bypass} AND ({of['expects_documents']} OR length(q) % 2 = 0) AS expects_documents FROM n"


def expansion(s, d):
    q = _all(s, d)
    return q.select("query_id", Q.field_query(F.col("q")).alias("retrieval_query"), Q.wider_query(F.col("q")).alias("wider_query"), Q.section_number(F.col("q")).alias("section"))


def _expansion_sql() -> str:
    of = intents_sql("q")
    kind = " OR ".join(has_sql("q", p) for _, p in Q.FIELD_KINDS)
    first = f"CASE WHEN {kind} THEN q || ' Full Name Email Phone Website Contact Address' ELSE q END"
    words = " ".join(f"WHEN contains(q, 'section') AND {has_sql('q', f'\\b{w}\\b')} THEN '{i}'" for i, w in enumerate(_WORDS, 1))
    return (
        f"WITH {ALL}, f AS (SELECT query_id, q, {first} AS r, {of['broad_overview']} AS broad, {of['relaxed_gate']} AS relaxed, {of['section_navigation']} AS section FROM n) SELECT query_id, r AS retrieval_query, "
        "CASE WHEN relaxed OR section THEN r || ' main sections themes introduction conclusion purpose overview key ideas summary' || CASE WHEN relaxed AND NOT broad THEN ' performance latency p99 workload reliability metrics discussion' ELSE '' END || CASE WHEN section AND NOT broad THEN ' section heading chapter appendix subsection disaster recovery' ELSE '' END END AS wider_query, "
        f"CASE WHEN regexp_matches(q, 'section\\s*(?:#|number|num\\.?)?\\s*(\\d+)\\b') THEN regexp_extract(q, 'section\\s*(?:#|number|num\\.?)?\\s*(\\d+)\\b', 1) {words} END AS section FROM f"
    )


def turn_sources(s, d):
    """The source that dominates each turn's hits, as a conversation would carry it on."""
    names = table(s, d, "hits").where("turn_id is not null").select(F.col("turn_id").alias("session_id"), F.col("rank").alias("position"), "source_name", "chunk_id").distinct()
    return C.dominant_name(names).select(F.col("session_id").alias("turn_id"), "source_name")


SOURCES_SQL = (
    "WITH h AS (SELECT DISTINCT turn_id, rank, source_name, chunk_id FROM hits WHERE turn_id IS NOT NULL), c AS (SELECT turn_id, trim(source_name) AS source_name, count(*) AS n, min(rank) AS first FROM h WHERE coalesce(trim(source_name), '') <> '' GROUP BY ALL), "
    "b AS (SELECT *, max(n) OVER (PARTITION BY turn_id) AS most, count(*) OVER (PARTITION BY turn_id) AS k, row_number() OVER (PARTITION BY turn_id ORDER BY n DESC, first) AS r FROM c) SELECT turn_id, source_name FROM b WHERE r = 1 AND (most > 1 OR k <= 3)"
)


def session_titled(s, d):
    return C.titled(table(s, d, "chat_sessions").where("id is not null").select("id", "title").distinct(), table(s, d, "chat_messages")).select("id", "title")


TITLED_SQL = (
    f"WITH m AS (SELECT DISTINCT ON (id) id, lower(trim(session_id, {BLANK})) AS s, lower(trim(role, {BLANK})) AS role, content FROM chat_messages WHERE id IS NOT NULL), t AS (SELECT s, trim(content)[1:80] AS t FROM m WHERE role = 'user' AND trim(content) <> '' QUALIFY row_number() OVER (PARTITION BY s ORDER BY id) = 1) "
    f"SELECT c.id, coalesce(nullif(trim(title), ''), t.t) AS title FROM (SELECT DISTINCT id, title FROM chat_sessions WHERE id IS NOT NULL) c LEFT JOIN t ON t.s = lower(trim(c.id, {BLANK}))"
)


def session_touch(s, d):
    """Sessions after the newest message of each has been appended again: when each was last touched."""
    sessions, messages = table(s, d, "chat_sessions").where("id is not null"), table(s, d, "chat_messages")
    new = messages.where("id is not null and session_id is not null").select((F.col("id") + 10_000_000).alias("id"), "session_id", "role", "content", "extra_json", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("at")).distinct()
    touched, _ = C.appended(sessions, messages, new)
    return touched.groupBy(F.lower(strip_blanks("id")).alias("session_id")).agg(F.max(F.unix_timestamp("updated_at")).alias("touched"))


TOUCH_SQL = (
    f"WITH a AS (SELECT lower(trim(session_id, {BLANK})) AS s, max(1700000000 + id) AS at FROM chat_messages WHERE id IS NOT NULL AND session_id IS NOT NULL GROUP BY 1) "
    f"SELECT lower(trim(c.id, {BLANK})) AS session_id, max(greatest(floor(epoch(c.updated_at))::BIGINT, a.at)) AS touched FROM chat_sessions c LEFT JOIN a ON a.s = lower(trim(c.id, {BLANK})) WHERE c.id IS NOT NULL GROUP BY 1"
)

QUERIES = {
    "routing_flags": (routing_flags, _routing_sql()), "follow_ups": (follow_ups, _follow_sql()), "query_expansion": (expansion, _expansion_sql()), "turn_sources": (turn_sources, SOURCES_SQL), "session_titled": (session_titled, TITLED_SQL), "session_touch": (session_touch, TOUCH_SQL),
}
