"""Queries over extraction, answers, web candidates, the library, chats and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import queries as Q
from ..functions import text as T
from ..operators import answers as A
from ..operators import chat as C
from ..operators import chunker
from ..operators import extract as E
from ..operators import library as L
from ..operators import ranking as R
from ..operators import web as W
from ..session import table
from .retrieval_queries import HITS, hits
from .text_queries import FUNCTION_STOP, SEGMENTS, SP, asked, collapse_sql, lit, repeated

BLANK = "' ' || chr(9) || chr(10) || chr(13)"
TURNS = "t AS (SELECT DISTINCT ON (turn_id) * FROM chat_turns WHERE turn_id IS NOT NULL ORDER BY turn_id)"


def turns(s, d):
    return table(s, d, "chat_turns").where("turn_id is not null").dropDuplicates(["turn_id"])


# --- extraction ---


def field_values(s, d):
    return E.first_fields(repeated(s, d)).select("source_name", "kind", "value", "document_id")


def contact_bundles(s, d):
    return E.contact_bundle(E.first_fields(repeated(s, d))).select("source_name", "fields", "answer")


def email_fields(s, d):
    """The first labelled e-mail address of each source."""
    return E.first_fields(repeated(s, d)).where("kind = 'email'").select("source_name", "value", "document_id")


MAIL = E.ADDRESS_OF_MAIL
EMAIL_SQL = (
    f"WITH {SEGMENTS}, l AS (SELECT source_name, document_id, regexp_split_to_array(trim(text, {BLANK}), '\\r\\n|\\n|\\r') AS a FROM seg), x AS (SELECT source_name, document_id, unnest(range(1, len(a) + 1)) AS n, a FROM l), y AS (SELECT source_name, document_id, n, a[n] AS line, trim(coalesce(a[n + 1], '')) AS nxt FROM x), "
    f"v AS (SELECT *, CASE WHEN regexp_matches(line, {lit(E.FIELDS['email'][0][0])}, 'i') THEN trim(regexp_extract(line, {lit(E.FIELDS['email'][0][0])}, 2, 'i')) WHEN regexp_matches(line, {lit(E.FIELDS['email'][1][0])}, 'i') THEN trim(regexp_extract(line, {lit(E.FIELDS['email'][1][0])}, 2, 'i')) WHEN regexp_matches(line, {lit(E.LABEL_ALONE['email'])}, 'i') AND regexp_matches(nxt, '^{MAIL}$') THEN nxt END AS value FROM y) "
    "SELECT source_name, value, document_id FROM v WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY document_id, n) = 1"
)


def prose(s, d):
    p = E.prose_sentences(F.col("text"))
    return repeated(s, d).select("document_id", F.size(p).cast("long").alias("sentences"), F.sha2(F.array_join(p, "\n").cast("binary"), 256).alias("sha")).dropDuplicates(["document_id"])


PROSE_PARTS = f"list_transform(string_split(regexp_replace({collapse_sql('text')}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda p: trim(p))"
PROSE_SQL = (
    f"WITH {SEGMENTS}, p AS (SELECT document_id, (list_filter({PROSE_PARTS}, lambda p: length(p) BETWEEN 48 AND 560 AND NOT (regexp_matches(p, '^[A-Za-z0-9_\\s\\-]{{2,52}}:\\s*\\S+$') AND length(p) < 140) AND length(p) - length(replace(p, ':', '')) <= 2))[1:8] AS s FROM seg) "
    "SELECT document_id, len(s) AS sentences, sha256(coalesce(array_to_string(s, chr(10)), '')) AS sha FROM p"
)


def themes(s, d):
    t = E.themes(F.col("text"))
    return repeated(s, d).select("document_id", F.array_join(t, "; ").alias("themes")).dropDuplicates(["document_id"])


THEMES_SQL = (
    f"WITH {SEGMENTS}, f AS (SELECT document_id, list_filter([{', '.join(f'CASE WHEN contains(lower(text), {lit(a)}) THEN {lit(b)} END' for a, b in E.THEMES)}], lambda x: x IS NOT NULL) AS a FROM seg) "
    "SELECT document_id, coalesce(array_to_string((list_filter(a, lambda x, i: list_position(a, x) = i))[1:6], '; '), '') AS themes FROM f"
)


def overviews(s, d):
    return E.overview(hits(s, d).withColumnRenamed("page_content", "text")).select("query_id", "source_name", "answer")


def section_quotes(s, d):
    """Of requests and their responses, the sentences that name a section."""
    t = turns(s, d).select("turn_id", F.explode(F.array("message", "text")).alias("text"))
    both = t.where("text is not null").select(F.concat_ws(":", "turn_id", F.md5("text")).alias("key"), "text")
    return E.section_quotes(both.distinct(), "key").select("key", "section", "quote")


SECTION_SQL = (
    f"WITH {TURNS}, q AS (SELECT DISTINCT turn_id || ':' || md5(text) AS document_id, text FROM (SELECT turn_id, message AS text FROM t UNION ALL SELECT turn_id, text FROM t) WHERE text IS NOT NULL), p AS (SELECT document_id, string_split(regexp_replace({collapse_sql('text')}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS a FROM q), x AS (SELECT document_id, unnest(range(1, len(a) + 1)) AS n, a FROM p), y AS (SELECT document_id, n, a[n] AS quote FROM x), "
    "z AS (SELECT document_id, n, quote, unnest(list_distinct(regexp_extract_all(lower(quote), 'section\\s*(\\d+)\\b', 1))) AS section FROM y WHERE regexp_matches(quote, 'section\\s*\\d+\\b', 'i') AND length(quote) BETWEEN 10 AND 420) "
    "SELECT document_id AS key, section, quote FROM z QUALIFY row_number() OVER (PARTITION BY document_id, section ORDER BY n) = 1"
)


def metadata_answers(s, d):
    """The file that answers a question for the file name: the dominant source of the turn's hits."""
    top = R.dominant_source(hits(s, d)).where("share >= 0.45 or sources <= 2")
    cite = hits(s, d).join(top.select("query_id", F.col("source_name").alias("_s")), "query_id").where(F.btrim("source_name") == F.col("_s")).groupBy("query_id").agg(F.min("rank").alias("cite"))
    return top.join(cite, "query_id").select("query_id", "source_name", F.col("cite").cast("long").alias("cite"))


METADATA_SQL = (
    f"WITH {HITS}, c AS (SELECT query_id, trim(source_name) AS source_name, count(*) AS n, min(rank) AS first FROM h WHERE coalesce(trim(source_name), '') <> '' GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY query_id) AS share, count(*) OVER (PARTITION BY query_id) AS k, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first, source_name) AS r FROM c) "
    "SELECT query_id, source_name, first::BIGINT AS cite FROM s WHERE r = 1 AND (share >= 0.45 OR k <= 2)"
)


# --- answers ---


def citation_check(s, d):
    n = F.coalesce("retrieval_chunk_count", F.lit(0))
    return turns(s, d).select("turn_id", F.size(A.citations(F.col("text"))).cast("long").alias("citations"), A.citations_valid(F.col("text"), n).alias("valid"))


CITED = "list_transform(regexp_extract_all(coalesce(text, ''), '\\[SOURCE\\s+(\\d+)\\s*\\]', 1, 'i'), lambda x: x::INT)"


def with_corpus(s, d):
    """Turns with the text of all their hits, in order of rank; a turn's hits are bounded by its pool."""
    body = hits(s, d).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "page_content"))), lambda x: F.coalesce(x["page_content"], F.lit(""))), " ").alias("corpus"), F.count("*").cast("int").alias("n"))
    return turns(s, d).join(body.withColumnRenamed("query_id", "turn_id"), "turn_id", "left")


def lexical_support(s, d):
    return with_corpus(s, d).select("turn_id", F.round(A.lexical_support(F.col("text"), F.col("corpus")), 6).alias("support"))


CONTENT = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]{{3,}}')), lambda x: NOT list_contains(" + FUNCTION_STOP + ", x))"
CORPUS = f"{HITS}, b AS (SELECT query_id, string_agg(coalesce(page_content, ''), ' ' ORDER BY rank, chunk_id) AS corpus, count(*) AS n FROM h GROUP BY 1), j AS (SELECT t.*, b.corpus, b.n FROM t LEFT JOIN b ON b.query_id = t.turn_id)"
SUPPORT = f"CASE WHEN trim(coalesce(text, '')) = '' OR corpus IS NULL OR len({CONTENT.format('text')}) < 6 THEN 1.0 WHEN len({CONTENT.format('corpus')}) = 0 THEN 0.0 ELSE len(list_intersect({CONTENT.format('text')}, {CONTENT.format('corpus')})) / len({CONTENT.format('text')}) END"


def grounded_validation(s, d):
    v = A.validate(F.col("text"), F.col("corpus"), F.coalesce("n", F.lit(0)))
    return with_corpus(s, d).select("turn_id", v["text"].alias("answer"), v["warning"].alias("warning"))


VALIDATE_SQL = (
    f"WITH {TURNS}, {CORPUS}, v AS (SELECT turn_id, regexp_replace(coalesce(text, ''), {lit(f'^{SP}+|{SP}+$')}, '', 'g') AS x, {CITED} AS c, coalesce(n, 0) AS n, {SUPPORT} AS support FROM j) "
    f"SELECT turn_id, CASE WHEN x = '' THEN {lit(A.UNKNOWN)} WHEN contains(lower(x), lower({lit(A.UNKNOWN)})) THEN x WHEN n > 0 AND len(list_filter(c, lambda i: i < 1 OR i > n)) > 0 THEN {lit(A.UNKNOWN)} ELSE x END AS answer, "
    f"CASE WHEN x = '' OR contains(lower(x), lower({lit(A.UNKNOWN)})) THEN NULL WHEN n > 0 AND len(list_filter(c, lambda i: i < 1 OR i > n)) > 0 THEN {lit(A.WITHHELD)} WHEN length(x) > 100 AND support < 0.12 THEN {lit(A.UNSUPPORTED)} END AS warning FROM v"
)


def evaluated(s, d):
    """Turns as cases: each is held against the evaluation item that its number falls to."""
    items = table(s, d, "eval_items").select("item_id", "category", "query")
    n = with_corpus(s, d)
    keyed = n.withColumn("item_id", F.pmod(F.col("turn_id"), F.lit(240)) + 1).join(items, "item_id", "left")
    words = T.keywords(F.col("query"), 3)
    return A.score(keyed.select("turn_id", "category", "mode", "text", F.col("corpus").alias("hits_text"), F.coalesce("n", F.lit(0)).alias("hit_count"), F.array(F.lit("grounded"), F.lit("blended")).alias("mode_in"), (F.col("category") == "negative").alias("refusal"), words.alias("any_of"), words.alias("anchors"), F.array(F.lit("as an ai")).alias("forbidden")))


def eval_cases(s, d):
    return evaluated(s, d).select("turn_id", "routing_ok", "refusal_ok", "false_refusal", "keywords_ok", "anchors_ok", "forbidden_ok", "citation_ok", "passed")


def eval_rollup(s, d):
    return A.rates(evaluated(s, d))


def eval_by_category(s, d):
    return A.by_category(evaluated(s, d))


def _eval_sql() -> str:
    from .text_queries import keywords_sql

    x = "lower(coalesce(text, ''))"
    refuses = (
        f"(contains({x}, lower({lit(A.UNKNOWN)})) OR (contains({x}, 'don''t know') AND contains({x}, 'document')) OR (contains({x}, 'cannot') AND contains({x}, 'document') AND (contains({x}, 'find') OR contains({x}, 'locate') OR contains({x}, 'provided'))) OR (contains({x}, 'not') AND contains({x}, 'provided') AND contains({x}, 'document')) "
        f"OR contains({x}, 'do not contain') OR contains({x}, 'does not contain') OR contains({x}, 'don''t contain') OR (contains({x}, 'no information') AND (contains({x}, 'document') OR contains({x}, 'file') OR contains({x}, 'upload'))))"
    )
    return (
        f"WITH {TURNS}, {CORPUS}, k AS (SELECT item_id, category, ({keywords_sql('query')})[1:3] AS w FROM eval_items), c AS (SELECT j.turn_id, k.category, j.mode, j.text, lower(coalesce(j.corpus, '')) AS hb, coalesce(j.n, 0) AS n, coalesce(k.w, []) AS w, coalesce(k.category = 'negative', false) AS want FROM j LEFT JOIN k ON k.item_id = (j.turn_id % 240) + 1), "
        f"s AS (SELECT turn_id, category, coalesce(mode IN ('grounded', 'blended'), false) AS routing_ok, CASE WHEN want THEN {refuses} OR coalesce(mode IN ('general', 'web'), false) ELSE NOT {refuses} END AS refusal_ok, NOT want AND {refuses} AS false_refusal, len(w) = 0 OR len(list_filter(w, lambda y: contains({x}, y))) > 0 AS keywords_ok, "
        f"len(w) = 0 OR len(list_filter(w, lambda y: contains(hb, y))) > 0 AS anchors_ok, NOT contains({x}, 'as an ai') AS forbidden_ok, CASE WHEN want THEN NULL WHEN mode IN ('grounded', 'blended') AND n > 0 THEN len({CITED}) > 0 AND coalesce(list_max({CITED}) <= n, false) WHEN mode IN ('grounded', 'blended') THEN false END AS citation_ok FROM c), "
        "e AS (SELECT *, routing_ok AND refusal_ok AND keywords_ok AND anchors_ok AND forbidden_ok AND coalesce(citation_ok, true) AS passed FROM s) "
    )


EVAL_SQL = _eval_sql()


def reliability(s, d):
    t = turns(s, d)
    return t.select("turn_id", (F.coalesce("retrieval_chunk_count", F.lit(0)) == 0).alias("no_hits"), A.concern(F.col("assistant_note")).alias("concern"), F.coalesce(F.col("mode") == "error", F.lit(False)).alias("failed"))


# --- web ---


def candidates(s, d):
    """Web addresses in documents as candidates for one question: their document's start as title and text."""
    docs = table(s, d, "documents").where("text is not null and doc_id is not null").dropDuplicates(["doc_id"])
    found = docs.select("doc_id", "text", F.posexplode(F.regexp_extract_all("text", F.lit(r"((?:https?://|www\.)[A-Za-z0-9._~/?#=\-]+)"), F.lit(1))).alias("n", "u"))
    url = F.when(F.col("u").startswith("www."), F.concat(F.lit("https://"), F.col("u"))).otherwise(F.col("u"))
    return found.select(F.lit(1).alias("query_id"), F.lit("which project milestone was approved").alias("query"), (F.col("doc_id") * 1000 + F.col("n")).alias("arrival"), F.substring(T.normalize_line(F.col("text")), 1, 60).alias("title"), url.alias("url"), F.substring("text", 1, 400).alias("snippet"), "doc_id")


CANDIDATES = (
    "d0 AS (SELECT DISTINCT ON (doc_id) doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL), u0 AS (SELECT doc_id, text, regexp_extract_all(text, '((?:https?://|www\\.)[A-Za-z0-9._~/?#=\\-]+)', 1) AS a FROM d0), u1 AS (SELECT doc_id, text, unnest(range(1, len(a) + 1)) AS n, a FROM u0), "
    f"cand AS (SELECT doc_id, doc_id * 1000 + n - 1 AS arrival, ({collapse_sql('text')})[1:60] AS title, CASE WHEN starts_with(a[n], 'www.') THEN 'https://' || a[n] ELSE a[n] END AS url, text[1:400] AS snippet FROM u1)"
)
IDENTITY = "lower(regexp_replace(regexp_replace(regexp_extract(regexp_replace(trim(url), '[).,\\]]+$', ''), '^https?://([^?#]*)', 1), '/+$', ''), '^www\\.', '', 'i'))"


def url_identity(s, d):
    return candidates(s, d).select("arrival", "url", W.identity(F.col("url")).alias("identity"))


def snippet_rank(s, d):
    return W.rank_snippets(candidates(s, d), 1_000_000, repeats=False).select("url", F.round("score", 6).alias("score"), F.char_length("snippet").cast("long").alias("chars"), F.col("rank").cast("long").alias("rank"))


_WORDS = ["which", "project", "milestone", "approved"]
_SCORE = (
    f"1.1::DOUBLE * len(list_filter({_WORDS}, lambda w: contains(lower(title || ' ' || snippet), w))) + least(length(snippet), 320) / 320 * 2.4 + least(length(title), 72) / 72 * 1.2 - CASE WHEN length(snippet) < 32 THEN 2.5 ELSE 0 END - CASE WHEN length(title) < 6 THEN 0.8 ELSE 0 END - CASE WHEN regexp_matches(title, '^[^\\pL]+$') THEN 3.0 ELSE 0 END - CASE WHEN trim(snippet) IN ('', '...') THEN 4.0 ELSE 0 END"
)
_CLEAN = collapse_sql(f"regexp_replace({collapse_sql('snippet')}, {lit(W.BOILERPLATE)}, ' ', 'gi')")
SNIPPETS_SQL = (
    f"WITH {CANDIDATES}, i AS (SELECT *, {IDENTITY} AS id FROM cand), f AS (SELECT * FROM i WHERE id <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrival) = 1), s AS (SELECT *, {_SCORE} AS score, {_CLEAN} AS c FROM f), "
    "k AS (SELECT trim(url) AS url, arrival, score, CASE WHEN length(c) <= 280 THEN c ELSE regexp_replace(CASE WHEN contains(c[1:281], ' ') THEN regexp_replace(c[1:280], ' [^ ]*$', '') ELSE c[1:281] END, '[,;:]+$', '') || '…' END AS t, CASE WHEN trim(title) = '' THEN trim(url) ELSE trim(title) END AS title FROM s WHERE NOT (score < 0.35 AND length(snippet) < 40)) "
    "SELECT url, round(score, 6) AS score, length(t) AS chars, row_number() OVER (ORDER BY round(score, 9) DESC, arrival) AS rank FROM k WHERE NOT (t = '' AND length(title) < 10)"
)


def web_queries(s, d):
    return asked(s, d).select("query_id", W.shape(F.col("text"), Q.normalize_query(F.col("text")), 2024).alias("shaped"))


# --- library ---


def chunk_summary(s, d):
    return L.chunk_counts(table(s, d, "chunks"))


def health(s, d):
    return L.health(table(s, d, "chunks"), table(s, d, "chunk_vectors"))


def health_counts(s, d):
    return health(s, d).groupBy("status").agg(F.count("*").alias("sources"), F.sum("expected").alias("expected"), F.sum("indexed").alias("indexed"))


def catalog(s, d):
    return L.catalog(table(s, d, "segments"), health(s, d)).drop("updated_at")


def hashes(s, d):
    return L.content_hashes(table(s, d, "segments"))


def incremental_diff(s, d):
    """What changed in the library since the middle of its time."""
    rows = table(s, d, "segments")
    middle = rows.agg((F.min(F.unix_timestamp("loaded_at")) + (F.max(F.unix_timestamp("loaded_at")) - F.min(F.unix_timestamp("loaded_at"))) / 2).alias("m"))
    before = rows.join(F.broadcast(middle)).where(F.unix_timestamp("loaded_at") <= F.col("m")).drop("m")
    return L.changes(L.content_hashes(before), L.content_hashes(rows))


_PARTS = ", ".join(f"sum(('0x' || h[{12 * i + 1}:{12 * i + 12}])::BIGINT)" for i in range(4))
HASHES = f"(SELECT source_name, sha256(concat_ws(':', count(*), {_PARTS})) AS sha FROM (SELECT coalesce(source_name, '') AS source_name, sha256(document_id || ':' || sha256(text)) AS h FROM (SELECT DISTINCT ON (document_id) document_id, source_name, text FROM {{0}} WHERE document_id IS NOT NULL AND text IS NOT NULL)) GROUP BY 1)"
DIFF_SQL = (
    "WITH mid AS (SELECT (epoch(min(loaded_at))::BIGINT + (epoch(max(loaded_at))::BIGINT - epoch(min(loaded_at))::BIGINT) / 2) AS m FROM segments), old AS (SELECT * FROM segments WHERE floor(epoch(loaded_at)) <= (SELECT m FROM mid)), "
    f"b AS {HASHES.format('old')}, n AS {HASHES.format('segments')} SELECT coalesce(b.source_name, n.source_name) AS source_name, CASE WHEN b.sha IS NULL THEN 'added' WHEN n.sha IS NULL THEN 'removed' WHEN b.sha = n.sha THEN 'unchanged' ELSE 'changed' END AS change FROM b FULL JOIN n USING (source_name)"
)


def fingerprint(s, d):
    return L.fingerprint(hashes(s, d))


def content_dedup(s, d):
    docs = table(s, d, "documents").where("text is not null and doc_id is not null").dropDuplicates(["doc_id"])
    return docs.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def name_check(s, d):
    return table(s, d, "segments").where("source_name is not null").select("source_name").distinct().select("source_name", L.safe_name(F.col("source_name")).alias("safe"))


def chunk_pieces(s, d):
    return chunker.chunk(repeated(s, d), 900, 120)


# --- chats ---


def session_list(s, d):
    return C.listing(table(s, d, "chat_sessions"), table(s, d, "chat_messages")).select("session_id", "title", "messages")


MSG = f"m AS (SELECT DISTINCT ON (id) id, lower(trim(session_id, {BLANK})) AS session_id, lower(trim(role, {BLANK})) AS role, content, extra_json FROM chat_messages WHERE id IS NOT NULL)"
SESSIONS_SQL = (
    f"WITH {MSG}, s AS (SELECT lower(trim(id, {BLANK})) AS session_id, title FROM chat_sessions WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(trim(id, {BLANK})) ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, title DESC NULLS LAST) = 1), c AS (SELECT session_id, count(*) AS messages FROM m GROUP BY 1) SELECT session_id, title, coalesce(messages, 0) AS messages FROM s LEFT JOIN c USING (session_id)"
)


def session_titles(s, d):
    return C.titles(table(s, d, "chat_messages"))


def last_grounded(s, d):
    return C.last_grounded(table(s, d, "chat_messages")).select("session_id", "id", "question")


GROUNDED = "coalesce(TRY_CAST(json_extract_string(TRY_CAST(extra_json AS JSON), '$.grounded') AS BOOLEAN), false) OR coalesce(json_extract_string(TRY_CAST(extra_json AS JSON), '$.mode') IN ('grounded', 'blended'), false)"
GROUNDED_SQL = (
    f"WITH {MSG}, v AS (SELECT *, lag(role) OVER w AS pr, lag(content) OVER w AS pc FROM m WINDOW w AS (PARTITION BY session_id ORDER BY id)) SELECT session_id, id, CASE WHEN pr = 'user' THEN nullif(trim(pc), '') END AS question FROM v WHERE role = 'assistant' AND ({GROUNDED}) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id DESC) = 1"
)


def message_roles(s, d):
    return C.messages(table(s, d, "chat_messages")).groupBy("role", "mode").agg(F.count("*").alias("messages"), F.count_if("grounded").alias("grounded"))


def event_windows(s, d):
    """Events and their values in tumbling hours by type: the batch form of the stream."""
    from ..streaming.windows import hourly

    return hourly(table(s, d, "events")).select("event_type", F.col("window_start").cast("string").alias("window_start"), "events", F.round("total", 4).alias("total"))


def event_sessions(s, d):
    """Runs of a user's events without a gap of more than half an hour: the batch form of the session stream."""
    from ..streaming.windows import sessions

    return sessions(table(s, d, "events")).select("user_id", F.unix_micros(F.col("started").cast("timestamp")).alias("started"), F.unix_micros(F.col("ended").cast("timestamp")).alias("ended"), "events")


SESSION_SQL = (
    "WITH e AS (SELECT user_id, ts, ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) "
    "SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS ended, count(*) AS events FROM g GROUP BY user_id, g"
)

QUERIES = {
    "event_sessions": (event_sessions, SESSION_SQL),
    "field_values": (field_values, None),
    "contact_bundle": (contact_bundles, None),
    "email_fields": (email_fields, EMAIL_SQL),
    "prose_sentences": (prose, PROSE_SQL),
    "overview_themes": (themes, THEMES_SQL),
    "overview_answers": (overviews, None),
    "section_quotes": (section_quotes, SECTION_SQL),
    "metadata_answer": (metadata_answers, METADATA_SQL),
    "citation_check": (citation_check, f"WITH {TURNS} SELECT turn_id, len({CITED}) AS citations, coalesce(retrieval_chunk_count, 0) <= 0 OR len(list_filter({CITED}, lambda x: x < 1 OR x > retrieval_chunk_count)) = 0 AS valid FROM t"),
    "lexical_support": (lexical_support, f"WITH {TURNS}, {CORPUS} SELECT turn_id, round({SUPPORT}, 6) AS support FROM j"),
    "grounded_validation": (grounded_validation, VALIDATE_SQL),
    "eval_cases": (eval_cases, EVAL_SQL + "SELECT turn_id, routing_ok, refusal_ok, false_refusal, keywords_ok, anchors_ok, forbidden_ok, citation_ok, passed FROM e"),
    "eval_rollup": (
        eval_rollup,
        EVAL_SQL + "SELECT count(*) AS cases, count(*) FILTER (passed) AS passed, round(count(*) FILTER (passed) / count(*), 4) AS pass_rate, round(count(*) FILTER (routing_ok) / count(*), 4) AS routing_ok_rate, round(count(*) FILTER (anchors_ok) / count(*), 4) AS anchor_rate, count(*) FILTER (false_refusal) AS false_refusals, count(*) FILTER (NOT forbidden_ok) AS forbidden_hits FROM e",
    ),
    "eval_by_category": (eval_by_category, EVAL_SQL + "SELECT coalesce(nullif(category, ''), 'unknown') AS category, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, round(count(*) FILTER (passed) / count(*), 4) AS pass_rate FROM e GROUP BY 1"),
    "reliability_flags": (
        reliability,
        f"WITH {TURNS}, n AS (SELECT *, lower(coalesce(assistant_note, '')) AS x FROM t) SELECT turn_id, coalesce(retrieval_chunk_count, 0) = 0 AS no_hits, CASE WHEN contains(x, 'withheld') THEN 'source_citation_withheld' WHEN contains(x, 'removed from the answer') OR contains(x, 'did not match retrieved') THEN 'web_link_sanitized' WHEN contains(x, 'verify in sources') OR contains(x, 'retrieved excerpts') THEN 'lexical_support_warning' END AS concern, coalesce(mode = 'error', false) AS failed FROM n",
    ),
    "url_identity": (url_identity, f"WITH {CANDIDATES} SELECT arrival, url, {IDENTITY} AS identity FROM cand"),
    "snippet_score_topk": (snippet_rank, SNIPPETS_SQL),
    "web_query_shape": (web_queries, None),
    "chunk_summary": (chunk_summary, "WITH c AS (SELECT DISTINCT ON (chunk_id) source_name, chunk_id, document_id FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL AND source_name IS NOT NULL) SELECT source_name, count(*) AS chunks, count(DISTINCT document_id) AS documents FROM c GROUP BY 1"),
    "source_health": (health, f"WITH {L.HEALTH_SQL} SELECT source_name, expected, indexed, status FROM health"),
    "health_counts": (health_counts, f"WITH {L.HEALTH_SQL} SELECT status, count(*) AS sources, sum(expected)::BIGINT AS expected, sum(indexed)::BIGINT AS indexed FROM health GROUP BY 1"),
    "catalog_left_join": (
        catalog,
        f"WITH {L.HEALTH_SQL}, d AS (SELECT source_name, document_id, max(file_type) AS file_type, max(length(trim(text))) AS chars FROM segments WHERE source_name IS NOT NULL AND document_id IS NOT NULL GROUP BY ALL), f AS (SELECT source_name, max(file_type) AS file_type, count(*) AS segments, avg(chars) AS m FROM d GROUP BY 1) "
        "SELECT f.source_name, file_type, segments, round(m, 6) AS mean_chars, CASE WHEN m IS NULL THEN 'unknown' WHEN m < CASE file_type WHEN 'pdf' THEN 35 WHEN 'docx' THEN 40 ELSE 15 END THEN 'low_text' ELSE 'good' END AS extraction_quality, coalesce(status, 'uploaded') AS status FROM f LEFT JOIN health USING (source_name)",
    ),
    "content_hashes": (hashes, f"SELECT source_name, sha FROM {HASHES.format('segments')}"),
    "incremental_diff": (incremental_diff, DIFF_SQL),
    "library_fingerprint": (fingerprint, f"SELECT count(*) AS sources, coalesce(sum(('0x' || sha256(source_name || ':' || sha)[1:12])::BIGINT), 0)::VARCHAR AS fingerprint FROM {HASHES.format('segments')}"),
    "content_hash_dedup": (content_dedup, "WITH d AS (SELECT DISTINCT ON (doc_id) doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL) SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM d GROUP BY 1"),
    "upload_name_check": (name_check, None),
    "chunk_pieces": (chunk_pieces, None),
    "session_list": (session_list, SESSIONS_SQL),
    "session_titles": (session_titles, f"WITH {MSG} SELECT session_id, trim(content)[1:80] AS title FROM m WHERE role = 'user' AND trim(content) <> '' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id) = 1"),
    "last_turn_hints": (last_grounded, GROUNDED_SQL),
    "message_roles": (message_roles, f"WITH {MSG}, x AS (SELECT role, json_extract_string(TRY_CAST(extra_json AS JSON), '$.mode') AS mode, coalesce(TRY_CAST(json_extract_string(TRY_CAST(extra_json AS JSON), '$.grounded') AS BOOLEAN), false) AS g FROM m) SELECT role, mode, count(*) AS messages, count(*) FILTER (g) AS grounded FROM x GROUP BY ALL"),
    "event_windows": (event_windows, "SELECT event_type, date_trunc('hour', ts)::VARCHAR AS window_start, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
}
