"""Queries over document tasks, prompts, fallbacks, library states and file sinks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import queries as Q
from ..functions import text as T
from ..operators import answers as A
from ..operators import chat as C
from ..operators import extract as E
from ..operators import index as I
from ..operators import library as L
from ..operators import prompts as P
from ..operators import tasks as K
from ..operators import web as W
from ..session import table
from ..sources import files
from . import state_queries as S
from .field_sql import BUNDLE_SQL, FIELDS_SQL, OVERVIEW_SQL
from .retrieval_queries import CHAIN, HITS, hits, reranked
from .state_queries import CORPUS, HASHES, SUPPORT, TURNS, turns, with_corpus
from .text_queries import ASKED, SEGMENTS, SP, STORED, asked, collapse_sql, keywords_sql, lit, normalize_sql, query_sql, repeated, segments

# --- tasks ---


def _tasks(s, d):
    """A task for each turn with hits: by its number, over the file of its first hit or the whole library."""
    h = hits(s, d).groupBy("query_id").agg(F.min_by("source_name", F.struct("rank", "chunk_id")).alias("source"))
    task = F.element_at(F.array(*map(F.lit, ("summarize", "extract", "compare"))), (F.pmod("query_id", F.lit(3)) + 1).cast("int"))
    scope = F.when(F.pmod("query_id", F.lit(2)) == 0, F.upper("source")).otherwise("all")
    return h.select("query_id", task.alias("task"), scope.alias("scope"), (F.lit(3) + F.pmod("query_id", F.lit(5))).cast("int").alias("top_k"))


def _both(s, d):
    first = reranked(s, d)
    return K.contexts(first, first.withColumn("query_id", F.col("query_id") - 1), _tasks(s, d), 1000, "page_content")


def task_contexts(s, d):
    return _both(s, d)[0].select("query_id", "chunk_id", F.col("context_order").cast("long").alias("context_order"))


def task_notes(s, d):
    return _both(s, d)[1]


TASKS_SQL = (
    f"{CHAIN}, f AS (SELECT query_id, source_name FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) = 1), "
    "t AS (SELECT query_id, ['summarize', 'extract', 'compare'][query_id % 3 + 1] AS task, 3 + query_id % 5 AS top_k, CASE WHEN query_id % 3 = 0 AND query_id % 2 = 0 AND lower(trim(coalesce(source_name, ''))) NOT IN ('', 'all') THEN lower(trim(source_name)) END AS scope FROM f), "
    "a AS (SELECT r.*, t.* EXCLUDE (query_id), 0 AS look FROM r JOIN t USING (query_id) WHERE scope IS NULL OR lower(trim(r.source_name)) = scope), "
    "few AS (SELECT t.* FROM t LEFT JOIN (SELECT query_id, count(*) AS c FROM a GROUP BY 1) c USING (query_id) WHERE scope IS NOT NULL AND coalesce(c, 0) < greatest(3, least(5, top_k))), "
    "b AS (SELECT q.*, f.* EXCLUDE (query_id), 1 AS look FROM (SELECT * REPLACE (query_id - 1 AS query_id) FROM r) q JOIN few f USING (query_id) WHERE lower(trim(q.source_name)) = scope), "
    "u AS (SELECT * FROM (SELECT * FROM a UNION ALL BY NAME SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY query_id, coalesce(nullif(chunk_id, ''), left(coalesce(page_content, ''), 40)) ORDER BY look, rerank_order) = 1), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY look, rerank_order, chunk_id) - 1 AS n, ((coalesce(distance, 2.5) >= 1.45 AND coalesce(rrf_score, 0.0) < 0.0095) OR coalesce(distance, 2.5) >= 1.62) AS weak FROM u) "
)
CONTEXT_SQL = TASKS_SQL + (
    ", k AS (SELECT *, count(*) FILTER (NOT weak) OVER (PARTITION BY query_id) AS strong FROM o), x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n) AS context_order FROM k WHERE NOT weak OR (strong = 0 AND n = 0)) "
    "SELECT query_id, chunk_id, context_order FROM x WHERE context_order <= CASE task WHEN 'summarize' THEN greatest(8, 2 * top_k) WHEN 'compare' THEN greatest(10, 2 * top_k) ELSE greatest(5, top_k) END"
)
NOTES_SQL = TASKS_SQL + (
    f"SELECT t.query_id, CASE WHEN t.task <> 'summarize' THEN NULL WHEN t.scope IS NOT NULL AND o.query_id IS NULL THEN {lit(K.NONE_NOTE)} WHEN o.query_id IS NOT NULL AND coalesce(distance, 2.5) > 1.38 THEN CASE WHEN t.scope IS NOT NULL THEN {lit(K.FILE_NOTE)} ELSE {lit(K.LIBRARY_NOTE)} END END AS note FROM t LEFT JOIN (SELECT * FROM o WHERE n = 0) o USING (query_id)"
)

# --- prompts and payloads ---


def prompt_messages(s, d):
    """The messages that each turn's kind of answer would send to a model."""
    t = with_corpus(s, d).where("message is not null")
    c, q, n = F.substring(F.coalesce("corpus", F.lit("")), 1, 200), F.col("message"), F.coalesce("n", F.lit(0))
    grounded = P.messages(c, q, n, F.lower(q).contains("section"), F.lower(q).contains("summar"))
    of = (
        F.when(F.col("mode") == "web", P.web_messages(c, q)).when(F.col("mode") == "blended", P.blended_messages(c, c, q)).when(F.col("mode") == "general", P.general_messages(q)).when(F.col("mode") == "error", P.abstain_messages(q))
        .when(F.pmod("turn_id", F.lit(4)) == 0, P.task_messages(F.lit("compare"), c, q)).otherwise(grounded)
    )
    return t.select("turn_id", of[0]["content"].alias("rules"), of[1]["content"].alias("body"))


_C = "left(coalesce(corpus, ''), 200)"
PROMPTS_SQL = (
    f"WITH {TURNS}, {CORPUS}, x AS (SELECT turn_id, mode, message AS q, {_C} AS c, coalesce(n, 0) AS n FROM j WHERE message IS NOT NULL) SELECT turn_id, "
    f"CASE WHEN mode = 'web' THEN {lit(P.WEB_RULES)} WHEN mode = 'blended' THEN {lit(P.BLENDED_RULES)} WHEN mode = 'general' THEN {lit(P.GENERAL_RULES)} WHEN mode = 'error' THEN {lit(P.ABSTAIN_RULES)} WHEN turn_id % 4 = 0 THEN {lit(P.TASKS['compare'])} "
    f"ELSE concat_ws(chr(10), {lit(P.RULES)}, CASE WHEN contains(lower(q), 'section') THEN {lit(P.SECTION_NOTE)} END, CASE WHEN contains(lower(q), 'summar') AND NOT contains(lower(q), 'section') THEN {lit(P.SUMMARY_NOTE)} END, CASE WHEN n >= 2 THEN {lit(P.SEVERAL_NOTE)} END) END AS rules, "
    "CASE WHEN mode = 'web' THEN 'Web:' || chr(10) || c || chr(10) || chr(10) || 'Question: ' || q WHEN mode = 'blended' THEN 'Context:' || chr(10) || c || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Web:' || chr(10) || c || chr(10) || chr(10) || 'Question: ' || q WHEN mode IN ('general', 'error') THEN q "
    "WHEN turn_id % 4 = 0 THEN 'Context:' || chr(10) || c || chr(10) || chr(10) || 'Request: ' || q ELSE 'Context:' || chr(10) || c || chr(10) || chr(10) || 'Question: ' || q END AS body FROM x"
)


def turn_payloads(s, d):
    p = P.payload(F.col("mode"), F.col("text"), F.col("retrieval_chunk_count"), F.col("assistant_note"), F.col("error"))
    return turns(s, d).select("turn_id", p.alias("p")).select("turn_id", "p.*")


PAYLOAD_SQL = (
    f"WITH {TURNS} SELECT turn_id, mode, coalesce(text, '') AS text, mode IN ('grounded', 'blended') AS grounded, CASE WHEN mode IN ('grounded', 'blended') THEN retrieval_chunk_count END AS sources, nullif(trim(assistant_note), '') AS note, CASE WHEN mode IN ('web', 'blended') THEN error END AS web FROM t"
)


def hit_rows(s, d):
    return P.hit_rows(hits(s, d), "page_content").withColumn("place", F.col("place").cast("long"))


HIT_ROWS_SQL = (
    f"WITH {HITS} SELECT query_id, row_number() OVER w AS place, chunk_id, source_name, coalesce(page_number::VARCHAR, 'N/A') AS page_label, round(distance, 4) AS distance, round(rrf_score, 6) AS rrf_score, left({collapse_sql("coalesce(page_content, '')")}, 120) AS preview "
    "FROM h WINDOW w AS (PARTITION BY query_id ORDER BY rank, chunk_id) QUALIFY place <= 8"
)


def unknown_fallbacks(s, d):
    """Turns that did not know, answered from the start of what they found: first as a quote, then as an overview."""
    t = with_corpus(s, d)
    answer = F.when(F.pmod("turn_id", F.lit(2)) == 0, F.lit(A.UNKNOWN)).otherwise(F.coalesce("text", F.lit("")))
    quote = F.when(F.pmod("turn_id", F.lit(3)) == 0, F.concat(F.substring("corpus", 1, 150), F.concat(F.lit(" [SOURCE "), F.pmod("turn_id", F.lit(7)).cast("string"), F.lit("]"))))
    view = F.when(F.pmod("turn_id", F.lit(5)) < 3, F.concat(F.substring("corpus", 1, 60), F.lit(" [SOURCE 1]")))
    v = A.fall_back(answer, quote, view, F.col("corpus"), F.coalesce("n", F.lit(0)))
    return t.select("turn_id", v["text"].alias("answer"), v["warning"].alias("warning"))


def _fallback_sql() -> str:
    strip = lambda c: f"regexp_replace(coalesce({c}, ''), {lit(f'^{SP}+|{SP}+$')}, '', 'g')"
    support = lambda c: SUPPORT.replace("coalesce(text, '')", f"coalesce({c}, '')").replace("lower(text)", f"lower({c})")
    cites = lambda c: f"len(list_filter(list_transform(regexp_extract_all(coalesce({c}, ''), '\\[SOURCE\\s+(\\d+)\\s*\\]', 1, 'i'), lambda x: x::INT), lambda i: i < 1 OR i > n)) > 0 AND n > 0"
    unknown = lambda c: f"contains(lower({c}), lower({lit(A.UNKNOWN)}))"
    text = lambda c: f"CASE WHEN {c} IS NULL OR {c} = '' THEN {lit(A.UNKNOWN)} WHEN {unknown(c)} THEN {c} WHEN {cites(c)} THEN {lit(A.UNKNOWN)} ELSE {c} END"
    warn = lambda c, s: f"CASE WHEN {c} IS NULL OR {c} = '' OR {unknown(c)} THEN NULL WHEN {cites(c)} THEN {lit(A.WITHHELD)} WHEN length({c}) > 100 AND {s} < 0.12 THEN {lit(A.UNSUPPORTED)} END"
    return (
        f"WITH {TURNS}, {CORPUS}, fa AS (SELECT turn_id, corpus, coalesce(n, 0) AS n, CASE WHEN turn_id % 2 = 0 THEN {lit(A.UNKNOWN)} ELSE coalesce(text, '') END AS answer, CASE WHEN turn_id % 3 = 0 THEN left(corpus, 150) || ' [SOURCE ' || (turn_id % 7) || ']' END AS q0, CASE WHEN turn_id % 5 < 3 THEN left(corpus, 60) || ' [SOURCE 1]' END AS o0 FROM j), "
        f"fb AS (SELECT *, {strip('q0')} AS q, {strip('o0')} AS o FROM fa), fc AS (SELECT *, {text('q')} AS qt, {warn('q', support('q'))} AS qw, {text('o')} AS ot, {warn('o', support('o'))} AS ow FROM fb), "
        f"fe AS (SELECT *, CASE WHEN q0 IS NOT NULL THEN qt ELSE answer END AS cur, CASE WHEN q0 IS NOT NULL THEN qw END AS cw FROM fc), "
        f"ff AS (SELECT *, CASE WHEN {unknown('cur')} AND o0 IS NOT NULL THEN ot ELSE cur END AS t, CASE WHEN {unknown('cur')} AND o0 IS NOT NULL THEN nullif(concat_ws(chr(10), nullif(trim(cw), ''), nullif(trim(ow), '')), '') ELSE cw END AS w FROM fe) "
        f"SELECT turn_id, CASE WHEN {unknown('answer')} AND t <> answer THEN t ELSE answer END AS answer, CASE WHEN {unknown('answer')} AND t <> answer THEN w END AS warning FROM ff"
    )


def eval_report(s, d):
    scored = S.evaluated(s, d)
    return A.text_report(A.rates(scored), A.by_category(scored)).select(F.col("line_no").cast("long").alias("line_no"), "line")


REPORT_SQL = S.EVAL_SQL + (
    ", rh AS (SELECT 0 AS a, '' AS k, printf('cases %d, passed %d (%.4f), routing %.4f, anchors %.4f, false refusals %d, forbidden %d', count(*), count(*) FILTER (passed), round(count(*) FILTER (passed) / count(*), 4), round(count(*) FILTER (routing_ok) / count(*), 4), round(count(*) FILTER (anchors_ok) / count(*), 4), count(*) FILTER (false_refusal), count(*) FILTER (NOT forbidden_ok)) AS line FROM e), "
    "rg AS (SELECT 1 AS a, coalesce(nullif(category, ''), 'unknown') AS k, printf('%s: %d of %d (%.4f)', coalesce(nullif(category, ''), 'unknown'), count(*) FILTER (passed), count(*), round(count(*) FILTER (passed) / count(*), 4)) AS line FROM e GROUP BY 2) "
    "SELECT row_number() OVER (ORDER BY a, k) - 1 AS line_no, line FROM (SELECT * FROM rh UNION ALL SELECT * FROM rg)"
)

# --- library states ---


def _indexed(s, d):
    h = S.health(s, d)
    return h.select("source_name", (F.col("expected") > 0).alias("ok"), F.when(F.col("expected") == 0, "no text").alias("reason"), "expected", "indexed")


def index_statuses(s, d):
    return L.statuses_after_index(_indexed(s, d), F.lit(True))


STATUS_SQL = f"WITH {L.HEALTH_SQL} SELECT source_name, CASE WHEN expected = 0 THEN 'failed' WHEN expected <> indexed THEN 'ready_limited' ELSE 'ready' END AS status, CASE WHEN expected = 0 THEN 'no text' WHEN expected <> indexed THEN 'indexed ' || indexed || ' of ' || expected END AS note FROM health"


def probe_statuses(s, d):
    """The states after a probe that failed: what is not failed is limited."""
    of = _indexed(s, d)
    return L.statuses_after_probe(L.statuses_after_index(of, F.lit(True)), of, F.lit(False))


def all_statuses(s, d):
    """States of all files of the library, those without chunks as uploaded, those loaded last as processing."""
    known = L.statuses_after_index(_indexed(s, d), F.lit(True)).select(F.col("source_name").alias("_s"), "status")
    names = table(s, d, "segments").where("source_name is not null").groupBy("source_name").agg(F.count_if(F.col("text").isNull()).alias("empty"))
    return names.join(known, F.col("source_name") == F.col("_s"), "left").select("source_name", F.when(F.pmod(F.length("source_name"), F.lit(7)) == 0, "processing").when(F.pmod(F.length("source_name"), F.lit(11)) == 0, "archived").otherwise(F.coalesce("status", F.lit("uploaded"))).alias("status"))


def status_counts(s, d):
    return L.status_counts(all_statuses(s, d))


COUNTS_SQL = (
    f"WITH {L.HEALTH_SQL}, n AS (SELECT DISTINCT source_name FROM segments WHERE source_name IS NOT NULL), s AS (SELECT n.source_name, CASE WHEN length(n.source_name) % 7 = 0 THEN 'processing' WHEN length(n.source_name) % 11 = 0 THEN 'archived' WHEN expected IS NULL THEN 'uploaded' WHEN expected = 0 THEN 'failed' WHEN expected <> indexed THEN 'ready_limited' ELSE 'ready' END AS st FROM n LEFT JOIN health USING (source_name)) "
    "SELECT count(*) FILTER (st = 'uploaded') AS uploaded, count(*) FILTER (st = 'processing') AS processing, count(*) FILTER (st = 'ready') AS ready, count(*) FILTER (st = 'ready_limited') AS ready_limited, count(*) FILTER (st = 'failed') AS failed, count(*) FILTER (st = 'archived') AS other FROM s"
)


def needs_sync(s, d):
    """Whether the library must be read again: as it is, and without one of its files."""
    now = L.content_hashes(table(s, d, "segments"))
    fewer = now.where("source_name <> 'intake_archive.pdf'")
    of = lambda case, files_, indexed: L.needs_sync(files_, indexed).select(F.lit(case).alias("case"), "*")
    return of("same", now, now).unionByName(of("fewer", fewer, now)).unionByName(of("no index", now, now.limit(0))).unionByName(of("no files", now.limit(0), now))


SYNC_SQL = (
    f"WITH a AS (SELECT count(*) AS n FROM {HASHES.format('segments')}), b AS (SELECT count(*) AS n FROM {HASHES.format('segments')} WHERE source_name <> 'intake_archive.pdf') "
    "SELECT 'same' AS \"case\", n AS files, false AS needs_sync, 'fresh' AS reason FROM a UNION ALL SELECT 'fewer', b.n, b.n <> a.n, CASE WHEN b.n <> a.n THEN 'changed' ELSE 'fresh' END FROM a, b UNION ALL SELECT 'no index', n, true, 'no index' FROM a UNION ALL SELECT 'no files', 0, false, 'no files'"
)


def manifest_prune(s, d):
    """States of the files that still have segments: the manifest without files that are gone."""
    return S.health(s, d).join(table(s, d, "segments").select("source_name").where("source_name is not null").distinct(), "source_name", "left_semi").select("source_name", "status")


def _latest(s, d):
    return table(s, d, "chunk_vectors").where("chunk_id is not null and embedding is not null and size(embedding) = 64").groupBy("chunk_id").agg(F.max_by("embedding", F.struct("embedded_at", "embedding")).alias("embedding"))


def self_probe(s, d):
    """Whether the vectors answer two probes: the mirror images of the first two."""
    v = _latest(s, d)
    ids = v.groupBy().agg(F.min("chunk_id").alias("a"), F.max("chunk_id").alias("b"))
    probes = v.join(F.broadcast(ids), (F.col("chunk_id") == F.col("a")) | (F.col("chunk_id") == F.col("b"))).select(F.col("chunk_id").alias("probe"), F.transform("embedding", lambda x: -x).alias("embedding"))
    return I.probe(probes, v)


PROBE_SQL = (
    "WITH v AS (SELECT chunk_id, arg_max(embedding, {'t': embedded_at, 'e': embedding})::DOUBLE[] AS e FROM chunk_vectors WHERE chunk_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64 GROUP BY 1), p AS (SELECT e FROM v WHERE chunk_id = (SELECT min(chunk_id) FROM v) OR chunk_id = (SELECT max(chunk_id) FROM v)), "
    "m AS (SELECT min(list_sum(list_transform(list_zip(p.e, v.e), lambda x: (x[1] + x[2]) * (x[1] + x[2])))) AS b FROM p, v) SELECT b <= 1.48 AS ok, round(b, 6) AS best_distance, CASE WHEN b <= 1.48 THEN 'ok' ELSE 'weak_best_hit' END AS message FROM m"
)

# --- extraction from the raw library ---


def raw_mail(s, d):
    """An e-mail address for each source as the preferred one, and for a file that is not there."""
    names = repeated(s, d).where("source_name is not null").select("source_name").distinct()
    q = names.select(F.col("source_name").alias("query_id"), F.lit("email").alias("kind"), F.upper("source_name").alias("preferred"))
    return E.raw_fields(repeated(s, d), q).select("query_id", "source_name", "value")


_MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
RAW_SQL = S.EMAIL_SQL.replace("SELECT source_name, value, document_id FROM v WHERE", ", w AS (SELECT source_name, value FROM v WHERE source_name IS NOT NULL AND").replace("(PARTITION BY source_name ORDER BY document_id, n) = 1", "(PARTITION BY source_name ORDER BY document_id, n) = 1)") + (
    f", y2 AS (SELECT source_name, regexp_extract(text, '\\b({_MAIL})\\b', 1) AS value FROM seg WHERE source_name IS NOT NULL AND regexp_matches(text, '\\b{_MAIL}\\b') QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY document_id) = 1), "
    "b AS (SELECT source_name, coalesce(w.value, y2.value) AS value FROM y2 FULL JOIN w USING (source_name)), g AS (SELECT * FROM b ORDER BY source_name LIMIT 1), n AS (SELECT DISTINCT source_name FROM seg WHERE source_name IS NOT NULL) "
    "SELECT n.source_name AS query_id, coalesce(b.source_name, g.source_name) AS source_name, coalesce(b.value, g.value) AS value FROM n LEFT JOIN b ON b.source_name = n.source_name CROSS JOIN g"
)

ENTITIES = (("finance", "company", "The Finance House"), ("harbour", "company", "The Harbour Office"), ("anna", "person", "Anna"), ("auditor", "role", "Auditor"), ("inspector", "role", "Inspector"), ("project ember", "project", "Ember"), ("project lantern", "project", "Lantern"))


def entity_overviews(s, d):
    """Overviews by the known names in a library's texts."""
    known = s.createDataFrame(list(ENTITIES), "part string, kind string, name string")
    return E.entity_overview(repeated(s, d).select("document_id", "text").dropDuplicates(["document_id"]), known, "document_id")


ENTITY_SQL = (
    f"WITH {SEGMENTS}, e AS (SELECT * FROM (VALUES {', '.join(f'({lit(a)}, {lit(b)}, {lit(c)})' for a, b, c in ENTITIES)}) t(part, kind, name)), "
    "f AS (SELECT document_id, list_sort(list_distinct(list(name) FILTER (kind = 'company'))) AS c, list_sort(list_distinct(list(name) FILTER (kind = 'person'))) AS p, list_sort(list_distinct(list(name) FILTER (kind = 'role'))) AS r, list_sort(list_distinct(list(name) FILTER (kind = 'project'))) AS j FROM seg JOIN e ON contains(lower(text), part) GROUP BY 1) "
    "SELECT document_id, concat_ws(', ', 'This document provides an overview of ' || array_to_string(list_concat(coalesce(c, []), coalesce(p, [])), ' and '), CASE WHEN len(r) > 1 THEN 'including roles as ' || array_to_string(r, ' and ') WHEN len(r) = 1 THEN 'including the role of ' || r[1] END, CASE WHEN len(j) > 0 THEN 'projects such as ' || array_to_string(j, ' and ') END) || '.' AS answer FROM f WHERE len(coalesce(c, [])) + len(coalesce(p, [])) > 0"
)

# --- files ---


def read_text_files(s, d):
    """Texts written as files and read again: their segments, and what cannot be read as an error."""
    rows = segments(s, d).select(F.concat(F.lit("/library/"), "document_id", F.when(F.col("file_type") == "txt", ".TXT").otherwise(".pdf")).alias("path"), F.encode("text", "utf-8").alias("content"))
    return files.segments_of(rows).select("source_name", "file_type", "document_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.col("error").isNotNull().alias("failed"))


FILES_SQL = f"WITH {SEGMENTS}, n AS (SELECT document_id, file_type = 'txt' AS t, nullif({normalize_sql('text')}, '') AS x FROM seg) SELECT document_id || CASE WHEN t THEN '.TXT' ELSE '.pdf' END AS source_name, CASE WHEN t THEN 'txt' ELSE 'pdf' END AS file_type, document_id || CASE WHEN t THEN '_txt' ELSE '_pdf' END AS document_id, CASE WHEN t THEN sha256(x) END AS sha, NOT t AS failed FROM n"


def _uploads(s, d):
    rows = segments(s, d).select("document_id", "file_type", F.encode(F.when(F.pmod(F.length("text"), F.lit(9)) > 0, F.col("text")).otherwise(""), "utf-8").alias("content"))
    name = F.when(F.pmod(F.length("document_id"), F.lit(5)) == 0, F.concat(F.lit("../"), "document_id")).otherwise(F.col("document_id"))
    return rows.select(F.concat(name, F.lit("."), F.coalesce("file_type", F.lit("exe"))).alias("name"), "content")


def upload_outcomes(s, d):
    """Segments as uploads; every third is there already."""
    new = _uploads(s, d)
    old = new.where("length(content) % 3 = 0").select("name", F.sha2("content", 256).alias("sha"))
    return L.upload_outcomes(new, old).select("name", "outcome")


_SAFE = (
    "(trim(name) <> '' AND name NOT IN ('.', '..') AND NOT regexp_matches(name, '[/\\\\\\x00-\\x1f]') AND lower(regexp_replace(name, '\\..*$', '')) NOT IN ('con','prn','aux','nul','com1','com2','com3','com4','com5','com6','com7','com8','com9','lpt1','lpt2','lpt3','lpt4','lpt5','lpt6','lpt7','lpt8','lpt9') AND lower(regexp_extract(name, '\\.([^.]+)$', 1)) IN ('pdf','docx','txt'))"
)
UPLOADS_SQL = (
    f"WITH {SEGMENTS}, u AS (SELECT CASE WHEN length(document_id) % 5 = 0 THEN '../' ELSE '' END || document_id || '.' || coalesce(file_type, 'exe') AS name, strlen(CASE WHEN length(text) % 9 > 0 THEN text ELSE '' END) AS size FROM seg) "
    f"SELECT name, CASE WHEN NOT {_SAFE} OR size = 0 THEN 'rejected' WHEN size % 3 = 0 THEN 'duplicate_unchanged' ELSE 'saved' END AS outcome FROM u"
)


def upload_rollup(s, d):
    return L.upload_rollup(upload_outcomes(s, d))


def evidence_windows(s, d):
    from .text_queries import evidence_windows as of

    return of(s, d)


_T = "trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"
WINDOW_SQL = (
    f"WITH {STORED}, h AS (SELECT DISTINCT turn_id, chunk_id FROM hits WHERE turn_id IS NOT NULL AND chunk_id IS NOT NULL), {TURNS}, x AS (SELECT turn_id, chunk_id, {_T} AS t, {keywords_sql("coalesce(message, '')")} AS k FROM h JOIN (SELECT turn_id, message FROM t) q USING (turn_id) JOIN (SELECT chunk_id, text FROM stored) c USING (chunk_id)), "
    "y AS (SELECT *, length(t) AS n, list_filter(list_transform(k, lambda w: instr(lower(t), w)), lambda i: i > 0)[1] - 1 AS a FROM x), z AS (SELECT *, least(n, greatest(0, a - 150) + 300) AS e FROM y), "
    "w AS (SELECT turn_id, chunk_id, CASE WHEN n <= 300 THEN t WHEN a IS NOT NULL THEN CASE WHEN greatest(0, e - 300) > 0 THEN '...' ELSE '' END || trim(substring(t, greatest(0, e - 300) + 1, e - greatest(0, e - 300))) || CASE WHEN e < n THEN '...' ELSE '' END ELSE rtrim(left(t, 200)) || chr(10) || '...' || chr(10) || ltrim(right(t, 120)) END AS w FROM z) "
    "SELECT turn_id, chunk_id, sha256(w) AS window_sha, length(w) AS chars FROM w"
)


def _shape_sql() -> str:
    timed = "\\b(today|latest|news|current|recent|price|stock|market|weather|breaking|who is|who was|when did|20[2-3]\\d)\\b"
    return (
        f"WITH {ASKED}, a AS (SELECT query_id, trim(text) AS q, trim({query_sql('text')}) AS r FROM asked), b AS (SELECT *, coalesce(nullif(regexp_replace(q, '^(please|can you|could you|tell me|i want to know|i need to know|help me)\\s+', '', 'gi'), ''), r) AS b0 FROM a), "
        f"c AS (SELECT *, {collapse_sql("CASE WHEN length(b0) > 160 AND length(r) <= 160 THEN r WHEN length(b0) > 200 THEN regexp_replace(left(b0, 200), ' [^ ]*$', '') ELSE b0 END")} AS b1 FROM b) "
        f"SELECT query_id, left(CASE WHEN regexp_matches(q, {lit(timed)}, 'i') AND NOT regexp_matches(b1, '\\b20[2-3]\\d\\b') THEN b1 || ' 2024' ELSE b1 END, 220) AS shaped FROM c"
    )


QUERIES = {
    "task_contexts": (task_contexts, CONTEXT_SQL), "task_notes": (task_notes, NOTES_SQL), "prompt_messages": (prompt_messages, PROMPTS_SQL), "turn_payloads": (turn_payloads, PAYLOAD_SQL), "hit_rows": (hit_rows, HIT_ROWS_SQL), "unknown_fallbacks": (unknown_fallbacks, _fallback_sql()), "eval_report": (eval_report, REPORT_SQL),
    "index_statuses": (index_statuses, STATUS_SQL), "probe_statuses": (probe_statuses, f"WITH {L.HEALTH_SQL} SELECT source_name, CASE WHEN expected = 0 THEN 'failed' ELSE 'ready_limited' END AS status FROM health"), "status_counts": (status_counts, COUNTS_SQL), "needs_sync": (needs_sync, SYNC_SQL),
    "manifest_prune": (manifest_prune, f"WITH {L.HEALTH_SQL} SELECT source_name, status FROM health WHERE source_name IN (SELECT source_name FROM segments WHERE source_name IS NOT NULL)"), "self_probe": (self_probe, PROBE_SQL), "raw_mail": (raw_mail, RAW_SQL), "entity_overviews": (entity_overviews, ENTITY_SQL),
    "read_text_files": (read_text_files, FILES_SQL), "upload_outcomes": (upload_outcomes, UPLOADS_SQL), "upload_rollup": (upload_rollup, f"WITH o AS ({UPLOADS_SQL}), c AS (SELECT count(*) FILTER (outcome = 'saved') AS saved, count(*) FILTER (outcome = 'duplicate_unchanged') AS duplicate_unchanged, count(*) FILTER (outcome = 'rejected') AS rejected FROM o) SELECT *, CASE WHEN saved > 0 AND rejected = 0 THEN 'success' WHEN saved > 0 THEN 'partial_success' WHEN duplicate_unchanged > 0 THEN CASE WHEN rejected > 0 THEN 'partial_success' ELSE 'no_op' END ELSE 'failed' END AS status FROM c"),
    "upload_name_check": (S.name_check, f"SELECT DISTINCT source_name, {_SAFE.replace('name', 'source_name')} AS safe FROM segments WHERE source_name IS NOT NULL"), "evidence_windows": (evidence_windows, WINDOW_SQL), "field_values": (S.field_values, FIELDS_SQL), "contact_bundle": (S.contact_bundles, BUNDLE_SQL), "overview_answers": (S.overviews, OVERVIEW_SQL), "web_query_shape": (S.web_queries, _shape_sql()),
}
