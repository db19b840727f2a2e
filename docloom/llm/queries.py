"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from . import conversations, leaks, mixing, neardup, neighbours, pairs, pii, scans, sentences, splitter


def given_parents(messages: DataFrame) -> DataFrame:
    """``id, parent`` of the messages: the one before in the session, or another two before (branches), or, as damage,
    one that is no row (orphans), itself or the next one (cycles)."""
    w = Window.partitionBy("session_id").orderBy("id")
    of = messages.where("id is not null and session_id is not null").groupBy("id").agg(F.min("session_id").alias("session_id"))
    kind = F.pmod(F.col("id"), F.lit(89))
    parent = F.when(kind == 3, -F.col("id")).when(kind == 5, F.col("id")).when(kind == 7, F.lead("id").over(w)).when(kind > 80, F.lag("id", 2).over(w)).otherwise(F.lag("id").over(w))
    return of.select("id", parent.alias("parent"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    t = table
    return {
        "p1_found": lambda s, d: scans.found(t(s, d, "segments")),
        "p1_repaired": lambda s, d: scans.repair(t(s, d, "segments")),
        "p2_found": lambda s, d: neardup.found(t(s, d, "chunks")),
        "p2_groups": lambda s, d: neardup.groups(t(s, d, "chunks")),
        "p2_pruning": lambda s, d: neardup.pruning(t(s, d, "chunks")),
        "p3_found": lambda s, d: conversations.found(t(s, d, "chat_messages"), t(s, d, "chat_sessions")),
        "p3_conversations": lambda s, d: conversations.conversations(t(s, d, "chat_messages"), t(s, d, "chat_sessions")),
        "p3_threads": lambda s, d: conversations.resolve(given_parents(t(s, d, "chat_messages"))),
        "p3_paths": lambda s, d: conversations.paths(given_parents(t(s, d, "chat_messages"))),
        "p4_found": lambda s, d: neighbours.found(t(s, d, "chunk_vectors")),
        "p4_neighbours": lambda s, d: neighbours.neighbours(t(s, d, "chunk_vectors")).withColumn("distance", F.round("distance", 5)),
        "p5_found": lambda s, d: pairs.find_defects(t(s, d, "chat_turns")),
        "p5_by_mode": lambda s, d: pairs.by_mode(t(s, d, "chat_turns")),
        "p10_found": lambda s, d: sentences.split_sentences(t(s, d, "documents")),
        "p10_sentences": lambda s, d: sentences.split_sentences(t(s, d, "documents"), with_text=True),
        "p6_found": lambda s, d: splitter.found(t(s, d, "segments")),
        "p6_pieces": lambda s, d: splitter.split(t(s, d, "segments")),
        "p7_found": lambda s, d: pii.found(t(s, d, "segments"), t(s, d, "chat_messages")),
        "p7_redacted": lambda s, d: pii.redacted(t(s, d, "segments"), t(s, d, "chat_messages")),
        "p8_found": lambda s, d: leaks.found(t(s, d, "documents"), t(s, d, "eval_items")),
        "p8_leaks": lambda s, d: leaks.leaks(t(s, d, "documents"), t(s, d, "eval_items")),
        "p9_found": lambda s, d: mixing.found(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p9_shares": lambda s, d: mixing.shares(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p9_budgets": lambda s, d: mixing.word_budgets(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p9_word_mixture": lambda s, d: mixing.word_mixture(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p9_mixture": lambda s, d: mixing.mix(t(s, d, "documents"), t(s, d, "mix_targets")),
    }


BLANK = "' ' || chr(9) || chr(10) || chr(13)"

P3_FOUND = f"""
WITH m AS (
  SELECT DISTINCT ON (id) id, lower(trim(session_id, {BLANK})) AS s, content,
    CASE WHEN lower(trim(role, {BLANK})) IN {conversations.USER_ROLES} THEN 'user'
         WHEN lower(trim(role, {BLANK})) IN {conversations.ASSISTANT_ROLES} THEN 'assistant'
         WHEN lower(trim(role, {BLANK})) IN {conversations.SYSTEM_ROLES} THEN 'system' ELSE 'other' END AS r
  FROM chat_messages WHERE id IS NOT NULL AND session_id IS NOT NULL),
k AS (SELECT *, lag(r) OVER w AS pr, lag(content) OVER w AS pc FROM m WHERE r <> 'system' WINDOW w AS (PARTITION BY s ORDER BY id)),
g AS (SELECT s, id, r, coalesce(trim(content, {BLANK}) <> '', false) AS has FROM k WHERE pr IS NULL OR NOT (pr = r AND pc IS NOT DISTINCT FROM content)),
u AS (SELECT *, lag(r) OVER w AS pr, lead(r) OVER w AS nr, lead(has) OVER w AS nh FROM g WHERE r <> 'other' WINDOW w AS (PARTITION BY s ORDER BY id)),
a AS (SELECT s, bool_or(has) AS has, bool_or(r = 'user' AND NOT coalesce(nr = 'assistant' AND nh, false)) AS missing,
        bool_or(r = 'assistant' AND coalesce(pr, 'assistant') = 'assistant') AS broken FROM u GROUP BY s),
o AS (SELECT DISTINCT s FROM g WHERE r = 'other'),
c AS (SELECT DISTINCT lower(trim(id, {BLANK})) AS s FROM chat_sessions WHERE id IS NOT NULL),
v AS (SELECT s FROM c UNION SELECT s FROM g),
f AS (SELECT v.s, coalesce(a.has, false) AS has, coalesce(a.missing, false) AS missing,
        coalesce(a.broken, false) OR o.s IS NOT NULL OR c.s IS NULL AS broken
      FROM v LEFT JOIN a USING (s) LEFT JOIN o ON o.s = v.s LEFT JOIN c ON c.s = v.s)
SELECT s AS session_id, 'empty' AS defect FROM f WHERE NOT has
UNION ALL SELECT s, 'missing_reply' FROM f WHERE has AND missing
UNION ALL SELECT s, 'broken' FROM f WHERE has AND broken
"""

P6_FOUND = f"""
WITH d AS (SELECT DISTINCT document_id, trim(text, {BLANK}) AS t FROM segments WHERE text IS NOT NULL),
n AS (SELECT document_id, replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS n, t FROM d WHERE length(t) > 900),
l AS (SELECT document_id,
  list_max(list_transform(regexp_split_to_array(n, '\\n(?:[ \\t]*\\n)+'), lambda x: length(trim(x, {BLANK})))) AS p,
  list_max(list_transform(string_split(n, chr(10)), lambda x: length(trim(x, {BLANK})))) AS l,
  list_max(list_transform(regexp_split_to_array(n, '[ \\t\\n]+'), lambda x: length(x))) AS w FROM n)
SELECT document_id, CASE WHEN p <= 900 THEN 'paragraph' WHEN l <= 900 THEN 'line' WHEN w <= 900 THEN 'word' ELSE 'unbroken' END AS cut_level FROM l
"""

P8_FOUND = """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS a FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS a FROM eval_items WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(list_transform(range(1, len(a) - 10), lambda i: array_to_string(a[i:i+11], ' '))) AS g FROM w WHERE len(a) >= 12),
y AS (SELECT item_id, unnest(list_transform(range(1, len(a) - 10), lambda i: array_to_string(a[i:i+11], ' '))) AS g FROM e WHERE len(a) >= 12)
SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (g)
"""

_P8_TABLE = """SELECT {key} AS k, regexp_extract_all(text, '[\\pL\\pN]+') AS c, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS l FROM {table} WHERE text IS NOT NULL AND {key} IS NOT NULL"""
_P8_TYPED = """SELECT k, CASE WHEN len(c) = len(l) THEN c ELSE l END AS c, l, list_transform(l, lambda w: CASE WHEN regexp_matches(w, '\\p{{Nd}}') THEN '<number>'
  WHEN w IN ('january','february','march','april','may','june','july','august','september','october','november','december') THEN '<month>'
  WHEN w IN ('percent','hours','hour','days','day','weeks','week','minutes','minute','seconds','second','years','year','kg','g','km','m','cm','mm','mb','gb','tb','kb','ms','eur','usd','dollars','euros','metres','meters','miles','litres','pages') THEN '<unit>'
  WHEN list_contains(v.words, w) THEN '' ELSE '<name>' END) AS t FROM {table}, v WHERE len(l) >= 12"""
_P8_WINDOWS = """SELECT DISTINCT k, unnest(list_transform(range(1, len(l) - 10), lambda i: {{'c': c[i:i+11], 'l': l[i:i+11], 't': t[i:i+11],
  'h': CASE WHEN len(list_filter(t[i:i+11], lambda x: x = '')) >= 5 THEN array_to_string(list_transform(range(i, i + 12), lambda j: CASE WHEN t[j] = '' THEN l[j] ELSE t[j] END), ' ') ELSE '= ' || array_to_string(l[i:i+11], ' ') END}})) AS w FROM {table}"""
P8_LEAKS = f"""
WITH d0 AS ({_P8_TABLE.format(key="doc_id", table="documents")}), e0 AS ({_P8_TABLE.format(key="item_id", table="eval_items")}),
v AS (SELECT list_distinct(list(lower(w))) AS words FROM (SELECT unnest(c) AS w FROM e0) WHERE left(w, 1) = lower(left(w, 1)) AND left(w, 1) <> upper(left(w, 1))),
d1 AS ({_P8_TYPED.format(table="d0")}), e1 AS ({_P8_TYPED.format(table="e0")}), d AS ({_P8_WINDOWS.format(table="d1")}), e AS ({_P8_WINDOWS.format(table="e1")}),
b AS (SELECT d.k AS doc_id, e.k AS item_id, d.w.l AS a, e.w.l AS b, list_filter(list_zip(d.w.l, e.w.l, d.w.t, d.w.c, e.w.c), lambda x: x[3] <> '') AS s FROM d JOIN e ON d.w.h = e.w.h),
c AS (SELECT doc_id, item_id, a, min(CASE WHEN a = b THEN 0
  WHEN len(list_distinct(list_transform(s, lambda x: x[1] || ' ' || x[2]))) = len(list_distinct(list_transform(s, lambda x: x[1])))
   AND len(list_distinct(list_transform(s, lambda x: x[1]))) = len(list_distinct(list_transform(s, lambda x: x[2])))
   AND len(list_filter(s, lambda x: x[3] = '<name>' AND x[1] <> x[2] AND (left(x[4], 1) = lower(left(x[4], 1)) OR left(x[5], 1) = lower(left(x[5], 1))))) = 0 THEN 1 ELSE 2 END) AS kind FROM b GROUP BY ALL)
SELECT doc_id, item_id, count(*) FILTER (kind = 0) AS literal_windows, count(*) FILTER (kind = 1) AS template_windows FROM c WHERE kind < 2 GROUP BY ALL
"""

P2_FOUND = """
WITH c AS (SELECT DISTINCT ON (chunk_id) chunk_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS a FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT chunk_id, list_distinct(list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2])) AS g FROM c WHERE len(a) >= 20),
n AS (SELECT chunk_id, len(g) AS n FROM s), x AS (SELECT chunk_id, unnest(g) AS w FROM s),
p AS (SELECT l.chunk_id AS a, r.chunk_id AS b, count(*) AS k FROM x l JOIN x r ON l.w = r.w AND l.chunk_id < r.chunk_id GROUP BY ALL HAVING count(*) > 6)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM p JOIN n na ON na.chunk_id = a JOIN n nb ON nb.chunk_id = b WHERE k >= 0.5 * (na.n + nb.n - k)
"""

P2_GROUPS = """
WITH c AS (SELECT DISTINCT ON (chunk_id) chunk_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS a FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT chunk_id, list_sort(list_distinct(list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2]))) AS g FROM c WHERE len(a) >= 20),
k AS (SELECT min(chunk_id) AS r, count(*) AS copies, g FROM s GROUP BY g),
n AS (SELECT r, len(g) AS n FROM k), x AS (SELECT r, unnest(g) AS w FROM k),
p AS (SELECT l.r AS a, q.r AS b, count(*) AS k FROM x l JOIN x q ON l.w = q.w AND l.r <> q.r GROUP BY ALL HAVING count(*) > 6),
l AS (SELECT a AS r, count(*) AS links FROM p JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE k >= 0.5 * (na.n + nb.n - k) GROUP BY a)
SELECT s.chunk_id, k.r AS representative, k.copies, coalesce(links, 0) AS links FROM s JOIN k USING (g) LEFT JOIN l ON l.r = k.r
"""

P4_NEIGHBOURS = """
WITH l AS (SELECT chunk_id, arg_max({'v': embedding}, coalesce(embedded_at, TIMESTAMP '1970-01-01')) AS r FROM chunk_vectors WHERE chunk_id IS NOT NULL GROUP BY 1),
v AS (SELECT chunk_id, r.v::DOUBLE[] AS e FROM l WHERE len(r.v) = 64 AND len(list_filter(r.v, lambda x: x <> 0)) > 0 AND len(list_filter(r.v, lambda x: x IS NULL)) = 0),
d AS (SELECT p.chunk_id AS a, q.chunk_id AS b, list_sum(list_transform(list_zip(p.e, q.e), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM v p JOIN v q ON p.chunk_id <> q.chunk_id AND list_distance(p.e, q.e) < 0.51)
SELECT a AS chunk_id, b AS other_id, row_number() OVER (PARTITION BY a ORDER BY d, b)::INT AS rank, round(d, 5) AS distance FROM d WHERE d <= 0.25 QUALIFY rank <= 5
"""

P4_FOUND = """
WITH l AS (SELECT chunk_id, arg_max({'v': embedding}, coalesce(embedded_at, TIMESTAMP '1970-01-01')) AS r FROM chunk_vectors WHERE chunk_id IS NOT NULL GROUP BY 1),
v AS (SELECT chunk_id, r.v::DOUBLE[] AS e FROM l WHERE len(r.v) = 64 AND len(list_filter(r.v, lambda x: x <> 0)) > 0 AND len(list_filter(r.v, lambda x: x IS NULL)) = 0),
d AS (SELECT p.chunk_id AS a, q.chunk_id AS b, list_sum(list_transform(list_zip(p.e, q.e), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM v p JOIN v q ON p.chunk_id <> q.chunk_id AND list_distance(p.e, q.e) < 0.51),
k AS (SELECT a, b FROM d WHERE d <= 0.25 QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 5)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM k
"""

P3_CONVERSATIONS = f"""
WITH bad AS (SELECT DISTINCT session_id FROM ({P3_FOUND})),
m AS (
  SELECT DISTINCT ON (id) id, lower(trim(session_id, {BLANK})) AS s, content,
    CASE WHEN lower(trim(role, {BLANK})) IN {conversations.USER_ROLES} THEN 'user'
         WHEN lower(trim(role, {BLANK})) IN {conversations.ASSISTANT_ROLES} THEN 'assistant'
         WHEN lower(trim(role, {BLANK})) IN {conversations.SYSTEM_ROLES} THEN 'system' ELSE 'other' END AS r
  FROM chat_messages WHERE id IS NOT NULL AND session_id IS NOT NULL),
k AS (SELECT *, lag(r) OVER w AS pr, lag(content) OVER w AS pc FROM m WHERE r <> 'system' WINDOW w AS (PARTITION BY s ORDER BY id)),
g AS (SELECT s, id, r, content FROM k WHERE (pr IS NULL OR NOT (pr = r AND pc IS NOT DISTINCT FROM content)) AND s NOT IN (SELECT session_id FROM bad))
SELECT s AS session_id, min(id) OVER (PARTITION BY s) AS root, row_number() OVER (PARTITION BY s ORDER BY id) - 1 AS turn, r AS speaker, content, count(*) OVER (PARTITION BY s) AS turns FROM g
"""

_GIVEN = """
WITH RECURSIVE m AS (SELECT id, min(session_id) AS s FROM chat_messages WHERE id IS NOT NULL AND session_id IS NOT NULL GROUP BY id),
g AS (SELECT id, CASE id % 89 WHEN 3 THEN -id WHEN 5 THEN id WHEN 7 THEN lead(id) OVER w ELSE CASE WHEN id % 89 > 80 THEN lag(id, 2) OVER w ELSE lag(id) OVER w END END AS parent FROM m WINDOW w AS (PARTITION BY s ORDER BY id)),
r AS (SELECT g.id, g.id AS root, 0 AS depth, CASE WHEN g.parent IS NULL THEN 'ok' ELSE 'orphan' END AS state FROM g LEFT JOIN g p ON g.parent = p.id WHERE p.id IS NULL
  UNION ALL SELECT g.id, r.root, r.depth + 1, r.state FROM r JOIN g ON g.parent = r.id)
"""
P3_THREADS = _GIVEN + "SELECT g.id, root, depth, coalesce(state, 'cycle') AS state FROM g LEFT JOIN r USING (id)"
P3_PATHS = _GIVEN + """, x AS (SELECT id AS leaf, id, root, depth FROM r WHERE state = 'ok' AND id NOT IN (SELECT parent FROM g WHERE parent IS NOT NULL AND id IN (SELECT id FROM r WHERE state = 'ok'))
  UNION ALL SELECT leaf, p.id, x.root, p.depth FROM x JOIN g USING (id) JOIN r p ON p.id = g.parent)
SELECT leaf, root, depth AS turn, id FROM x"""

# No source lies near its bound, so words and marks stand in for the tokenizer's tokens.
P9_FOUND = f"""
WITH d AS (SELECT DISTINCT ON (doc_id) lower(trim(source, {BLANK})) AS source, len(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]+|[^a-zA-Z\\s]')) AS n FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL),
t AS (SELECT lower(trim(source, {BLANK})) AS source, target_weight, max_repeats FROM mix_targets), n AS (SELECT t.source, target_weight, max_repeats, coalesce(sum(n), 0) AS n FROM t LEFT JOIN d USING (source) GROUP BY ALL)
SELECT source FROM n WHERE n * max_repeats < target_weight * (SELECT sum(n) FROM n)
"""

# Leaves, then the level of each family (domain, language, source) that its members fill up to within their capacities.
_P9_LEVELS = f"""
WITH d AS (SELECT DISTINCT ON (doc_id) doc_id, lower(trim(source, {BLANK})) AS source, coalesce(nullif(lower(trim(lang, {BLANK})), ''), 'und') AS lang, len(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]+|[^a-zA-Z\\s]')) AS n FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL),
t AS (SELECT lower(trim(source, {BLANK})) AS source, max(target_weight) AS tw, max(max_repeats) AS most FROM mix_targets WHERE source IS NOT NULL GROUP BY 1),
h AS (SELECT source, lang, sum(n) AS n FROM d GROUP BY ALL),
l AS (SELECT t.source, coalesce(lang, 'und') AS lang, coalesce(n, 0) AS n, tw * CASE WHEN sum(n) OVER (PARTITION BY t.source) > 0 THEN n / sum(n) OVER (PARTITION BY t.source) ELSE 1 / count(*) OVER (PARTITION BY t.source) END AS w, coalesce(n, 0) * most AS c FROM t LEFT JOIN h USING (source)),
a AS (SELECT sum(n) AS total FROM l),
n1 AS (SELECT lang, sum(w) AS w, sum(c) AS c, least(sum(sum(c)) OVER (), (SELECT total FROM a)) AS b FROM l GROUP BY lang),
v1 AS (SELECT *, (b - coalesce(sum(c) OVER (ORDER BY c / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY c / w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM n1),
b1 AS (SELECT lang, least(c, w * (SELECT max(v) FROM v1)) AS b FROM v1),
n2 AS (SELECT lang, source, sum(w) AS w, sum(c) AS c, any_value(b) AS b FROM l JOIN b1 USING (lang) GROUP BY ALL),
v2 AS (SELECT *, (b - coalesce(sum(c) OVER (PARTITION BY lang ORDER BY c / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY lang ORDER BY c / w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM n2),
b2 AS (SELECT lang, source, least(c, w * max(v) OVER (PARTITION BY lang)) AS b FROM v2)
"""
P9_BUDGETS = _P9_LEVELS + """
SELECT source, sum(n)::BIGINT AS tokens, round(sum(w) * any_value(total))::BIGINT AS wanted, round(sum(b))::BIGINT AS budget, sum(c) < sum(w) * any_value(total) * (1 - 1e-9) AS short
FROM l JOIN b2 USING (lang, source) CROSS JOIN a GROUP BY source
"""
# Whole epochs of a leaf while its budget lasts, then a part of one; of each the documents by their drawn place.
P9_WORD_MIXTURE = _P9_LEVELS + """,
q AS (SELECT l.lang, l.source, l.n, b, most, least(floor(b / l.n + 1e-9), most)::INT AS whole FROM l JOIN b2 USING (lang, source) JOIN t USING (source) WHERE l.n > 0 AND b > 0),
e AS (SELECT lang, source, n, b, whole, unnest(range(0, whole + CASE WHEN whole < most AND b - whole * n > 1e-6 THEN 1 ELSE 0 END)) AS epoch FROM q),
m AS (SELECT d.doc_id, d.source, d.lang, e.epoch, d.n AS tokens, CASE WHEN e.epoch < e.whole THEN e.n ELSE e.b - e.whole * e.n END AS budget, ('0x' || md5('7:' || e.epoch || ':' || d.doc_id)[1:15])::BIGINT AS h FROM d JOIN e USING (lang, source) WHERE d.n > 0)
SELECT doc_id, source, lang, epoch::INT AS epoch, tokens FROM m QUALIFY coalesce(sum(tokens) OVER (PARTITION BY source, lang, epoch ORDER BY h % 4096, h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < budget
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": P2_FOUND, "p2_groups": P2_GROUPS, "p3_found": P3_FOUND, "p3_conversations": P3_CONVERSATIONS, "p3_threads": P3_THREADS, "p3_paths": P3_PATHS, "p4_found": P4_FOUND, "p4_neighbours": P4_NEIGHBOURS, "p6_found": P6_FOUND, "p8_found": P8_FOUND, "p8_leaks": P8_LEAKS, "p9_found": P9_FOUND, "p9_budgets": P9_BUDGETS, "p9_word_mixture": P9_WORD_MIXTURE,
    }
