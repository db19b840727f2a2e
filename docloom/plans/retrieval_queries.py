"""Queries of the retrieval core, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import queries as Q
from ..operators import index as I
from ..operators import library as L
from ..operators import ranking as R
from ..session import table
from .text_queries import STORED, has_sql, query_sql


def hits(s: SparkSession, d: str) -> DataFrame:
    """Logged hits as ``query_id, rank, chunk_id, ...``; a repeated row counts once, sentinel distances are kept."""
    return table(s, d, "hits").where("turn_id is not null and chunk_id is not null").withColumnRenamed("turn_id", "query_id").dropDuplicates(["query_id", "rank", "chunk_id"])


HITS = "h AS (SELECT DISTINCT ON (turn_id, rank, chunk_id) turn_id AS query_id, rank, page_content, source_name, chunk_id, page_number, distance, rrf_score FROM hits WHERE turn_id IS NOT NULL AND chunk_id IS NOT NULL)"
SCORE = "coalesce(rrf_score, 0.0) DESC, coalesce(distance, 2.5), rank, chunk_id"
MERGED = f"m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY {SCORE}) AS n FROM h) WHERE n = 1), merged AS (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY query_id ORDER BY {SCORE}) - 1 AS merged_rank FROM m)"
COMPOSITE = "(3.0::DOUBLE * coalesce(rrf_score, 0.0) + 1.0::DOUBLE / (1.0 + greatest(coalesce(distance, 2.5), 0.000001)))"
RERANKED = f"r AS (SELECT *, round({COMPOSITE}, 6) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY round({COMPOSITE}, 12) DESC, rank, coalesce(distance, 2.5), chunk_id) - 1 AS rerank_order FROM merged)"
WEAK = "((coalesce(distance, 2.5) >= 1.45 AND coalesce(rrf_score, 0.0) < 0.0095) OR coalesce(distance, 2.5) >= 1.62)"
CHAIN = f"WITH {HITS}, {MERGED}, {RERANKED}"


def reranked(s, d):
    return R.rerank(R.merge_pools(hits(s, d)))


def questions(s, d):
    return table(s, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("query").alias("text"))


def bm25_top(s, d):
    return I.bm25_top(questions(s, d), I.stored(table(s, d, "chunks"))).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


BM25 = (
    f"WITH {STORED}, t AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM stored), p AS (SELECT chunk_id, token, count(*) AS tf FROM t GROUP BY ALL), "
    "l AS (SELECT chunk_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM stored), g AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l), "
    "f AS (SELECT token, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, g GROUP BY token), i AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM f) ELSE raw END AS idf FROM f)"
)
SCORED = (
    ", a AS (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM asked2), "
    "s AS (SELECT query_id, chunk_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM a JOIN p USING (token) JOIN i USING (token) JOIN l USING (chunk_id), g GROUP BY ALL), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s QUALIFY rank <= 24)"
)


def idf_table(s, d):
    return I.inverse_frequencies(I.stored(table(s, d, "chunks"))).select("token", "df", F.round("idf", 9).alias("idf"))


def corpus_stats(s, d):
    return I.corpus_stats(I.stored(table(s, d, "chunks"))).select("n", F.round("avgdl", 6).alias("avgdl"))


def knn_l2(s, d):
    v = table(s, d, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return I.nearest(q, v, 24, "query_id", "vec_id").select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def fused(s, d):
    """Logged vector hits fused with the word index, for every hundredth turn."""
    turns = table(s, d, "chat_turns").where("turn_id % 100 = 0 and message is not null").dropDuplicates(["turn_id"]).select(F.col("turn_id").alias("query_id"), F.col("message").alias("text"))
    logged = R.merge_pools(hits(s, d).join(turns.select("query_id"), "query_id", "left_semi").where("distance is not null and distance < 2.5"))
    vector = I.top(logged.select("query_id", "chunk_id", "distance"), 24, [F.col("distance"), F.col("chunk_id")])
    return R.fuse(vector, I.bm25_top(turns, I.stored(table(s, d, "chunks"))), 18)


def hybrid_retrieve(s, d):
    return fused(s, d).select("query_id", "chunk_id", F.col("vector_rank").cast("long").alias("vector_rank"), F.col("bm25_rank").cast("long").alias("bm25_rank"), F.round("distance", 6).alias("distance"), "rrf_score", F.col("rank").cast("long").alias("rank"))


HYBRID = (
    BM25 + ", asked2 AS (SELECT DISTINCT turn_id AS query_id, message AS text FROM chat_turns WHERE turn_id % 100 = 0 AND message IS NOT NULL)" + SCORED
    + f", {HITS}, hv AS (SELECT * FROM h WHERE query_id IN (SELECT query_id FROM asked2) AND distance IS NOT NULL AND distance < 2.5), best AS (SELECT query_id, chunk_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY {SCORE}) AS n FROM hv) WHERE n = 1), "
    "v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM best QUALIFY rank <= 24), "
    "b AS (SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.chunk_id, k.chunk_id) AS chunk_id, v.rank AS vector_rank, k.rank AS bm25_rank, coalesce(v.distance, 2.5) AS distance, round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + k.rank), 0), 6) AS rrf_score FROM v FULL JOIN k ON v.query_id = k.query_id AND v.chunk_id = k.chunk_id) "
    "SELECT query_id, chunk_id, vector_rank, bm25_rank, round(distance, 6) AS distance, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM b QUALIFY rank <= 18"
)


def pool_merge(s, d):
    return R.merge_pools(hits(s, d)).select("query_id", "chunk_id", "distance", "rrf_score", F.col("merged_rank").cast("long").alias("merged_rank"))


def composite_rerank(s, d):
    return reranked(s, d).select("query_id", "chunk_id", "rerank_score", F.col("rerank_order").cast("long").alias("rerank_order"))


def weak_filter(s, d):
    return R.drop_weak(reranked(s, d)).select("query_id", "chunk_id", F.col("rerank_order").cast("long").alias("rerank_order"))


def round_robin(s, d):
    return R.interleave(R.drop_weak(reranked(s, d)), 10).select("query_id", "chunk_id", "source_name", F.col("context_order").cast("long").alias("context_order"))


ROUND_ROBIN = (
    f"{CHAIN}, f AS (SELECT *, count(*) FILTER (NOT {WEAK}) OVER (PARTITION BY query_id) AS strong, min(rerank_order) OVER (PARTITION BY query_id) AS first FROM r), k AS (SELECT *, coalesce(nullif(trim(source_name), ''), '_unknown') AS src FROM f WHERE NOT {WEAK} OR (strong = 0 AND rerank_order = first)), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY query_id, src ORDER BY rerank_order) AS turn, min(rerank_order) OVER (PARTITION BY query_id, src) AS fst FROM k) "
)


def focused(s, d):
    """Hits with the dominant source of their query first."""
    ranked = reranked(s, d)
    top = R.dominant_source(ranked, "rerank_order").select("query_id", F.col("source_name").alias("focus_source"))
    return R.focus(ranked.join(top, "query_id", "left"), 5).select("query_id", "chunk_id", F.col("context_order").cast("long").alias("context_order"))


def dominant(s, d):
    return R.dominant_source(hits(s, d)).select("query_id", "source_name", "hits", F.round("share", 6).alias("share"), "sources")


def usefulness_gate(s, d):
    top = reranked(s, d).where("rerank_order = 0")
    return top.select("query_id", *[F.coalesce(R.is_useful(p), F.lit(False)).alias(p) for p in R.PROFILES])


def gate_sql(profile: str) -> str:
    most, least, good, high, far = R.PROFILES[profile]
    d, rrf = "coalesce(distance, 2.5)", "coalesce(rrf_score, 0.0)"
    more = f" OR ({rrf} >= {high} AND {d} <= {far})" if high is not None else ""
    return f"CASE WHEN {rrf} > 0 THEN ({d} <= {most} AND {rrf} >= {least}){more} OR {d} <= {good} ELSE {d} <= 1.22 END"


def limited_sql(profile: str) -> str:
    most, least = R.LIMITED[profile]
    d, rrf = "coalesce(distance, 2.5)", "coalesce(rrf_score, 0.0)"
    near = f"({d} <= {most} AND {rrf} >= {least})"
    if profile == "strict":
        near += f" OR (same_source >= 2 AND {d} <= 1.02 AND {rrf} >= {least})"
    if profile == "broad":
        near += f" OR ({rrf} >= 0.02 AND {d} <= 1.55 AND {rrf} >= {least})"
    return f"(CASE WHEN {rrf} > 0 THEN ({near}) ELSE {d} <= 1.22 END)"


def status(s, d):
    return L.health(table(s, d, "chunks"), table(s, d, "chunk_vectors"))


def trust_filter(s, d):
    return R.trusted(hits(s, d), status(s, d)).select("query_id", "chunk_id", "rank")


def flagged(s, d):
    """Reranked hits with their query's relaxations."""
    turns = table(s, d, "chat_turns").dropDuplicates(["turn_id"]).select(F.col("turn_id").alias("query_id"), F.coalesce(Q.normalize_query(F.col("message")), F.lit("")).alias("q"))
    return reranked(s, d).join(turns.select("query_id", Q.uses_relaxed_gate(F.col("q")).alias("relaxed"), Q.is_entity_lookup(F.col("q")).alias("lookup")), "query_id")


def grounding(s, d):
    out = R.promote(flagged(s, d), status(s, d), F.col("relaxed"), F.col("lookup"))
    return out.where("promoted_order = 0").select("query_id", "chunk_id", "grounded", F.col("rerank_order").cast("long").alias("from_order"))


def grounding_sql() -> str:
    fallback = "(same_source >= 3 AND CASE WHEN coalesce(rrf_score, 0.0) <= 0 THEN coalesce(distance, 2.5) <= 1.22 ELSE coalesce(distance, 2.5) <= 1.15 AND coalesce(rrf_score, 0.0) >= 0.005 END)"
    useful = f"({gate_sql('strict')} OR (relaxed AND {gate_sql('broad')}) OR (lookup AND {gate_sql('lookup')}))"
    limited = f"({limited_sql('strict')} OR (relaxed AND {limited_sql('broad')}) OR (lookup AND {limited_sql('lookup')}) OR ((relaxed OR lookup) AND {fallback}))"
    from .text_queries import intents_sql

    flags = intents_sql("q")
    return (
        f"{CHAIN}, {L.HEALTH_SQL}, u AS (SELECT query_id, {flags['relaxed_gate']} AS relaxed, {flags['entity_lookup']} AS lookup FROM (SELECT DISTINCT turn_id AS query_id, coalesce({query_sql('message')}, '') AS q FROM chat_turns)), "
        "w AS (SELECT r.*, u.relaxed, u.lookup, row_number() OVER (PARTITION BY query_id ORDER BY rerank_order) - 1 AS place FROM r JOIN u USING (query_id)), "
        "c AS (SELECT *, count(*) FILTER (place < 8) OVER (PARTITION BY query_id, source_name) AS head, count(*) FILTER (place < 7) OVER (PARTITION BY query_id, source_name) AS short FROM w), "
        "e AS (SELECT c.*, CASE WHEN coalesce(trim(c.source_name), '') = '' THEN 0 WHEN place < 8 THEN head ELSE short + 1 END AS same_source, coalesce(health.status, 'uploaded') AS status, (SELECT count(*) FILTER (status = 'ready') = 0 FROM health) AS no_ready FROM c LEFT JOIN health ON trim(health.source_name) = trim(c.source_name)), "
        f"g AS (SELECT *, place <= 11 AND {useful} AND CASE WHEN coalesce(trim(source_name), '') = '' THEN CASE WHEN no_ready THEN {limited} ELSE true END WHEN status = 'ready' THEN true WHEN status IN ('failed', 'processing') THEN false WHEN status = 'ready_limited' THEN {limited} WHEN no_ready THEN {limited} ELSE true END AS ok FROM e), "
        "t AS (SELECT *, min(place) FILTER (ok) OVER (PARTITION BY query_id) AS top FROM g) "
        "SELECT query_id, chunk_id, top IS NOT NULL AS grounded, rerank_order AS from_order FROM t WHERE place = coalesce(top, 0)"
    )


def field_hits(s, d):
    asks = r"\b(name|email|e-?mail|phone|contact|website|url|homepage|address)\b"
    turns = table(s, d, "chat_turns").dropDuplicates(["turn_id"]).select(F.col("turn_id").alias("query_id"), F.coalesce(Q.has(F.lower("message"), asks), F.lit(False)).alias("asks_field"))
    out = R.field_priority(reranked(s, d).join(turns, "query_id"), "page_content")
    return out.select("query_id", "chunk_id", F.col("field_order").cast("long").alias("field_order"))


FIELD_SCORE = (
    "10 * regexp_matches(t, '(full\\s*name|e-?mail|email|phone|contact\\s*number|website|homepage|\\burl\\b|address)\\s*[:#\\-]', 'i')::INT + 2 * regexp_matches(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')::INT + regexp_matches(t, '\\b(?:\\+?\\d[\\d\\s().-]{8,})\\b')::INT"
)


def section_hits(s, d):
    q = F.lower("message")
    turns = table(s, d, "chat_turns").where("message is not null").dropDuplicates(["turn_id"]).select(F.col("turn_id").alias("query_id"), Q.section_number(q).alias("section_number"), (q.contains("disaster") & q.contains("recover")).alias("recovery"))
    out = R.section_priority(reranked(s, d).join(turns, "query_id"), "page_content")
    return out.select("query_id", "chunk_id", F.col("section_order").cast("long").alias("section_order"))


def context_limits(s, d):
    """Limits for every task on every turn with logged hits."""
    n = hits(s, d).groupBy("query_id").agg(F.count("*").cast("int").alias("n"))
    tasks = F.explode(F.array(*map(F.lit, ("qa", "summarize", "compare", "extract"))))
    return n.select("query_id", "n", tasks.alias("task")).select(
        "query_id", "task", R.context_limit(F.col("task"), F.lit(5), F.col("n"), F.lit(False)).cast("long").alias("chunks"), R.context_limit(F.col("task"), F.lit(5), F.col("n"), F.lit(True)).cast("long").alias("broad_chunks"), R.pool_size(F.col("n"), F.lit(5)).cast("long").alias("pool")
    )


def limit_sql(broad: int) -> str:
    return f"greatest(1, least(CASE task WHEN 'qa' THEN least(5, {broad}) WHEN 'summarize' THEN least(n, 10) WHEN 'compare' THEN least(n, 10) ELSE least(n, 5) END, n))"


def index_build(s, d):
    out = I.build(table(s, d, "chunks"), table(s, d, "chunk_vectors"))
    return out.select("pos", "chunk_id", "source_name")


def embedding_misses(s, d):
    return I.missing_vectors(table(s, d, "chunks"), table(s, d, "chunk_vectors")).select("sha", F.char_length("text").cast("long").alias("chars"))


_NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
SECTION_NUMBER = (
    "coalesce(nullif(regexp_extract(lower(message), 'section\\s*(?:#|number|num\\.?)?\\s*(\\d+)\\b', 1), ''), CASE "
    + " ".join(f"WHEN contains(lower(message), 'section') AND regexp_matches(lower(message), '\\b{w}\\b') THEN '{i}'" for i, w in enumerate(_NUMBERS, 1))
    + " END)"
)
QUERIES = {
    "bm25_topk": (bm25_top, BM25 + ", asked2 AS (SELECT item_id AS query_id, query AS text FROM eval_items)" + SCORED + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM k"),
    "idf_table": (idf_table, BM25 + " SELECT token, df, round(idf, 9) AS idf FROM i"),
    "corpus_stats": (corpus_stats, BM25 + " SELECT n, round(avgdl, 6) AS avgdl FROM g"),
    "knn_l2_topk": (
        knn_l2,
        "WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2)) AS d FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) SELECT query_id, vec_id, round(d, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM d QUALIFY rank <= 24",
    ),
    "hybrid_retrieve": (hybrid_retrieve, HYBRID),
    "pool_merge_best": (pool_merge, f"WITH {HITS}, {MERGED} SELECT query_id, chunk_id, distance, rrf_score, merged_rank FROM merged"),
    "composite_rerank": (composite_rerank, f"{CHAIN} SELECT query_id, chunk_id, rerank_score, rerank_order FROM r"),
    "weak_filter": (weak_filter, f"{ROUND_ROBIN} SELECT query_id, chunk_id, rerank_order FROM k"),
    "round_robin_sources": (round_robin, f"{ROUND_ROBIN} SELECT query_id, chunk_id, source_name, row_number() OVER (PARTITION BY query_id ORDER BY turn, fst) AS context_order FROM o QUALIFY context_order <= 10"),
    "dominant_source": (
        dominant,
        f"WITH {HITS}, c AS (SELECT query_id, trim(source_name) AS source_name, count(*) AS hits, min(rank) AS first FROM h WHERE coalesce(trim(source_name), '') <> '' GROUP BY ALL) SELECT query_id, source_name, hits, round(hits / sum(hits) OVER (PARTITION BY query_id), 6) AS share, count(*) OVER (PARTITION BY query_id) AS sources FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, first, source_name) = 1",
    ),
    "focus_source_first": (
        focused,
        f"{CHAIN}, c AS (SELECT query_id, trim(source_name) AS f, count(*) AS hits, min(rerank_order) AS first FROM r WHERE coalesce(trim(source_name), '') <> '' GROUP BY ALL), t AS (SELECT query_id, f FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, first, f) = 1) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(trim(source_name) = f, false) DESC, rerank_order) AS context_order FROM r LEFT JOIN t USING (query_id) QUALIFY context_order <= 5",
    ),
    "usefulness_gate": (usefulness_gate, f"{CHAIN} SELECT query_id, {', '.join(f'{gate_sql(p)} AS {p}' for p in R.PROFILES)} FROM r WHERE rerank_order = 0"),
    "trust_filter_anti": (trust_filter, f"WITH {HITS}, {L.HEALTH_SQL} SELECT query_id, chunk_id, rank FROM h WHERE NOT EXISTS (SELECT 1 FROM health WHERE status IN ('failed', 'processing') AND trim(health.source_name) = trim(h.source_name))"),
    "grounding_decision": (grounding, grounding_sql()),
    "field_hit_priority": (
        field_hits,
        f"{CHAIN}, u AS (SELECT DISTINCT turn_id AS query_id, coalesce({has_sql('lower(message)', r'\b(name|email|e-?mail|phone|contact|website|url|homepage|address)\b')}, false) AS asks FROM chat_turns), x AS (SELECT r.*, asks, coalesce(page_content, '') AS t FROM r JOIN u USING (query_id)) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN asks THEN {FIELD_SCORE} ELSE 0 END DESC, rerank_order) - 1 AS field_order FROM x",
    ),
    "section_hit_priority": (
        section_hits,
        f"{CHAIN}, u AS (SELECT DISTINCT turn_id AS query_id, {SECTION_NUMBER} AS n, contains(lower(message), 'disaster') AND contains(lower(message), 'recover') AS rec FROM chat_turns WHERE message IS NOT NULL), x AS (SELECT r.*, n, rec, lower(coalesce(page_content, '')) AS t, {list(_NUMBERS)}[TRY_CAST(n AS INT)] AS word FROM r JOIN u USING (query_id)) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n IS NULL AND NOT rec THEN 0 ELSE 5 * (coalesce(regexp_matches(t, '\\bsection\\s*(?:' || n || coalesce('|' || word, '') || ')\\b'), false)::INT + (rec AND regexp_matches(t, 'disaster\\s+recovery'))::INT) + regexp_matches(t, '(?m)^#{{1,6}}\\s')::INT END DESC, rerank_order) - 1 AS section_order FROM x",
    ),
    "context_limits": (context_limits, f"WITH {HITS}, n AS (SELECT query_id, count(*) AS n FROM h GROUP BY 1), t AS (SELECT query_id, n, unnest(['qa', 'summarize', 'compare', 'extract']) AS task FROM n) SELECT query_id, task, {limit_sql(5)} AS chunks, {limit_sql(10)} AS broad_chunks, least(n, 18) AS pool FROM t"),
    "index_build": (
        index_build,
        f"WITH {STORED}, v AS (SELECT DISTINCT chunk_id FROM chunk_vectors WHERE embedding IS NOT NULL AND chunk_id IS NOT NULL) SELECT row_number() OVER (ORDER BY source_name, chunk_id) - 1 AS pos, chunk_id, source_name FROM stored JOIN v USING (chunk_id)",
    ),
    "embedding_misses": (embedding_misses, f"WITH {STORED} SELECT DISTINCT sha256(text) AS sha, length(text) AS chars FROM stored WHERE chunk_id NOT IN (SELECT chunk_id FROM chunk_vectors WHERE embedding IS NOT NULL AND chunk_id IS NOT NULL)"),
}
