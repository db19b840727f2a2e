"""Ranking of hits: fusion, pool merging, reranking, filters, interleaving, context selection and gates.

Hits are rows ``query_id, chunk_id, source_name, rank, distance, rrf_score, ...``; every operator works within
``query_id``, so a batch of any number of queries is one plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.queries import NUMBER_WORDS

# Rank constant of the fusion, and the distance of hits that only the word index found.
RRF_K, NO_VECTOR = 60, 2.5
# Fixed values of the gates: (largest distance, least fusion score, distance that is good by itself, high fusion score, largest distance then).
USEFUL_DISTANCE = 1.22
PROFILES = {
    "strict": (1.16, 0.0085, 0.88, None, None), "task": (1.1, 0.012, 0.9, None, None), "broad": (1.4, 0.006, 0.96, 0.02, 1.55), "lookup": (1.32, 0.008, 0.88, 0.026, 1.45),
}
# Weak chunks, and the stricter limits for sources of limited trust.
WEAK_DISTANCE, WEAK_RRF, WEAK_ALWAYS = 1.45, 0.0095, 1.62
LIMITED = {"strict": (0.92, 0.009), "task": (0.92, 0.013), "broad": (1.08, 0.006), "lookup": (1.1, 0.006)}
COHERENT_HITS, COHERENT_DISTANCE = 2, 1.02
FALLBACK_HITS, FALLBACK_DISTANCE, FALLBACK_RRF = 3, 1.15, 0.005
SOURCE_WINDOW, PROMOTIONS = 8, 11


def fuse(vector_hits: DataFrame, word_hits: DataFrame, k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: ``query_id, chunk_id, vector_rank, bm25_rank, distance, rrf_score, rank``.

    Inputs: ``query_id, chunk_id, rank`` and, for vectors, ``distance``. The score is rounded to six places before it
    orders; ties go to the smaller chunk id. A hit without vector gets the distance ``NO_VECTOR``.
    """
    v = vector_hits.select("query_id", "chunk_id", F.col("rank").alias("vector_rank"), F.col("distance").alias("_d"))
    w = word_hits.select("query_id", "chunk_id", F.col("rank").alias("bm25_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(RRF_K) + F.col(c)), F.lit(0.0))
    both = v.join(w, ["query_id", "chunk_id"], "full_outer").select(
        "query_id", "chunk_id", "vector_rank", "bm25_rank", F.coalesce("_d", F.lit(NO_VECTOR)).alias("distance"), F.round(part("vector_rank") + part("bm25_rank"), 6).alias("rrf_score")
    )
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "chunk_id")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def score_order(rank: str = "rank") -> list[Column]:
    """Fusion score down, distance up, then rank and id."""
    return [F.coalesce("rrf_score", F.lit(0.0)).desc(), F.coalesce("distance", F.lit(NO_VECTOR)), F.col(rank), F.col("chunk_id")]


def merge_pools(hits: DataFrame) -> DataFrame:
    """The best row of each chunk over several pools, numbered anew from 0 as ``merged_rank``."""
    best = hits.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(*score_order()))).where("_n = 1").drop("_n")
    return best.withColumn("merged_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*score_order())) - 1)


def composite() -> Column:
    """Three times the fusion score plus the inverse of one plus the distance."""
    return 3.0 * F.coalesce("rrf_score", F.lit(0.0)) + 1.0 / (1.0 + F.greatest(F.coalesce("distance", F.lit(NO_VECTOR)), F.lit(1e-6)))


def rerank(hits: DataFrame) -> DataFrame:
    """Adds ``rerank_score`` (six places) and ``rerank_order`` from 0: composite score down, prior rank, distance, id."""
    by = [F.round(composite(), 12).desc(), F.col("rank"), F.coalesce("distance", F.lit(NO_VECTOR)), F.col("chunk_id")]
    return hits.withColumn("rerank_score", F.round(composite(), 6)).withColumn("rerank_order", F.row_number().over(Window.partitionBy("query_id").orderBy(*by)) - 1)


def field_priority(hits: DataFrame, text: str = "text", order: str = "rerank_order") -> DataFrame:
    """Adds ``field_order``: hits that hold label lines, addresses or numbers first, where the query asks for a field
    (``asks_field``)."""
    t = F.coalesce(F.col(text), F.lit(""))
    has = lambda p: F.regexp_like(t, F.lit(p)).cast("int")
    score = (
        10 * has(r"(?i)(full\s*name|e-?mail|email|phone|contact\s*number|website|homepage|\burl\b|address)\s*[:#\-]")
        + 2 * has(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
        + has(r"\b(?:\+?\d[\d\s().-]{8,})\b")
    )
    by = [F.when(F.col("asks_field"), score).otherwise(0).desc(), F.col(order)]
    return hits.withColumn("field_order", F.row_number().over(Window.partitionBy("query_id").orderBy(*by)) - 1)


def section_priority(hits: DataFrame, text: str = "text", order: str = "rerank_order") -> DataFrame:
    """Adds ``section_order``: hits that name the query's section first (``section_number``, in digits; up to ten also as a
    word), or, where ``recovery`` is set, disaster recovery; of queries for either, hits with headings before others."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    number = F.col("section_number").cast("string")
    word = F.try_element_at(F.array(*map(F.lit, NUMBER_WORDS)), number.try_cast("int"))
    named = F.regexp_like(t, F.concat(F.lit(r"\bsection\s*(?:"), number, F.coalesce(F.concat(F.lit("|"), word), F.lit("")), F.lit(r")\b")))
    recovery = F.coalesce(F.col("recovery"), F.lit(False)) if "recovery" in hits.columns else F.lit(False)
    found = F.coalesce(named, F.lit(False)).cast("int") + (recovery & F.regexp_like(t, F.lit(r"disaster\s+recovery"))).cast("int")
    score = F.when(F.col("section_number").isNull() & ~recovery, 0).otherwise(5 * found + F.regexp_like(t, F.lit(r"(?m)^#{1,6}\s")).cast("int"))
    return hits.withColumn("section_order", F.row_number().over(Window.partitionBy("query_id").orderBy(score.desc(), F.col(order))) - 1)


def is_weak() -> Column:
    """Far hits, and fairly far ones without support by fusion."""
    d, rrf = F.coalesce("distance", F.lit(NO_VECTOR)), F.coalesce("rrf_score", F.lit(0.0))
    return ((d >= WEAK_DISTANCE) & (rrf < WEAK_RRF)) | (d >= WEAK_ALWAYS)


def drop_weak(hits: DataFrame, order: str = "rerank_order") -> DataFrame:
    """Hits that are not weak; of a query with weak hits only, the first."""
    w = Window.partitionBy("query_id")
    return (
        hits.withColumn("_strong", F.count_if(~is_weak()).over(w)).withColumn("_first", F.min(order).over(w))
        .where(~is_weak() | ((F.col("_strong") == 0) & (F.col(order) == F.col("_first")))).drop("_strong", "_first")
    )


def interleave(hits: DataFrame, limit: int | Column, order: str = "rerank_order") -> DataFrame:
    """Sources in turn, by their first hit, each in its own order; ``context_order`` from 1, at most ``limit``."""
    source = F.coalesce(F.nullif(F.btrim("source_name"), F.lit("")), F.lit("_unknown"))
    turn = F.row_number().over(Window.partitionBy("query_id", source).orderBy(order))
    first = F.min(order).over(Window.partitionBy("query_id", source))
    ordered = hits.withColumn("_turn", turn).withColumn("_first", first)
    return ordered.withColumn("context_order", F.row_number().over(Window.partitionBy("query_id").orderBy("_turn", "_first"))).where(F.col("context_order") <= limit).drop("_turn", "_first")


def focus(hits: DataFrame, limit: int | Column, order: str = "rerank_order") -> DataFrame:
    """The source named by ``focus_source`` first, else in order; ``context_order`` from 1, at most ``limit``."""
    by = [(F.coalesce(F.btrim("source_name") == F.btrim("focus_source"), F.lit(False))).desc(), F.col(order)]
    return hits.withColumn("context_order", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).where(F.col("context_order") <= limit)


def context_limit(mode: Column, top_k: Column, n: Column, broad: Column) -> Column:
    """How many chunks a task reads."""
    k = F.greatest(F.lit(1), top_k)
    size = (
        F.when(mode == "qa", F.least(F.greatest(k, F.lit(3)), F.when(broad, 10).otherwise(5)))
        .when(mode == "summarize", F.least(n, F.greatest(F.lit(8), 2 * k))).when(mode == "compare", F.least(n, F.greatest(F.lit(10), 2 * k))).otherwise(F.least(n, F.greatest(F.lit(5), k)))
    )
    return F.greatest(F.lit(1), F.least(size, n))


def pool_size(n: Column, top_k: Column) -> Column:
    """Candidates before reranking."""
    return F.least(n, F.greatest(F.lit(14), 3 * top_k, F.lit(18)))


def trusted(hits: DataFrame, status: DataFrame) -> DataFrame:
    """Hits but those of sources that are ``failed`` or still ``processing``; hits without source stay."""
    bad = status.where(F.col("status").isin("failed", "processing")).select(F.btrim("source_name").alias("_bad")).distinct()
    return hits.join(bad, F.btrim("source_name") == F.col("_bad"), "left_anti")


def is_useful(profile: str) -> Column:
    """The gate of a top hit under one of ``PROFILES``: near and supported, or very near, or far with high support."""
    most, least, good, high, far = PROFILES[profile]
    d, rrf = F.coalesce("distance", F.lit(NO_VECTOR)), F.coalesce("rrf_score", F.lit(0.0))
    fused = (d <= most) & (rrf >= least)
    if high is not None:
        fused = fused | ((rrf >= high) & (d <= far))
    return F.when(rrf > 0, fused | (d <= good)).otherwise(d <= USEFUL_DISTANCE)


def is_strong_for_limited(profile: str) -> Column:
    """The stricter gate of a top hit from a source of limited trust; uses ``same_source`` hits in the window."""
    most, least = LIMITED[profile]
    d, rrf = F.coalesce("distance", F.lit(NO_VECTOR)), F.coalesce("rrf_score", F.lit(0.0))
    near = (d <= most) & (rrf >= least)
    if profile == "task":
        return near
    if profile == "strict":
        near = near | ((F.col("same_source") >= COHERENT_HITS) & (d <= COHERENT_DISTANCE) & (rrf >= least))
    if profile == "broad":
        near = near | ((rrf >= PROFILES["broad"][3]) & (d <= PROFILES["broad"][4]) & (rrf >= least))
    return F.when(rrf > 0, near).otherwise(d <= USEFUL_DISTANCE)


def same_source_fallback() -> Column:
    """Enough hits of the top's source in the window, and the top not far."""
    d, rrf = F.coalesce("distance", F.lit(NO_VECTOR)), F.coalesce("rrf_score", F.lit(0.0))
    return (F.col("same_source") >= FALLBACK_HITS) & F.when(rrf <= 0, d <= USEFUL_DISTANCE).otherwise((d <= FALLBACK_DISTANCE) & (rrf >= FALLBACK_RRF))


def with_status(hits: DataFrame, status: DataFrame) -> DataFrame:
    """Adds the ``status`` of each hit's source (``uploaded`` if unknown) and ``no_ready``, whether no source is ready."""
    known = status.select(F.btrim("source_name").alias("_s"), "status").dropDuplicates(["_s"])
    ready = status.agg((F.count_if(F.col("status") == "ready") == 0).alias("no_ready"))
    return hits.join(known, F.btrim("source_name") == F.col("_s"), "left").drop("_s").withColumn("status", F.coalesce("status", F.lit("uploaded"))).join(F.broadcast(ready))


def grounds(relaxed: Column, lookup: Column) -> Column:
    """Whether a top hit with ``same_source, status, no_ready`` may ground an answer."""
    useful = is_useful("strict") | (relaxed & is_useful("broad")) | (lookup & is_useful("lookup"))
    limited = is_strong_for_limited("strict") | (relaxed & is_strong_for_limited("broad")) | (lookup & is_strong_for_limited("lookup")) | ((relaxed | lookup) & same_source_fallback())
    named = F.coalesce(F.btrim("source_name"), F.lit("")) != ""
    by_status = (
        F.when(~named, F.when(F.col("no_ready"), limited).otherwise(True)).when(F.col("status") == "ready", True).when(F.col("status").isin("failed", "processing"), False)
        .when(F.col("status") == "ready_limited", limited).when(F.col("no_ready"), limited).otherwise(True)
    )
    return useful & by_status


def promote(hits: DataFrame, status: DataFrame, relaxed: Column, lookup: Column, order: str = "rerank_order") -> DataFrame:
    """Moves the first hit that passes the gate as top to the front, if the top itself fails.

    Adds ``grounded`` (whether any passes) and ``promoted_order`` from 0. Looked at are the top and the next
    ``PROMOTIONS`` hits; each is judged with its own source's hits among itself and the first ones around it.
    """
    q, s = Window.partitionBy("query_id"), Window.partitionBy("query_id", "source_name")
    at = hits.withColumn("_at", F.row_number().over(q.orderBy(order)) - 1)
    head = F.count_if(F.col("_at") < SOURCE_WINDOW).over(s)  # of its source among the first
    short = F.count_if(F.col("_at") < SOURCE_WINDOW - 1).over(s)  # the same when a later hit takes the first place
    seen = at.withColumn("same_source", F.when(F.coalesce(F.btrim("source_name"), F.lit("")) == "", 0).when(F.col("_at") < SOURCE_WINDOW, head).otherwise(short + 1))
    judged = with_status(seen, status).withColumn("_ok", (F.col("_at") <= PROMOTIONS) & F.coalesce(grounds(relaxed, lookup), F.lit(False)))
    chosen = judged.withColumn("_top", F.min(F.when(F.col("_ok"), F.col("_at"))).over(q))
    by = [(F.col("_at") == F.coalesce("_top", F.lit(0))).desc(), F.col("_at")]
    return chosen.withColumn("grounded", F.col("_top").isNotNull()).withColumn("promoted_order", F.row_number().over(q.orderBy(*by)) - 1).drop("_at", "_ok", "_top", "no_ready")


def dominant_source(hits: DataFrame, order: str = "rank") -> DataFrame:
    """``query_id, source_name, hits, share, sources, first``: the most frequent source of each query's hits, ties to the one seen first."""
    named = hits.where(F.coalesce(F.btrim("source_name"), F.lit("")) != "")
    counts = named.groupBy("query_id", F.btrim("source_name").alias("source_name")).agg(F.count("*").alias("hits"), F.min(order).alias("first"))
    w = Window.partitionBy("query_id")
    total = counts.withColumn("share", F.col("hits") / F.sum("hits").over(w)).withColumn("sources", F.count("*").over(w))
    return total.withColumn("_n", F.row_number().over(w.orderBy(F.desc("hits"), "first", "source_name"))).where("_n = 1").drop("_n")


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
