"""The engine's two entry points: keeping the index fresh, and answering a batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import queries as Q
from ..operators import answers, chunker, embed, extract, index, library, prompts, ranking
from ..session import cut


def sync(segments: DataFrame, chunks: DataFrame, hashes: DataFrame, cache: DataFrame, model: embed.Embedder, size: int = 900, overlap: int = 120) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The index after a change of the library: ``(chunks, vectors, hashes, cache)``.

    ``segments`` is the library now, ``chunks`` and ``hashes`` what the last call returned. Only sources whose content
    changed are cut again, and only texts that the cache lacks are embedded; sources that are gone leave the index.
    """
    now = cut(library.content_hashes(segments))
    change = library.changes(hashes, now)
    same = change.where("change = 'unchanged'").select("source_name")
    rows = segments.where("document_id is not null").withColumn("source_name", F.coalesce("source_name", F.lit("")))
    todo = rows.join(same, "source_name", "left_anti").dropDuplicates(["document_id"])
    cols = ["document_id", "source_name", "file_path", "file_type", "page_number"]
    new = chunker.chunk(todo, size, overlap).join(todo.select(*cols), "document_id")
    kept = chunks.withColumn("source_name", F.coalesce("source_name", F.lit(""))).join(same, "source_name", "left_semi")
    out = kept.select(*new.columns).unionByName(new)
    vectors, grown = embed.with_cache(out, "chunk_id", cache, model)
    return out, vectors, now, grown


def retrieve(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, query_vectors: DataFrame, depth: int = 24, pool: int = 18, scale: float = 1.0) -> DataFrame:
    """Fused and reranked hits with their chunks: word and vector search of all queries in one plan.

    ``queries(query_id, text)``, ``query_vectors(query_id, embedding)``.
    """
    corpus = index.stored(chunks)
    near = index.nearest(query_vectors, vectors, depth, "query_id", "chunk_id").withColumn("distance", F.col("distance") * scale)
    words = index.bm25_top(queries, corpus, depth)
    fused = ranking.fuse(near, words, pool)
    body = corpus.select("chunk_id", "text", "source_name", "file_path", "page_number")
    # a hit whose chunk is gone stays, with an empty text
    return ranking.rerank(fused.join(body, "chunk_id", "left").withColumn("text", F.coalesce("text", F.lit(""))))


def ask(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, model: embed.Embedder, top_k: int = 5, distance_scale: float = 1.0) -> DataFrame:
    """``query_id, route, answer, warning, sources`` for ``queries(query_id, text)``.

    Routes: ``extract`` (a labelled field), ``contact`` (a bundle of them), ``section`` (a quote), ``overview`` (prose or
    themes of the dominant source), ``context`` (grounded, but only a model behind ``prompts`` could answer; the answer
    is null) and ``none`` (nothing in the library passes the gate). Answers cite sources by number and are validated.
    The gates' distances are those of usual embedding models; ``distance_scale`` brings another model's to their scale.
    """
    q = queries.where("query_id is not null and text is not null").dropDuplicates(["query_id"]).select("query_id", Q.normalize_query(F.col("text")).alias("q"))
    asked = cut(
        q.select(
            "query_id", F.col("q").alias("text"), Q.is_broad_overview(F.col("q")).alias("broad"), Q.uses_relaxed_gate(F.col("q")).alias("relaxed"), Q.is_entity_lookup(F.col("q")).alias("lookup"), Q.is_section_navigation(F.col("q")).alias("section"), Q.field_kind(F.col("q")).alias("kind"),
            Q.has(F.col("q"), Q.CONTACT_QUESTION).alias("contact"), Q.section_number(F.col("q")).alias("section_number"), (F.col("q").contains("disaster") & F.col("q").contains("recover")).alias("recovery"), F.col("q").rlike(r"\b(name|email|e-?mail|phone|contact|website|url|homepage|address)\b").alias("asks_field"),
        )
    )
    hits = retrieve(asked.select("query_id", "text"), chunks, vectors, embed.embedded(asked.select("query_id", "text"), "query_id", model), scale=distance_scale)
    flags = asked.withColumnRenamed("text", "query")
    status = library.health(chunks, vectors)
    ordered = ranking.field_priority(ranking.section_priority(hits.join(flags, "query_id")), order="section_order")
    judged = ranking.promote(ranking.trusted(ordered, status), status, F.col("relaxed"), F.col("lookup"), "field_order").where("grounded")
    strong = ranking.drop_weak(judged, "promoted_order")
    first = ranking.dominant_source(strong, "promoted_order").select("query_id", F.col("source_name").alias("focus_source"))
    limit = F.when(F.col("broad"), F.lit(2 * top_k)).otherwise(F.lit(top_k))
    wide = ranking.interleave(strong.where("broad and not section"), limit, "promoted_order")
    narrow = ranking.focus(strong.where("not (broad and not section)").join(first, "query_id", "left"), limit, "promoted_order").drop("focus_source")
    context = cut(wide.unionByName(narrow))
    refs = prompts.source_refs(context)
    texts = context.select("query_id", "context_order", "text", "source_name", "kind", "contact", "section", "section_number")
    fields = extract.first_fields(texts, "query_id", "context_order")
    one = fields.join(asked.select("query_id", "kind"), ["query_id", "kind"]).select("query_id", F.concat(F.lit("The document states "), F.replace("kind", F.lit("_"), F.lit(" ")), F.lit(" "), "value", F.lit(" [SOURCE "), "context_order", F.lit("].")).alias("extracted"))
    bundle = extract.contact_bundle(fields.join(asked.where("contact").select("query_id"), "query_id", "left_semi"), "query_id").select("query_id", F.col("answer").alias("bundled"))
    keyed = texts.where("section_number is not null").select(F.struct("query_id", "context_order").alias("k"), "text")
    quotes = extract.section_quotes(keyed, "k").select("k.query_id", "k.context_order", "section", "quote").join(asked.select("query_id", F.col("section_number").alias("section")), ["query_id", "section"])
    quote = quotes.groupBy("query_id").agg(F.min_by(F.concat("quote", F.lit(" [SOURCE "), F.col("context_order"), F.lit("]")), "context_order").alias("quoted"))
    broad = extract.overview(texts.join(asked.where("broad").select("query_id"), "query_id", "left_semi"), order="context_order").select("query_id", F.concat("answer", F.lit(" [SOURCE 1]")).alias("overview"))
    corpus = context.groupBy("query_id").agg(F.array_join(F.collect_list(F.coalesce("text", F.lit(""))), " ").alias("corpus"), F.count("*").cast("int").alias("n"))
    out = asked.select("query_id").join(corpus, "query_id", "left").join(refs, "query_id", "left")
    for part in (one, bundle, quote, broad):
        out = out.join(part, "query_id", "left")
    answer = F.coalesce("extracted", "bundled", "quoted", "overview")
    sources = F.coalesce("n", F.lit(0))
    held = answers.validate(answer, F.col("corpus"), sources)
    checked = answers.fall_back(held["text"], F.col("quoted"), F.col("overview"), F.col("corpus"), sources)
    checked = F.struct(checked["text"].alias("text"), F.coalesce(checked["warning"], held["warning"]).alias("warning"))
    route = F.when(F.col("n").isNull(), "none").when(F.col("extracted").isNotNull(), "extract").when(F.col("bundled").isNotNull(), "contact").when(F.col("quoted").isNotNull(), "section").when(F.col("overview").isNotNull(), "overview").otherwise("context")
    return out.select("query_id", route.alias("route"), F.when(answer.isNotNull(), checked["text"]).alias("answer"), F.when(answer.isNotNull(), checked["warning"]).alias("warning"), "sources")
