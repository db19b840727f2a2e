"""Chat sessions and messages as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.queries import asks_for_file, bypasses_documents, expects_documents, has, normalize_query
from ..session import strip_blanks

# Patterns of follow-up questions in a conversation about a document, searched without case.
FOLLOW_UPS = (
    r"^\s*(tell\s+me\s+more|continue|details|elaborate|more\s+details|expand|what\s+else|more|further)\s*[!.?]*\s*$",
    r"\b(his|her|their|its)\s+(name|full\s*name|title|role|job|position|skills?|experience|background|address|email|e-?mail|phone|mobile|number)\b",
    r"\b(does|did|do|is|are|was|were|can|could|would|will)\s+[\w']{0,22}?\b(he|she|they|him|her)\b|\b(he|she|they)\s+(know|knows|knew|knw|knws|have|has|had|work|works|worked|use|uses|used)\b|\b(doe|does|did)\s+he\b|\b(where|when)\s+(does|do|did|is|was)\s+[\w']{0,16}?\b(he|she|they)\b",
    r"\b(in|from|on)\s+(the|this|my|that)\s+(document|file|upload|pdf|uploaded\s+file|material)\b|\b(in|from)\s+document\b|\b(in|from)\s+the\s+file\b",
    r"^\s*(yes|yeah|yep|yup|ok|okay|sure)\s*[!.?]*\s*$",
    r"^\s*(phone(\s+number)?|contact(\s+number)?|mobile|cell|email|e-?mail(\s+address)?|address|website|url|headquarters|headquartered|hq|founded|established|incorporated)\s*[!.?]*\s*$",
    r"\b(the\s+same|as\s+above|you\s+just\s+said|previous\s+answer)\b",
    r"\bwhat\s+about\s+(his|her|their|the|this|my|your)\b",
)
DEICTIC = FOLLOW_UPS[3]
ADDRESS_QUESTION = r"\b(address|street|zip|postal|location)\b"
LISTS_QUESTION = r"\b(include|included|mention|mentions|list|lists)\b"
GENERAL_TECHNOLOGY = r"^\s*what\s+is\s+(rag\b|retrieval[-\s]?augmented\s+generation|embeddings?\b|vector\s+database|vectordb|llm\b|large\s+language\s+model)\s*\??\s*$"
TERM_QUESTION = r"^\s*what\s+is\s+([A-Za-z][A-Za-z0-9\-]{1,32})\s*\??\s*$"
GENERAL_TERMS = ("rag", "ml", "llm", "nlp", "sql", "api", "aws", "etl", "gpu", "cpu", "cdn", "http", "https", "json", "xml", "csv", "pdf", "gpt")
QUESTION_START = r"^\s*(what|who|when|where|which|how|did|does|do|is|are|was|were|can|could|would)\b"
ANCHORS = (
    r"\b(his|her|their|its|he|she|they|him)\b",
    r"\b(the|this|my|that|your)\s+(loan|application|file|document|upload|library|amount|balance|name|number|address|city|email|phone|record|policy|packet|form|memo|brief|playbook)\b",
    r"\b(my|your)\s+(loan|file|document|application|upload|policy|library)\b",
)
PRIOR_TAIL, MERGED_MOST = 260, 520


def messages(rows: DataFrame) -> DataFrame:
    """Messages once for each id, with session and role in lower case without outer blanks and the readable parts of
    ``extra_json`` (``mode``, ``grounded``; null where it is cut or missing)."""
    extra = F.from_json("extra_json", "mode string, grounded boolean", {"mode": "PERMISSIVE"})
    return rows.where("id is not null").dropDuplicates(["id"]).select(
        "id", F.lower(strip_blanks("session_id")).alias("session_id"), F.lower(strip_blanks("role")).alias("role"), "content", extra["mode"].alias("mode"), extra["grounded"].alias("grounded")
    )


def sessions(rows: DataFrame) -> DataFrame:
    """Sessions once for each id, the row updated last."""
    key = F.lower(strip_blanks("id"))
    best = F.max_by(F.struct("title", "created_at", "updated_at"), F.struct("updated_at", "created_at", "title"))
    return rows.where("id is not null").groupBy(key.alias("session_id")).agg(best.alias("r")).select("session_id", "r.title", "r.created_at", "r.updated_at")


def listing(session_rows: DataFrame, message_rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Sessions with their message counts, newest first; ``limit`` of them, or all."""
    counts = messages(message_rows).groupBy("session_id").agg(F.count("*").alias("messages"))
    out = sessions(session_rows).join(counts, "session_id", "left").withColumn("messages", F.coalesce("messages", F.lit(0)))
    return out if limit is None else out.orderBy(F.desc("updated_at"), "session_id").limit(limit)


def titles(message_rows: DataFrame, most: int = 80) -> DataFrame:
    """``session_id, title``: the start of each session's first user message."""
    users = messages(message_rows).where("role = 'user' and trim(content) <> ''")
    return users.groupBy("session_id").agg(F.substring(F.btrim(F.min_by("content", "id")), 1, most).alias("title"))


def delete_session(session_rows: DataFrame, message_rows: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the sessions of ``gone(session_id)``."""
    s = session_rows.join(gone.select(F.col("session_id").alias("id")), "id", "left_anti")
    m = message_rows.join(gone.select("session_id"), "session_id", "left_anti")
    return s, m


def is_follow_up(q: Column) -> Column:
    """Of a normalised query: goes on about the document of the last answer."""
    n = F.char_length(q)
    some = lambda patterns: reduce(lambda a, p: a | has(q, p), patterns[1:], has(q, patterns[0]))
    term = F.regexp_extract(F.lower(q), "(?i)" + TERM_QUESTION, 1)
    asked = (n <= 72) & has(q, TERM_QUESTION) & ~term.isin(*GENERAL_TERMS)
    anchored = (n <= 100) & has(q, QUESTION_START) & some(ANCHORS)
    goes_on = some(FOLLOW_UPS) | asks_for_file(q) | (has(q, ADDRESS_QUESTION) & (n < 160)) | (has(q, LISTS_QUESTION) & (n < 180)) | asked | anchored
    return (F.coalesce(q, F.lit("")) != "") & ~bypasses_documents(q) & ~has(q, GENERAL_TECHNOLOGY) & goes_on


def is_short_deictic(q: Column) -> Column:
    """Of a normalised query: a short turn that only points at the document."""
    return (F.char_length(q) <= 88) & has(q, DEICTIC)


def expects_documents_in_turn(q: Column, forced: Column) -> Column:
    """Of a normalised query: whether the library should answer it, given that its conversation may force that."""
    return ~bypasses_documents(q) & (expects_documents(q) | forced)


def dominant_name(names: DataFrame) -> DataFrame:
    """``session_id, source_name``: the source that each session's last grounded answer names most, ties to the first.

    ``names(session_id, position, source_name)``. Where more than three sources are named once each there is none.
    """
    named = names.where(F.coalesce(F.btrim("source_name"), F.lit("")) != "")
    counts = named.groupBy("session_id", F.btrim("source_name").alias("source_name")).agg(F.count("*").alias("n"), F.min("position").alias("at"))
    best = counts.groupBy("session_id").agg(F.min_by("source_name", F.struct(-F.col("n"), "at")).alias("source_name"), F.max("n").alias("most"), F.count("*").alias("sources"))
    return best.where("most > 1 or sources <= 3").select("session_id", "source_name")


def created(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions with those of ``new(id, title, created_at)`` added; an id that is there already stays as it is."""
    fresh = new.select("id", "title", "created_at", F.col("created_at").alias("updated_at")).dropDuplicates(["id"]).join(rows.select("id"), "id", "left_anti")
    return rows.unionByName(fresh)


def appended(session_rows: DataFrame, message_rows: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after ``new(id, session_id, role, content, extra_json, at)`` messages: added, and their sessions touched."""
    key = lambda c: F.lower(strip_blanks(c))
    at = new.groupBy(key("session_id").alias("_s")).agg(F.max("at").alias("_at"))
    touched = session_rows.join(at, key("id") == F.col("_s"), "left").withColumn("updated_at", F.greatest("updated_at", "_at")).drop("_s", "_at")
    return touched, message_rows.unionByName(new.drop("at"), allowMissingColumns=True)


def titled(session_rows: DataFrame, message_rows: DataFrame) -> DataFrame:
    """Sessions with their missing titles taken from the first user message."""
    named = titles(message_rows).select(F.col("session_id").alias("_s"), F.col("title").alias("_t"))
    return session_rows.join(named, F.lower(strip_blanks("id")) == F.col("_s"), "left").withColumn("title", F.coalesce(F.nullif(F.btrim("title"), F.lit("")), "_t")).drop("_s", "_t")


def last_grounded(message_rows: DataFrame) -> DataFrame:
    """``session_id, id, question``: each session's last grounded answer and the user message just before it.

    The message before is found by an aggregate over the messages up to that answer, not by ordering a session.
    """
    m = messages(message_rows)
    answers = m.where("role = 'assistant' and (grounded or mode in ('grounded', 'blended'))").groupBy("session_id").agg(F.max("id").alias("last"))
    before = m.join(answers, "session_id").where(F.col("id") < F.col("last")).groupBy("session_id", "last").agg(F.max_by(F.struct("role", "content"), "id").alias("p"))
    return answers.join(before, ["session_id", "last"], "left").select("session_id", F.col("last").alias("id"), F.when(F.col("p.role") == "user", F.nullif(F.btrim("p.content"), F.lit(""))).alias("question"))


def retrieval_hints(queries: DataFrame, message_rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``query_id, retrieval_query, focus_source, forced``: follow-ups carry the last question and its source along.

    ``queries(query_id, session_id, text)``; ``sources(session_id, source_name)`` names each session's last source.
    """
    q = queries.select("query_id", F.lower(strip_blanks("session_id")).alias("session_id"), F.coalesce(normalize_query(F.col("text")), F.lit("")).alias("q"))
    known = last_grounded(message_rows).join(sources, "session_id")
    both = q.join(known, "session_id", "left")
    forced = F.col("source_name").isNotNull() & (F.col("q") != "") & is_follow_up(F.col("q"))
    prior = normalize_query(F.substring(F.col("question"), -PRIOR_TAIL, PRIOR_TAIL))
    merged = F.substring(F.concat_ws(" ", F.nullif(prior, F.lit("")), "q", "source_name"), 1, MERGED_MOST)
    return both.select("query_id", F.when(forced, merged).otherwise(F.col("q")).alias("retrieval_query"), F.when(forced, F.col("source_name")).alias("focus_source"), forced.alias("forced"))


def numbered(rows: DataFrame) -> DataFrame:
    """Messages with their 0-based place in the session."""
    return messages(rows).withColumn("turn", F.row_number().over(Window.partitionBy("session_id").orderBy("id")) - 1)
