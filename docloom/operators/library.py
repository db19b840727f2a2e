"""The library as tables: listing, fingerprints, change detection, health and catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that some systems reserve for devices.
RESERVED = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))
EXTENSIONS = ("pdf", "docx", "txt")


def health(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """``source_name, expected, indexed, status`` of each source: ``failed`` without chunks that have text, ``ready`` if
    every such chunk has a vector, else ``ready_limited``."""
    rows = chunks.where("chunk_id is not null and source_name is not null").groupBy("source_name", "chunk_id").agg(F.max(F.col("text").isNotNull()).alias("has_text"))
    known = vectors.where("embedding is not null").select("chunk_id").distinct().withColumn("v", F.lit(1))
    out = rows.join(known, "chunk_id", "left").groupBy("source_name").agg(F.count_if("has_text").alias("expected"), F.count_if(F.col("has_text") & F.col("v").isNotNull()).alias("indexed"))
    return out.withColumn("status", F.when(F.col("expected") == 0, "failed").when(F.col("expected") == F.col("indexed"), "ready").otherwise("ready_limited"))


HEALTH_SQL = (
    "hc AS (SELECT source_name, chunk_id, bool_or(text IS NOT NULL) AS has_text FROM chunks WHERE chunk_id IS NOT NULL AND source_name IS NOT NULL GROUP BY ALL), "
    "hv0 AS (SELECT DISTINCT chunk_id, 1 AS v FROM chunk_vectors WHERE embedding IS NOT NULL), "
    "hn AS (SELECT source_name, count(*) FILTER (has_text) AS expected, count(*) FILTER (has_text AND v IS NOT NULL) AS indexed FROM hc LEFT JOIN hv0 USING (chunk_id) GROUP BY 1), "
    "health AS (SELECT *, CASE WHEN expected = 0 THEN 'failed' WHEN expected = indexed THEN 'ready' ELSE 'ready_limited' END AS status FROM hn)"
)


def content_hashes(segments: DataFrame) -> DataFrame:
    """``source_name, sha``: one hash for each source over its segments' ids and texts.

    The segments' hashes are added up (four sums of 12 digits each), which any order and any number of tasks can do; no
    row ever holds a source's list.
    """
    rows = segments.where("document_id is not null and text is not null")
    mark = F.sha2(F.concat_ws(":", "document_id", F.sha2(F.col("text").cast("binary"), 256)).cast("binary"), 256)
    # repeated rows carry the same text; they are dropped by their hashes
    each = rows.select(F.coalesce("source_name", F.lit("")).alias("source_name"), "document_id", mark.alias("h")).dropDuplicates(["document_id"])
    part = lambda i: F.sum(F.conv(F.substring("h", 12 * i + 1, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return each.groupBy("source_name").agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[part(i) for i in range(4)]).cast("binary"), 256).alias("sha"))


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """``source_name, change`` between two tables of hashes: ``added``, ``removed``, ``changed`` or ``unchanged``."""
    b, n = before.select("source_name", F.col("sha").alias("b")), now.select("source_name", F.col("sha").alias("n"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("b") == F.col("n"), "unchanged").otherwise("changed")
    return b.join(n, "source_name", "full_outer").select("source_name", change.alias("change"))


def fingerprint(hashes: DataFrame) -> DataFrame:
    """One row that changes with any source's name or content: sources, and the sum of their hashes' first 15 digits.

    A sum, unlike a hash over a sorted list, is combined in any order, so no task holds the list.
    """
    pair = F.conv(F.substring(F.sha2(F.concat_ws(":", "source_name", "sha").cast("binary"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return hashes.agg(F.count("*").alias("sources"), F.coalesce(F.sum(pair), F.lit(0)).cast("string").alias("fingerprint"))


def needs_sync(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row ``files, needs_sync, reason`` for ``files(source_name, sha)`` now and ``indexed(source_name, sha)`` of the index.

    No files need nothing; files without an index, or another fingerprint than the index's, need a sync.
    """
    now, then = fingerprint(files).select(F.col("sources").alias("files"), F.col("fingerprint").alias("now")), fingerprint(indexed).select(F.col("sources").alias("kept"), F.col("fingerprint").alias("then"))
    reason = F.when(F.col("files") == 0, "no files").when(F.col("kept") == 0, "no index").when(F.col("now") != F.col("then"), "changed").otherwise("fresh")
    return now.join(F.broadcast(then)).select("files", reason.isin("no index", "changed").alias("needs_sync"), reason.alias("reason"))


def settings_match(state: DataFrame, chunk_size: int, overlap: int, model: str) -> DataFrame:
    """One row ``matches``: whether the index's state (``chunk_size, overlap, model``) is that of the settings; false without."""
    same = (F.col("chunk_size") == chunk_size) & (F.col("overlap") == overlap) & (F.col("model") == model)
    return state.agg((F.coalesce(F.bool_and(F.coalesce(same, F.lit(False))), F.lit(False))).alias("matches"))


STATUSES = ("uploaded", "processing", "ready", "ready_limited", "failed")


def statuses_after_index(sources: DataFrame, probe_ok: Column) -> DataFrame:
    """``source_name, status, note`` after a build of ``sources(source_name, ok, reason, expected, indexed)``: ``failed`` with
    its reason, ``ready_limited`` where chunks are missing or the index's probe failed, else ``ready``."""
    ok, partial = F.coalesce("ok", F.lit(False)), (F.col("expected") > 0) & (F.col("expected") != F.col("indexed"))
    status = F.when(~ok, "failed").when(partial, "ready_limited").when(~probe_ok, "ready_limited").otherwise("ready")
    note = F.when(~ok, F.col("reason")).when(partial, F.concat(F.lit("indexed "), F.col("indexed"), F.lit(" of "), F.col("expected"))).when(~probe_ok, F.lit("probe failed"))
    return sources.select("source_name", status.alias("status"), note.alias("note"))


def statuses_after_probe(statuses: DataFrame, counts: DataFrame, probe_ok: Column) -> DataFrame:
    """``source_name, status`` when only the probe was run anew over ``counts(source_name, expected, indexed)``: a failed
    source stays failed, others are judged again."""
    both = statuses.select("source_name", F.col("status").alias("_s")).join(counts, "source_name", "left")
    partial = F.coalesce((F.col("expected") > 0) & (F.col("expected") != F.col("indexed")), F.lit(False))
    return both.select("source_name", F.when(F.col("_s") == "failed", "failed").when(partial | ~probe_ok, "ready_limited").otherwise("ready").alias("status"))


def status_counts(statuses: DataFrame) -> DataFrame:
    """One row with the sources of each of ``STATUSES`` and of any ``other``."""
    return statuses.agg(*[F.count_if(F.col("status") == x).alias(x) for x in STATUSES], F.count_if(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))).alias("other"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """``source_name, chunks, documents`` with text, each chunk once."""
    rows = chunks.where("chunk_id is not null and text is not null and source_name is not null").select("source_name", "chunk_id", "document_id").dropDuplicates(["chunk_id"])
    # documents are counted in two steps, so that a source with a third of all rows is spread first
    return rows.groupBy("source_name", "document_id").agg(F.count("*").alias("c")).groupBy("source_name").agg(F.sum("c").alias("chunks"), F.count("document_id").alias("documents"))


def quality(chars: Column) -> Column:
    """Whether a file's text looks extracted: ``good``, ``low_text`` or ``unknown``, by file type and characters."""
    least = F.when(F.col("file_type") == "pdf", 35).when(F.col("file_type") == "docx", 40).otherwise(15)
    return F.when(chars.isNull(), "unknown").when(chars < least, "low_text").otherwise("good")


def catalog(segments: DataFrame, status: DataFrame) -> DataFrame:
    """``source_name, file_type, segments, mean_chars, extraction_quality, status, updated_at`` of every source."""
    rows = segments.where("source_name is not null and document_id is not null").groupBy("source_name", "document_id").agg(
        F.max("file_type").alias("file_type"), F.max(F.char_length(F.btrim("text"))).alias("chars"), F.max("loaded_at").alias("at")
    )
    files = rows.groupBy("source_name").agg(F.max("file_type").alias("file_type"), F.count("*").alias("segments"), F.avg("chars").alias("mean_chars"), F.max("at").alias("updated_at"))
    return files.join(status.select("source_name", "status"), "source_name", "left").select(
        "source_name", "file_type", "segments", F.round("mean_chars", 6).alias("mean_chars"), quality(F.col("mean_chars")).alias("extraction_quality"), F.coalesce("status", F.lit("uploaded")).alias("status"), "updated_at"
    )


def safe_name(name: Column) -> Column:
    """Whether an upload's name may be stored: no path, control character or device name, and a known extension."""
    stem = F.lower(F.regexp_replace(name, r"\..*$", ""))
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    bad = (F.btrim(name) == "") | name.isin(".", "..") | F.regexp_like(name, F.lit(r"[/\\\x00-\x1f]")) | stem.isin(*RESERVED) | ~extension.isin(*EXTENSIONS)
    return F.coalesce(~bad, F.lit(False))


def upload_outcomes(uploads: DataFrame, existing: DataFrame, most_bytes: int = 50 << 20) -> DataFrame:
    """``name, sha, outcome`` of ``uploads(name, content)`` against ``existing(name, sha)``: ``rejected``, ``duplicate_unchanged`` or ``saved``."""
    new = uploads.select("name", F.sha2("content", 256).alias("sha"), F.octet_length("content").alias("size"))
    old = existing.select("name", F.col("sha").alias("_old"))
    bad = ~safe_name(F.col("name")) | F.col("size").isNull() | (F.col("size") == 0) | (F.col("size") > most_bytes)
    outcome = F.when(bad, "rejected").when(F.col("sha") == F.col("_old"), "duplicate_unchanged").otherwise("saved")
    return new.join(old, "name", "left").select("name", "sha", outcome.alias("outcome"))


def upload_rollup(outcomes: DataFrame) -> DataFrame:
    """Counts of the outcomes and the batch's status."""
    n = outcomes.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("saved", "duplicate_unchanged", "rejected")])
    good = F.col("saved") > 0
    status = F.when(good & (F.col("rejected") == 0), "success").when(good, "partial_success").when((F.col("duplicate_unchanged") > 0), F.when(F.col("rejected") > 0, "partial_success").otherwise("no_op")).otherwise("failed")
    return n.withColumn("status", status)


def delete_source(table: DataFrame, name: str) -> DataFrame:
    """A table without the rows of one source."""
    return table.where(~F.coalesce(F.col("source_name") == name, F.lit(False)))
