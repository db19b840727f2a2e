"""Tasks, states, fallbacks, sessions and sinks on small tables."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import queries as Q
from docloom.operators import answers as A
from docloom.operators import chat as C
from docloom.operators import extract as E
from docloom.operators import index as I
from docloom.operators import library as L
from docloom.operators import prompts as P
from docloom.operators import tasks as K
from docloom.sources import files

HIT = "query_id long, chunk_id string, text string, source_name string, distance double, rrf_score double, rerank_order int"


def hits(spark, rows):
    return spark.createDataFrame(rows, HIT)


def test_task_of_one_file(spark):
    first = hits(spark, [(1, "a", "x", "F.pdf", 1.4, 0.02, 0), (1, "b", "y", "g.pdf", 1.0, 0.02, 1), (2, "c", None, None, None, None, 0)])
    second = hits(spark, [(1, "a", "x", "f.pdf", 0.5, 0.02, 0), (1, "", "no id, one text", "f.pdf", 0.6, 0.02, 1), (1, None, "no id, one text", "f.pdf", 0.6, 0.02, 2)])
    tasks = spark.createDataFrame([(1, "summarize", " f.PDF ", 5), (2, "compare", None, 5), (3, "summarize", "gone.pdf", 5), (4, "summarize", "all", 5)], "query_id long, task string, scope string, top_k int")
    context, notes = K.contexts(first, second, tasks, 100)
    assert [(r.query_id, r.chunk_id) for r in context.orderBy("query_id", "context_order").collect()] == [(1, "a"), (1, ""), (2, "c")]
    assert {r.query_id: r.note for r in notes.collect()} == {1: K.FILE_NOTE, 2: None, 3: K.NONE_NOTE, 4: None}
    empty, none = K.contexts(first.limit(0), second.limit(0), tasks.limit(0), 0)
    assert empty.count() == 0 and none.count() == 0
    assert [r.q for r in spark.createDataFrame([("extract", " "), ("compare", "the dates")], "t string, x string").select(K.task_query(F.col("t"), F.col("x")).alias("q")).collect()] == [K.DEFAULTS["extract"], "the dates"]


def test_section_words(spark):
    df = spark.createDataFrame([("what is in section seven",), ("section # 12 please",), ("seven dwarfs",), (None,)], "q string")
    assert [r.n for r in df.select(Q.section_number(F.col("q")).alias("n")).collect()] == ["7", "12", None, None]


@pytest.mark.parametrize(
    ("text", "want"), [("what is kestrel?", True), ("what is sql?", False), ("what is rag", False), ("", False), ("tell me more", True), ("is he still there", True), ("which records are listed", False), ("does the memo mention dates", True), ("who are you", False), ("what is the zip", True), ("which color", False)]
)
def test_follow_up(spark, text, want):
    assert spark.createDataFrame([(text,)], "q string").select(C.is_follow_up(F.col("q")).alias("f")).first().f is want


def test_dominant_name(spark):
    rows = [("a", i, n) for i, n in enumerate(["x", "y", "y"])] + [("b", i, str(i)) for i in range(4)] + [("c", 1, "z"), ("c", 0, "w"), ("d", 0, None), ("d", 1, " ")]
    assert {r.session_id: r.source_name for r in C.dominant_name(spark.createDataFrame(rows, "session_id string, position int, source_name string")).collect()} == {"a": "y", "c": "w"}


def test_sessions(spark):
    sessions = spark.sql("SELECT 's1' AS id, cast(null AS string) AS title, timestamp'2024-01-01' AS created_at, timestamp'2024-01-01' AS updated_at")
    grown = C.created(sessions, spark.sql("SELECT * FROM VALUES ('s1', 'no', timestamp'2025-01-01'), ('s2', 'two', timestamp'2025-01-01') t(id, title, created_at)"))
    assert {(r.id, r.title) for r in grown.collect()} == {("s1", None), ("s2", "two")}
    messages = spark.createDataFrame([(1, "S1 ", "user", "  first words ", None)], "id long, session_id string, role string, content string, extra_json string")
    touched, more = C.appended(grown, messages, spark.sql("SELECT 2L AS id, 's1' AS session_id, 'assistant' AS role, 'r' AS content, cast(null AS string) AS extra_json, timestamp'2026-01-01' AS at"))
    assert {r.id: r.updated_at.year for r in touched.collect()} == {"s1": 2026, "s2": 2025} and more.count() == 2
    assert {r.id: r.title for r in C.titled(grown, more).collect()} == {"s1": "first words", "s2": "two"}


def test_states(spark):
    s = spark.createDataFrame([("a", True, None, 3, 3), ("b", True, None, 3, 2), ("c", False, "bad file", 0, 0), ("d", None, None, 0, 0)], "source_name string, ok boolean, reason string, expected long, indexed long")
    of = L.statuses_after_index(s, F.lit(True))
    assert {r.source_name: (r.status, r.note) for r in of.collect()} == {"a": ("ready", None), "b": ("ready_limited", "indexed 2 of 3"), "c": ("failed", "bad file"), "d": ("failed", None)}
    assert {r.source_name: r.status for r in L.statuses_after_probe(of, s, F.lit(False)).collect()} == {"a": "ready_limited", "b": "ready_limited", "c": "failed", "d": "failed"}
    assert L.status_counts(of.limit(0)).first().ready == 0
    now = spark.createDataFrame([("a", "1")], "source_name string, sha string")
    reasons = [L.needs_sync(x, y).first().reason for x, y in ((now, now), (now, now.limit(0)), (now.limit(0), now), (now, now.withColumn("sha", F.lit("2"))))]
    assert reasons == ["fresh", "no index", "no files", "changed"]
    state = spark.createDataFrame([(900, 120, "m")], "chunk_size int, overlap int, model string")
    assert [L.settings_match(x, n, 120, "m").first().matches for x, n in ((state, 900), (state, 800), (state.limit(0), 900))] == [True, False, False]


def test_content_hashes_need_no_order(spark):
    rows = [("d1", "f", "one", 1), ("d2", "f", "two", 2), ("d2", "f", "two", 3), ("d3", None, "x", 4), (None, "f", "y", 5), ("d4", "f", None, 6)]
    of = lambda rows: {r.source_name: r.sha for r in L.content_hashes(spark.createDataFrame(rows, "document_id string, source_name string, text string, page_number int")).collect()}
    assert of(rows) == of(rows[::-1]) and set(of(rows)) == {"f", ""}
    assert of(rows)["f"] != of([("d1", "f", "two", 1), ("d2", "f", "one", 2)])["f"]


def test_probe(spark):
    v = spark.createDataFrame([(f"c{i}", [float(i), 0.0]) for i in range(4)], "chunk_id string, embedding array<double>")
    p = spark.createDataFrame([("p", [3.0, 1.0])], "probe string, embedding array<double>")
    got = [tuple(I.probe(p, v.limit(n)).first()) for n in (4, 2, 0)]
    assert got == [(True, 1.0, "ok"), (True, None, "tiny_index_skipped"), (False, None, "empty_index")]
    assert I.probe(p, v, limit=0.5).first().message == "weak_best_hit"


def test_fall_back(spark):
    df = spark.createDataFrame([(A.UNKNOWN, "Section 7 is short. [SOURCE 1]", None), (A.UNKNOWN, "False. [SOURCE 9]", "It is about mills. [SOURCE 1]"), ("Known.", "q", "o"), (A.UNKNOWN, None, None), (None, "q", "o")], "a string, q string, o string")
    got = [tuple(r.v) for r in df.select(A.fall_back(F.col("a"), F.col("q"), F.col("o"), F.lit("mills section short"), F.lit(1)).alias("v")).collect()]
    assert got == [("Section 7 is short. [SOURCE 1]", None), ("It is about mills. [SOURCE 1]", A.WITHHELD), ("Known.", None), (A.UNKNOWN, None), (None, None)]


def test_raw_fields(spark):
    rows = [("b.txt", "d1", "Write to ops@mill.example now"), ("a.txt", "d2", "Phone: (555) 010-1234 55"), ("c.txt", "d3", "E-mail: c@mill.example"), (None, "d4", "E-mail: n@mill.example"), ("e.txt", "d5", None)]
    seg = spark.createDataFrame(rows, "source_name string, document_id string, text string")
    asked = spark.createDataFrame([(1, "email", "C.TXT"), (2, "email", None), (3, "phone", "b.txt"), (4, "website", None)], "query_id long, kind string, preferred string")
    got = {r.query_id: (r.source_name, r.value) for r in E.raw_fields(seg, asked).collect()}
    assert got == {1: ("c.txt", "c@mill.example"), 2: ("b.txt", "ops@mill.example"), 3: ("a.txt", "(555) 010-1234 55")}
    assert E.raw_fields(seg.limit(0), asked).count() == 0


def test_entity_overview(spark):
    known = spark.createDataFrame([("mill works", "company", "Mill Works"), ("ada", "person", "Ada Stone"), ("auditor", "role", "Auditor")], "part string, kind string, name string")
    texts = spark.createDataFrame([(1, "Mill Works and its auditor ADA"), (2, "an auditor"), (3, None)], "query_id long, text string")
    assert [(r.query_id, r.answer) for r in E.entity_overview(texts, known).collect()] == [(1, "This document provides an overview of Mill Works and Ada Stone, including the role of Auditor.")]


def test_prompts(spark):
    row = spark.range(1).select(
        P.messages(F.lit("c"), F.lit("q"), F.lit(2), F.lit(True), F.lit(True)).alias("g"), P.task_messages(F.lit("sing"), F.lit("c"), F.lit("q")).alias("n"), P.task_messages(F.lit("extract"), F.lit("c"), F.lit("q")).alias("t"), P.general_messages(F.lit("q")).alias("x")
    ).first()
    assert P.SECTION_NOTE in row.g[0].content and P.SEVERAL_NOTE in row.g[0].content and P.SUMMARY_NOTE not in row.g[0].content
    assert row.n is None and row.t[0].content == P.TASKS["extract"] and row.x[1].content == "q"


def test_state_and_uploads(spark, tmp_path):
    path = str(tmp_path / "state.json")
    assert files.load_state(path, spark) is None
    for v in (1, 2):
        files.save_state({"chunk_size": v, "é": "ü"}, path, spark)
    assert files.load_state(path, spark) == {"chunk_size": 2, "é": "ü"}
    (tmp_path / "state.json").write_text("{cut")
    assert files.load_state(path, spark) is None
    uploads = spark.createDataFrame([("a.txt", b"one"), ("../b.txt", b"two"), ("c.txt", b""), ("d.txt", None), ("e.txt", b"old")], "name string, content binary")
    existing = uploads.where("name = 'e.txt'").select("name", F.sha2("content", 256).alias("sha"))
    folder = str(tmp_path / "library")
    got = {r.name: r.outcome for r in files.store_uploads(uploads, existing, folder).collect()}
    assert got == {"a.txt": "saved", "../b.txt": "rejected", "c.txt": "rejected", "d.txt": "rejected", "e.txt": "duplicate_unchanged"}
    assert {p.name: p.read_bytes() for p in (tmp_path / "library").iterdir() if not p.name.startswith(".")} == {"a.txt": b"one"}


def test_report(spark):
    totals = spark.sql("SELECT 2L AS cases, 1L AS passed, 0.5D AS pass_rate, 1.0D AS routing_ok_rate, 1.0D AS anchor_rate, 0L AS false_refusals, 0L AS forbidden_hits")
    by = spark.sql("SELECT 'b' AS category, 2L AS total, 1L AS passed, 1L AS failed, 0.5D AS pass_rate")
    assert [r.line for r in A.text_report(totals, by).orderBy("line_no").collect()][1] == "b: 1 of 2 (0.5000)"


def test_index_order(spark):
    chunks = spark.createDataFrame([(f"c{i:02d}", "t", "b.pdf" if i % 3 else "a.pdf") for i in range(20)], "chunk_id string, text string, source_name string")
    v = chunks.select("chunk_id", F.array(F.lit(1.0)).alias("embedding"))
    rows = I.build(chunks, v).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(20)) and [(r.source_name, r.chunk_id) for r in rows] == sorted((r.source_name, r.chunk_id) for r in rows)
