import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.operators import answers as A
from docloom.operators import chat as C
from docloom.operators import chunker
from docloom.operators import extract as E
from docloom.operators import library as L
from docloom.operators import web as W
from docloom.sources import files
from docloom.streaming import windows


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n#,;", max_size=400), st.integers(1, 60), st.integers(0, 59))
def test_chunks_hold_all_text(text, size, overlap):
    overlap = min(overlap, size - 1)
    got = chunker.pieces(text, size, overlap)
    assert all(0 < len(p) <= size and p == p.strip() for p in got)
    at = 0
    squeezed = "".join(text.split())
    covered = 0
    for p in got:
        at = text.find(p, max(0, at - size))
        assert at >= 0
        covered += len("".join(p.split()))
    assert covered >= len(squeezed)


def test_chunk_table(spark):
    df = spark.createDataFrame([("d1", "x. " * 700, 1), ("d1", "x. " * 700, 2), ("d2", "  ", 3), ("d3", None, 4), (None, "y", 5)], "document_id string, text string, chunk_index int")
    out = chunker.chunk(df.select("document_id", "text", "chunk_index")).collect()
    assert {r.document_id for r in out} == {"d1"} and len({r.chunk_id for r in out}) == len(out) == out[0].total_chunks


def test_fields_and_bundle(spark):
    text = "Full name: Ada Stone\nE-mail:\nada@mill.example\nPhone: (555) 010-1234 55\nAddress: 12 Mill Street\nKirrow 12345\nRate: 3\nApplication number: FRM-1234"
    df = spark.createDataFrame([("f.txt", "d1", text), ("f.txt", "d2", "Full name: Bob Reed"), ("g.txt", "d3", None), ("h.txt", "d4", "")], "source_name string, document_id string, text string")
    got = {r.kind: r.value for r in E.first_fields(df).collect()}
    assert got == {"person_name": "Ada Stone", "email": "ada@mill.example", "phone": "(555) 010-1234 55", "address": "12 Mill Street Kirrow 12345", "application_number": "FRM-1234"}
    bundle = E.contact_bundle(E.first_fields(df)).first()
    assert bundle.fields == 3 and bundle.answer.startswith("Here is the contact information from the document:\n**Email**: ada@mill.example")


def test_overview_needs_one_source(spark):
    rows = [(1, i, "a.pdf", "The harbour was rebuilt by the survey crew in March. The harbour was rebuilt by the night shift in April.") for i in range(3)] + [(2, i, f"{i}.pdf", "x") for i in range(2)]
    out = E.overview(spark.createDataFrame(rows, "query_id long, rank int, source_name string, text string")).collect()
    assert [r.query_id for r in out] == [1] and out[0].answer.startswith("The harbour")


def test_answers(spark):
    df = spark.createDataFrame([("See [SOURCE 3].", "alpha", 2), ("See [source 1].", "alpha", 2), ("", "alpha", 2), (None, None, None)], "t string, c string, n int")
    got = [r.v for r in df.select(A.validate(F.col("t"), F.col("c"), F.coalesce("n", F.lit(0))).alias("v")).collect()]
    assert got[0].text == A.UNKNOWN and got[0].warning == A.WITHHELD
    assert got[1].text == "See [source 1]." and got[2].text == A.UNKNOWN and got[3].text == A.UNKNOWN


def test_web(spark):
    df = spark.createDataFrame([("https://www.Site.example/A/?q=1",), ("//b.example/x),",), ("ftp://c",), (None,)], "u string")
    assert [r.i for r in df.select(W.identity(F.col("u")).alias("i")).collect()] == ["site.example/a", "b.example/x", "", ""]
    c = spark.createDataFrame([(1, "gasket", 2, "Gasket guide", "https://a.example/x/", "gasket " * 20), (1, "gasket", 1, "", "https://www.a.example/x", "..."), (1, "gasket", 3, "Other", "nope", "gasket " * 20)], "query_id long, query string, arrival long, title string, url string, snippet string")
    assert W.rank_snippets(c, 5).count() == 0  # the bad first copy hides the good second, the last has no address
    a = spark.createDataFrame([("see [x](https://a.example/p) and [y](https://b.example)", ["a.example/p"])], "t string, ok array<string>")
    assert a.select(W.unlink(F.col("t"), F.col("ok")).alias("t")).first().t == "see [x](https://a.example/p) and y"


def test_library(spark):
    seg = "source_name string, document_id string, file_type string, text string, loaded_at timestamp"
    df = spark.sql("SELECT * FROM VALUES ('a', 'd1', 'txt', 'one', timestamp'2024-01-01'), ('a', 'd1', 'txt', 'one', timestamp'2024-01-02'), ('b', 'd2', 'txt', NULL, NULL) AS t(source_name, document_id, file_type, text, loaded_at)")
    h = L.content_hashes(df)
    assert [(r.source_name) for r in h.collect()] == ["a"]
    later = spark.createDataFrame([("a", "x"), ("c", "y")], "source_name string, sha string")
    assert {(r.source_name, r.change) for r in L.changes(h, later).collect()} == {("a", "changed"), ("c", "added")}
    assert L.fingerprint(h.limit(0)).first().fingerprint == "0" and seg
    names = spark.createDataFrame([("ok.PDF",), ("con.txt",), ("a/b.txt",), ("x.exe",), ("..",), (None,)], "n string")
    assert [r.s for r in names.select(L.safe_name(F.col("n")).alias("s")).collect()] == [True, False, False, False, False, False]
    ups = L.upload_outcomes(spark.createDataFrame([("a.txt", bytearray(b"x")), ("b.txt", bytearray(b"")), ("c.txt", bytearray(b"y"))], "name string, content binary"), spark.sql("SELECT 'a.txt' AS name, sha2('x', 256) AS sha"))
    assert {r.name: r.outcome for r in ups.collect()} == {"a.txt": "duplicate_unchanged", "b.txt": "rejected", "c.txt": "saved"}
    assert L.upload_rollup(ups).first().status == "partial_success"


def test_chat_hints(spark):
    m = spark.createDataFrame(
        [(1, " S1 ", "user", "who is in the loan file", None), (2, "s1", "Assistant", "Ada", '{"grounded": true, "mode": "grounded"}'), (3, "s1", "user", "thanks", '{"cut'), (4, "s2", "assistant", "x", None)],
        "id long, session_id string, role string, content string, extra_json string",
    )
    last = C.last_grounded(m).collect()
    assert [(r.session_id, r.id, r.question) for r in last] == [("s1", 2, "who is in the loan file")]
    q = spark.createDataFrame([(1, "S1", "and his email?"), (1 + 1, "s1", "what is his email"), (3, "s9", "what is his email")], "query_id long, session_id string, text string")
    src = spark.createDataFrame([("s1", "loan.pdf")], "session_id string, source_name string")
    got = {r.query_id: r for r in C.retrieval_hints(q, m, src).collect()}
    assert got[2].forced and got[2].focus_source == "loan.pdf" and got[2].retrieval_query == "who is in the loan file what is his email loan.pdf"
    assert not got[3].forced


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\n\r\n\r\ntwo \xff")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "skip.csv").write_text("x")
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Part</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    got = {r.source_name: r for r in files.load_library(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "one\n\ntwo �" and got["b.docx"].text == "## Part\n\na | b" and got["bad.docx"].error and set(got) == {"a.txt", "b.docx", "bad.docx"}


def test_stream_of_files(spark, tmp_path):
    from docloom.streaming.arrival import refresh

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one two three")
    for _ in range(2):
        q = refresh(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination(60)
        (tmp_path / "in" / "b.txt").write_text("four five six")
    assert {r.document_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a_txt", "b_txt"}


def test_windows(spark):
    ev = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 1L AS user_id, 'a' AS event_type, 2.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:50:00', 1L, 'a', 3.0D UNION ALL SELECT timestamp'2024-01-01 02:00:00', 1L, 'a', 3.0D")
    assert sorted(r.events for r in windows.hourly(ev).collect()) == [1, 2]
    assert sorted(r.events for r in windows.sessions(ev, "45 minutes").collect()) == [1, 2]


def test_chunk_arguments():
    with pytest.raises(ValueError):
        chunker.pieces("x", 5, 5)
