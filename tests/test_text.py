from pyspark.sql import functions as F

from docloom.functions import queries as Q
from docloom.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_normalize_text(spark):
    assert one(spark, "  a  b \r\n\r\n\r\n c\t\td\rx  ", T.normalize_text) == "a b\n\nc d\nx"
    assert one(spark, None, T.normalize_text) is None
    assert one(spark, " \n \n", T.normalize_text) == ""


def test_repair_hyphens(spark):
    assert one(spark, "ware-\nhouse and sign-off", T.repair_hyphens) == "warehouse and sign-off"


def test_tokens_and_keywords(spark):
    assert one(spark, "The LOAN-42 of é", T.tokens) == ["the", "loan", "42", "of"]
    assert one(spark, "what about the loan, the LOAN and my amount", T.keywords) == ["loan", "amount"]
    assert one(spark, None, T.content_tokens) == []


def test_window_and_snippet(spark):
    text = "x " * 400 + "needle here" + " y" * 400
    w = one(spark, text, lambda c: T.window_around(c, F.lit("where is the needle"), 100))
    assert "needle" in w and w.startswith("...") and w.endswith("...") and len(w) <= 106
    long = one(spark, "a" * 3000, lambda c: T.window_around(c, F.lit(""), 2000))
    assert "\n...\n" in long
    assert one(spark, "b" * 300, T.snippet) == "b" * 219 + "…"
    assert one(spark, "a.PDF", lambda c: T.source_label(c, F.lit(3))) == "a · p.3"


def test_notes(spark):
    assert one(spark, " a ", lambda c: T.merge_notes(c, F.lit(None), F.lit("b"))) == "a\nb"
    assert one(spark, None, lambda c: T.merge_notes(c)) is None
    assert one(spark, "<a>\n", T.html_note) == "&lt;a&gt;<br>"
    assert one(spark, "/x/y.txt", T.path_hint) == "y.txt"


def test_query_normalize(spark):
    for given, want in (
        ("  SUMMARIZE  this ", "summarize this document"), ("and phone", "what is the phone number"), ("contact email", "email"), ("what is this file about", "summarize this document"), ("", ""),
    ):
        assert one(spark, given, Q.normalize_query) == want
        assert one(spark, want, Q.normalize_query) == want


def test_intents(spark):
    q = lambda s, f: one(spark, s, lambda c: f(Q.normalize_query(c)))
    assert q("Who are you?", Q.is_assistant_identity) and not q("Who are you?", Q.expects_documents)
    assert q("what is machine learning", Q.is_short_concept)
    assert q("summarize", Q.is_broad_overview) and q("give me an overview of this file", Q.uses_relaxed_gate)
    assert q("what is the email address", Q.expects_documents)
    assert q("who is the CFO of the company", Q.is_entity_lookup) and not q("exact recipe who is the cfo", Q.is_entity_lookup)
    assert q("what does section 7 say", Q.is_section_navigation)
    assert q("what is the applicant name", Q.field_kind) == "person_name"
    assert q("what is the contact number", Q.field_kind) == "phone"
    assert q("good morning to you", Q.takes_fast_path)
