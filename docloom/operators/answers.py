"""Checks of answers against their sources, and evaluation of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_tokens, merge_notes, strip

# The phrase of not knowing, and the limits of the lexical check.
UNKNOWN = "I don't know based on the provided documents."
LEAST_OVERLAP, LEAST_TOKENS, LEAST_LENGTH = 0.12, 6, 100
WITHHELD = "Answer cited a source number not in this reply's context; reply was withheld."
UNSUPPORTED = "Automated check: much of the wording may not appear in the retrieved excerpts; verify in Sources."


def citations(answer: Column) -> Column:
    """Source numbers that an answer cites, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"(?i)\[SOURCE\s+(\d+)\s*\]"), F.lit(1)), lambda n: n.cast("int"))


def citations_valid(answer: Column, sources: Column) -> Column:
    """Whether every citation names one of the sources; true without citations or sources."""
    return (F.coalesce(sources, F.lit(0)) <= 0) | F.forall(citations(answer), lambda n: n.between(1, sources))


def lexical_support(answer: Column, corpus: Column) -> Column:
    """Share of an answer's content words in the corpus; 1 for short answers or none to compare with."""
    a, c = content_tokens(answer), content_tokens(corpus)
    share = F.size(F.array_intersect(a, c)) / F.size(a)
    return F.when((strip(F.coalesce(answer, F.lit(""))) == "") | corpus.isNull() | (F.size(a) < LEAST_TOKENS), 1.0).when(F.size(c) == 0, 0.0).otherwise(share)


def validate(answer: Column, corpus: Column, sources: Column) -> Column:
    """Struct ``text, warning``: the answer, or the phrase of not knowing for a false citation; a warning if it is hardly
    supported."""
    t = strip(F.coalesce(answer, F.lit("")))
    of = lambda text, warning: F.struct(text.alias("text"), warning.cast("string").alias("warning"))
    weak = (F.char_length(t) > LEAST_LENGTH) & (lexical_support(t, corpus) < LEAST_OVERLAP)
    return (
        F.when(t == "", of(F.lit(UNKNOWN), F.lit(None))).when(F.lower(t).contains(UNKNOWN.lower()), of(t, F.lit(None)))
        .when(~citations_valid(t, sources), of(F.lit(UNKNOWN), F.lit(WITHHELD))).when(weak, of(t, F.lit(UNSUPPORTED))).otherwise(of(t, F.lit(None)))
    )


def fall_back(answer: Column, quote: Column, overview: Column, corpus: Column, sources: Column) -> Column:
    """Struct ``text, warning``: an answer that does not know is replaced by a section's quote, and where that is none or
    withheld by an overview; either is validated again, and the warnings of both are kept."""
    of = lambda text, warning: F.struct(text.alias("text"), warning.cast("string").alias("warning"))
    unknown = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains(UNKNOWN.lower())
    first, second = validate(quote, corpus, sources), validate(overview, corpus, sources)
    cur, note = F.when(quote.isNotNull(), first["text"]).otherwise(answer), F.when(quote.isNotNull(), first["warning"])
    again = unknown(cur) & overview.isNotNull()
    text, warning = F.when(again, second["text"]).otherwise(cur), F.when(again, merge_notes(note, second["warning"])).otherwise(note)
    return F.when(unknown(answer) & (text != answer), of(text, warning)).otherwise(of(answer, F.lit(None)))


def refuses(text: Column) -> Column:
    """Whether an answer says that the documents do not tell."""
    t = F.lower(F.coalesce(text, F.lit("")))
    c = t.contains
    return (
        c(UNKNOWN.lower()) | (c("don't know") & c("document")) | (c("cannot") & c("document") & (c("find") | c("locate") | c("provided"))) | (c("not") & c("provided") & c("document"))
        | c("do not contain") | c("does not contain") | c("don't contain") | (c("no information") & (c("document") | c("file") | c("upload")))
    )


def score(cases: DataFrame) -> DataFrame:
    """Adds the scores of a case to rows with ``mode, text, hits_text, hit_count`` and the expected ``mode_in, refusal,
    any_of, anchors, forbidden`` (arrays may be null). ``citation_ok`` is null where no citation is due."""
    t, h = F.lower(F.coalesce("text", F.lit(""))), F.lower(F.coalesce("hits_text", F.lit("")))
    some = lambda words, where: (F.coalesce(F.size(words), F.lit(0)) <= 0) | F.exists(words, lambda w: where.contains(F.lower(w)))
    said, want = refuses(F.col("text")), F.coalesce("refusal", F.lit(False))
    cited = citations(F.col("text"))
    due = F.col("mode").isin("grounded", "blended")
    citation = F.when(want, F.lit(None).cast("boolean")).when(due & (F.col("hit_count") > 0), (F.size(cited) > 0) & (F.array_max(cited) <= F.col("hit_count"))).when(due, False)
    out = cases.select(
        "*", F.coalesce(F.array_contains(F.coalesce("mode_in", F.array(F.lit("grounded"))), F.col("mode")), F.lit(False)).alias("routing_ok"), F.when(want, said | F.col("mode").isin("general", "web")).otherwise(~said).alias("refusal_ok"), (~want & said).alias("false_refusal"),
        some(F.col("any_of"), t).alias("keywords_ok"), some(F.col("anchors"), h).alias("anchors_ok"), ((F.coalesce(F.size("forbidden"), F.lit(0)) <= 0) | F.forall("forbidden", lambda w: ~t.contains(F.lower(w)))).alias("forbidden_ok"), citation.alias("citation_ok"),
    )
    passed = F.col("routing_ok") & F.col("refusal_ok") & F.col("keywords_ok") & F.col("anchors_ok") & F.col("forbidden_ok") & F.coalesce("citation_ok", F.lit(True))
    return out.withColumn("passed", passed)


def rates(scored: DataFrame) -> DataFrame:
    """One row of totals and rates over all cases."""
    part = lambda c: F.round(F.count_if(F.col(c)) / F.count("*"), 4)
    return scored.agg(
        F.count("*").alias("cases"), F.count_if("passed").alias("passed"), part("passed").alias("pass_rate"), part("routing_ok").alias("routing_ok_rate"), part("anchors_ok").alias("anchor_rate"), F.count_if("false_refusal").alias("false_refusals"), F.count_if(~F.col("forbidden_ok")).alias("forbidden_hits")
    )


def by_category(scored: DataFrame) -> DataFrame:
    """Totals and pass rate of each category (``unknown`` for none)."""
    return scored.groupBy(F.coalesce(F.nullif("category", F.lit("")), F.lit("unknown")).alias("category")).agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.round(F.count_if("passed") / F.count("*"), 4).alias("pass_rate")
    )


def concern(note: Column) -> Column:
    """The kind of validation that a turn's note tells of, or null."""
    n = F.lower(F.coalesce(note, F.lit("")))
    return (
        F.when(n.contains("withheld"), "source_citation_withheld").when(n.contains("removed from the answer") | n.contains("did not match retrieved"), "web_link_sanitized")
        .when(n.contains("verify in sources") | n.contains("retrieved excerpts"), "lexical_support_warning")
    )


def text_report(totals: DataFrame, categories: DataFrame) -> DataFrame:
    """``line_no, line``: a report of ``rates`` and ``by_category`` in lines of text."""
    head = totals.select(F.lit(0).alias("a"), F.lit("").alias("k"), F.format_string("cases %d, passed %d (%.4f), routing %.4f, anchors %.4f, false refusals %d, forbidden %d", "cases", "passed", "pass_rate", "routing_ok_rate", "anchor_rate", "false_refusals", "forbidden_hits").alias("line"))
    rows = categories.select(F.lit(1).alias("a"), F.col("category").alias("k"), F.format_string("%s: %d of %d (%.4f)", "category", "passed", "total", "pass_rate").alias("line"))
    # one row for each category of the evaluation set
    return head.unionByName(rows).withColumn("line_no", F.row_number().over(Window.partitionBy().orderBy("a", "k")) - 1).select("line_no", "line")
