"""Text functions as column expressions: normalising, tokens, windows, labels, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space but the line feed, and with it.
INLINE = r"[ \t\x0B\f\r\x1c-\x1f\x85   -     　]"
SPACE = r"[ \t\n\x0B\f\r\x1c-\x1f\x85   -     　]"

# Words that carry no content in keyword and support checks; the keyword list adds possessives.
STOP_WORDS = (
    "a an the and or but if to of in on for with as at by from is are was were be been being "
    "it this that these those i you we they he she not no yes so than then there here do does did "
    "can could should would will just only very more most also into about out up what which who "
    "how when where why all any each both few such too"
).split()
POSSESSIVES = "my your our their".split()


def collapse(c: Column) -> Column:
    """White space runs as single blanks, none outside."""
    return F.btrim(F.regexp_replace(c, SPACE + "+", " "))


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def normalize_line(c: Column) -> Column:
    """One line: white space collapsed and stripped; null as empty."""
    return F.coalesce(collapse(c), F.lit(""))


def normalize_text(c: Column) -> Column:
    """Lines normalised, line ends unified, blank line runs as one blank line, none outside."""
    t = F.regexp_replace(c, r"\r\n?", "\n")
    t = F.regexp_replace(t, INLINE + "+", " ")
    t = F.regexp_replace(t, " ?\n ?", "\n")
    t = F.regexp_replace(t, "\n{2,}", "\n\n")
    return F.btrim(t, F.lit(" \n"))


def repair_hyphens(c: Column) -> Column:
    """Words broken over a line end by a hyphen joined."""
    return F.regexp_replace(c, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def content_tokens(c: Column) -> Column:
    """Distinct tokens of three and more characters without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_WORDS)))


def keywords(c: Column, limit: int = 8) -> Column:
    """The first ``limit`` distinct content words of a query, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0))
    kept = F.filter(found, lambda w: ~w.isin(*STOP_WORDS, *POSSESSIVES))
    return F.slice(F.array_distinct(kept), 1, limit)


def window_around(text: Column, query: Column, most: int = 2000) -> Column:
    """At most ``most`` characters around the first occurrence of the first keyword that occurs, else head and tail."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\f\x0b"))
    low, n = F.lower(t), F.char_length(t)
    at = F.try_element_at(F.filter(F.transform(keywords(query), lambda k: F.call_function("instr", low, k)), lambda i: i > 0), F.lit(1)) - 1
    start = F.greatest(F.lit(0), at - most // 2)
    end = F.least(n, start + most)
    start = F.greatest(F.lit(0), end - most)
    inside = F.concat(F.when(start > 0, "...").otherwise(""), F.btrim(F.substring(t, start + 1, end - start)), F.when(end < n, "...").otherwise(""))
    head = max(200, int(most * 0.6))
    tail = max(120, most - head - 20)
    ends = F.concat(F.rtrim(F.substring(t, 1, head)), F.lit("\n...\n"), F.ltrim(F.substring(t, n - tail + 1, F.lit(tail))))
    return F.when(n <= most, t).when(at.isNotNull(), inside).otherwise(ends)


def snippet(c: Column, limit: int = 220) -> Column:
    """White space collapsed, cut with an ellipsis."""
    t = normalize_line(c)
    return F.when(F.char_length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…")))


def source_label(name: Column, page: Column) -> Column:
    """File name without its known extension, and the page."""
    base = F.regexp_replace(F.btrim(F.coalesce(name, F.lit(""))), r"(?i)\.(pdf|txt|docx)$", "")
    base = F.when(base == "", "Source").otherwise(base)
    return F.when(page.isNull(), base).otherwise(F.concat(base, F.lit(" · p."), page.cast("string")))


def replace_dashes(c: Column) -> Column:
    """Em dashes as commas."""
    return F.replace(c, F.lit("—"), F.lit(","))


def merge_notes(*notes: Column) -> Column:
    """Non-empty notes joined by line ends, or null."""
    trimmed = F.filter(F.transform(F.array(*notes), lambda n: F.btrim(n)), lambda n: F.coalesce(n != "", F.lit(False)))
    return F.nullif(F.array_join(trimmed, "\n"), F.lit(""))


def html_note(c: Column) -> Column:
    """Note text escaped for HTML, with line breaks."""
    t = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def path_hint(c: Column) -> Column:
    """The last component of a path."""
    return F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1)
