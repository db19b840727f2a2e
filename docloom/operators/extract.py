"""Deterministic answers from texts: labelled fields, contact details, prose sentences, themes and section quotes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse

MOST_ENTITIES = 10_000
BLANK = "[ \\t\\x{00A0}]*"
# Forms of amounts and identifiers, and the label-value patterns of each field with the group of the value.
AMOUNT = r"(?:₹\s*)?\d{1,3}(?:,\d{3})*(?:\.\d{2})"
IDENTIFIER = r"[A-Z0-9][A-Z0-9\-\/]{3,}"
ADDRESS_OF_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
FIELDS = {
    "loan_disbursed_amount": ((rf"\b(loan{BLANK}disbursed{BLANK}amount|disbursed{BLANK}amount|loan{BLANK}amount)\b{BLANK}[:\-]?\s*({AMOUNT})\b", 2),),
    "person_name": (
        (rf"\b(applicant{BLANK}name|full{BLANK}name|subject{BLANK}name|borrower{BLANK}name|primary{BLANK}holder|customer{BLANK}name|account{BLANK}holder|legal{BLANK}name)\b{BLANK}[:\-]?\s*([A-Z][A-Za-z \.\'\-]{{2,}})\b", 2),
        (rf"^\s*(full{BLANK}name|name)\s*[:\-]\s*([A-Za-z][A-Za-z \.\'\-]{{2,}})\b", 2),
    ),
    "application_number": ((rf"\b(application{BLANK}(number|no\.?|#)){BLANK}[:\-]?\s*({IDENTIFIER})\b", 3),),
    "email": ((rf"\b(e-?mail{BLANK}address|email{BLANK}address|e-?mail|email)\b{BLANK}[:\-]?\s*({ADDRESS_OF_MAIL})\b", 2), (rf"\b(contact)\b{BLANK}[:\-]?\s*({ADDRESS_OF_MAIL})\b", 2)),
    "phone": ((rf"\b(contact{BLANK}number|phone{BLANK}number|contact|phone|mobile|cell|tel\.?)\b{BLANK}[:\-]?\s*([\d()+\-\s]{{10,24}})\b", 2),),
    "website": ((rf"\b(website|web{BLANK}page|homepage|url)\b{BLANK}[:\-]?\s*((?:https?://|www\.)[A-Za-z0-9._~/?#=\-]+)", 2),),
    "address": ((rf"\b(current{BLANK}address|mailing{BLANK}address|address)\b{BLANK}[:\-]?\s*(.+?)\s*$", 2),),
}
#: Words that every label holds; other lines are not looked at.
LABEL_WORDS = r"(?i)(name|holder|application|amount|mail|contact|phone|mobile|cell|tel|web|url|homepage|address)"
#: One of these parts stands in every label of a kind; only then are the kind's patterns tried on a line.
KIND_WORDS = {
    "loan_disbursed_amount": ("amount",), "person_name": ("name", "holder"), "application_number": ("application",), "email": ("mail", "contact"), "phone": ("contact", "phone", "mobile", "cell", "tel"), "website": ("web", "homepage", "url"), "address": ("address",),
}
# Labels whose value stands on the next line, and words that no name holds.
LABEL_ALONE = {"email": r"^\s*(e-?mail|email)\s*[:\-]?\s*$", "phone": r"^\s*(phone|contact|mobile|cell|tel|contact number)\s*[:\-]?\s*$"}
VALUE_ALONE = {"email": rf"^{ADDRESS_OF_MAIL}$", "phone": r"^[\d()+\-\s]{10,24}$"}
NOT_NAMES = ("or", "and", "number", "application", "loan", "amount", "date", "id", "no", "ref")
ADDRESS_WORDS = ("street", "st.", "road", "rd.", "avenue", "ave", "lane", "drive", "blvd", "suite", "unit", "apt", "city", "state", "zip", "pin", "country", "p.o", "po box")
# Parts of texts and the themes they stand for, in order. Names of firms, persons and products with a theme
# or an overview of their own are data of the library: ``themes`` and ``entity_overview`` take them as a table.
THEMES = (
    ("loan", "loan processing and obligations"), ("applicant", "applicant details"), ("repayment", "repayment terms"), ("interest certificate", "interest documentation"), ("interest", "interest and rates"),
    ("disbursed", "disbursement amounts"), ("application number", "application tracking"), ("application", "application context"), ("company", "company or organization background"), ("role", "roles and responsibilities"),
    ("contact", "contact and coordination details"), ("email", "contact channels"), ("phone", "contact channels"), ("website", "web presence"), ("ceo", "leadership"), ("chief engineer", "engineering leadership"),
    ("engineer", "technical roles"), ("employee", "workforce size and roles"), ("mission", "mission and strategy"), ("project", "projects and initiatives"), ("product", "products and offerings"), ("customer", "customers and accounts"),
    ("revenue", "financial performance"), ("contract", "contractual terms"), ("policy", "policy content"),
)


def lines(texts: DataFrame, key: str = "document_id", by: str = "source_name") -> DataFrame:
    """``<by>, <key>, line_no, line, following`` of every line; ``following`` are up to four lines behind it."""
    split = texts.where("text is not null").select(by, key, F.split(F.btrim("text", F.lit(" \t\n\r")), r"\r\n|\n|\r").alias("_l"))
    at = split.select(by, key, "_l", F.posexplode("_l").alias("line_no", "line"))
    return at.select(by, key, "line_no", "line", F.slice("_l", F.col("line_no") + 2, 4).alias("following"))


def field_value(kind: str, line: Column, following: Column) -> Column:
    """The acceptable value of a field on a line, or null."""
    out = F.lit(None).cast("string")
    next_line = F.btrim(F.try_element_at(following, F.lit(1)))
    if kind in LABEL_ALONE:
        out = F.when(F.regexp_like(line, F.lit("(?i)" + LABEL_ALONE[kind])) & F.regexp_like(next_line, F.lit(VALUE_ALONE[kind])), next_line)
    for pattern, group in reversed(FIELDS[kind]):
        value = F.btrim(F.regexp_extract(line, "(?i)" + pattern, group))
        out = F.when(F.regexp_like(line, F.lit("(?i)" + pattern)), value).otherwise(out)
    if kind == "phone":
        out = collapse(out)
        return F.when(F.char_length(F.regexp_replace(out, r"[^0-9]", "")) >= 10, out)
    if kind == "person_name":
        words = F.transform(F.split(F.lower(out), r"\s+"), lambda w: F.btrim(w, F.lit(".")))
        return F.when(~F.arrays_overlap(words, F.array(*map(F.lit, NOT_NAMES))) | (F.size(words) < 2), out)
    if kind == "address":
        # continued on the lines behind until a blank or labelled one
        goes_on = lambda l: (F.btrim(l) != "") & ~F.regexp_like(F.btrim(l), F.lit(r"^[A-Za-z][A-Za-z0-9 /]{0,42}:\s*\S"))
        start = F.struct(out.alias("t"), F.lit(1).alias("n"), F.lit(True).alias("go"))
        merged = F.aggregate(
            following, start,
            lambda a, l: F.when(a["go"] & goes_on(l) & (a["n"] < 4) & (F.char_length(a["t"]) < 240), F.struct(F.concat(a["t"], F.lit(" "), F.btrim(l)).alias("t"), (a["n"] + 1).alias("n"), F.lit(True).alias("go")))
            .otherwise(F.struct(a["t"].alias("t"), a["n"].alias("n"), F.lit(False).alias("go"))),
            lambda a: collapse(a["t"]),
        )
        low = F.lower(merged)
        shaped = F.regexp_like(merged, F.lit(r"\d"))
        for w in ADDRESS_WORDS:
            shaped = shaped | low.contains(w)
        return F.when(F.char_length(merged).between(8, 260) & shaped, merged)
    return F.nullif(out, F.lit(""))


def first_fields(texts: DataFrame, by: str = "source_name", key: str = "document_id") -> DataFrame:
    """``<by>, kind, value, <key>``: the first acceptable value of each field in each group, by key and line.

    Lines that hold no field are dropped before anything is shuffled; the first of the rest is an aggregate, so groups
    of any size are combined on the map side.
    """
    at = lines(texts, key, by).where(F.regexp_like("line", F.lit(LABEL_WORDS))).withColumn("_low", F.lower("line"))
    may = lambda k: reduce(lambda a, b: a | b, [F.col("_low").contains(w) for w in KIND_WORDS[k]])
    values = F.array(*[F.struct(F.lit(k).alias("kind"), F.when(may(k), field_value(k, F.col("line"), F.col("following"))).alias("value")) for k in FIELDS])
    found = at.select(by, key, "line_no", F.explode(values).alias("f")).where("f.value is not null").select(by, key, "line_no", "f.*")
    first = found.groupBy(by, "kind").agg(F.min(F.struct(F.col(key), "line_no", "value")).alias("m"))
    return first.select(by, "kind", "m.value", F.col(f"m.{key}").alias(key))


def contact_bundle(fields: DataFrame, by: str = "source_name") -> DataFrame:
    """``<by>, fields, answer`` of groups with at least two of e-mail, phone, website and address."""
    order = {"email": "**Email**: ", "phone": "**Phone**: ", "website": "**Website**: ", "address": "**Address**: "}
    wide = fields.where(F.col("kind").isin(*order)).groupBy(by).agg(*[F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in order], F.count("*").alias("fields"))
    parts = F.concat_ws("\n", *[F.concat(F.lit(label), F.col(k)) for k, label in order.items()])
    return wide.where("fields >= 2").select(by, "fields", F.concat(F.lit("Here is the contact information from the document:\n"), parts).alias("answer"))


def prose_sentences(text: Column, limit: int = 8) -> Column:
    """The first sentences of 48 to 560 characters that are no labelled values."""
    parts = F.split(F.regexp_replace(collapse(text), r"([.!?]) ", "$1\u0001"), "\u0001")
    good = lambda p: (
        F.char_length(p).between(48, 560) & ~(F.regexp_like(p, F.lit(r"^[A-Za-z0-9_\s\-]{2,52}:\s*\S+$")) & (F.char_length(p) < 140)) & (F.char_length(p) - F.char_length(F.replace(p, F.lit(":"), F.lit(""))) <= 2)
    )
    return F.slice(F.filter(F.transform(parts, lambda p: F.btrim(p)), good), 1, limit)


def themes(text: Column, table: tuple[tuple[str, str], ...] = THEMES, limit: int = 6) -> Column:
    """Distinct themes of a text, in the table's order."""
    low = F.lower(text)
    found = F.array_compact(F.array(*[F.when(low.contains(part), theme) for part, theme in table]))
    return F.slice(F.array_distinct(found), 1, limit)


def entity_overview(texts: DataFrame, entities: DataFrame, by: str = "query_id", text: str = "text") -> DataFrame:
    """``<by>, answer``: an overview that names the known entities of a text; texts without any are left out.

    ``entities(part, kind, name)``: a lower-case part of texts, the kind of entity it shows (``company``, ``person``,
    ``role``, ``project``) and its name. Roles and projects are told only beside a company or person.
    """
    found = texts.select(by, F.lower(F.col(text)).alias("_t")).join(F.broadcast(entities.limit(MOST_ENTITIES)), F.col("_t").contains(F.col("part")))
    named = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name"))))
    wide = found.groupBy(by).agg(*[named(k).alias(k) for k in ("company", "person", "role", "project")])
    who = F.concat("company", "person")
    roles = F.when(F.size("role") > 1, F.concat(F.lit("including roles as "), F.array_join("role", " and "))).when(F.size("role") == 1, F.concat(F.lit("including the role of "), F.array_join("role", "")))
    parts = F.concat_ws(", ", F.concat(F.lit("This document provides an overview of "), F.array_join(who, " and ")), roles, F.when(F.size("project") > 0, F.concat(F.lit("projects such as "), F.array_join("project", " and "))))
    return wide.where(F.size(who) > 0).select(by, F.concat(parts, F.lit(".")).alias("answer"))


def raw_fields(segments: DataFrame, asked: DataFrame) -> DataFrame:
    """``query_id, source_name, value``: a field that the index's hits did not show, from the whole texts of the library.

    ``asked(query_id, kind, preferred)``; the preferred source comes first, then the others by name. Where no labelled
    e-mail address stands anywhere in a source, its first address does.
    """
    fields = first_fields(segments.where("source_name is not null")).select("kind", "source_name", "value", F.lit(0).alias("loose"))
    any_mail = (
        segments.where(F.col("source_name").isNotNull() & F.col("text").contains("@"))
        .select("source_name", "document_id", F.nullif(F.regexp_extract("text", rf"\b({ADDRESS_OF_MAIL})\b", 1), F.lit("")).alias("v")).where("v is not null")
        .groupBy("source_name").agg(F.min_by("v", "document_id").alias("value")).select(F.lit("email").alias("kind"), "source_name", "value", F.lit(1).alias("loose"))
    )
    all_ = fields.unionByName(any_mail)
    own = all_.groupBy("kind", F.lower("source_name").alias("_p")).agg(F.min_by(F.struct("source_name", "value"), F.struct("loose", "source_name")).alias("own"))
    first = all_.groupBy("kind").agg(F.min_by(F.struct("source_name", "value"), F.struct("source_name", "loose")).alias("any"))
    both = asked.join(own, (asked.kind == own.kind) & (F.lower(F.btrim("preferred")) == F.col("_p")), "left").drop(own.kind).join(F.broadcast(first), "kind")
    best = F.coalesce("own", "any")
    return both.select("query_id", best["source_name"].alias("source_name"), best["value"].alias("value"))


def overview(hits: DataFrame, text: str = "text", source: str = "source_name", order: str = "rank") -> DataFrame:
    """``query_id, source_name, answer`` from the dominant source's hits: up to three prose sentences, else its themes.

    A query whose hits do not gather on one source (three hits, or six tenths) gets none.
    """
    from .ranking import dominant_source

    top = dominant_source(hits.withColumnRenamed(source, "source_name") if source != "source_name" else hits, order).where("hits >= 3 or share >= 0.6").select("query_id", F.col("source_name").alias("_s"))
    own = hits.join(top, "query_id").where(F.btrim("source_name") == F.col("_s"))
    # hits of a query are bounded by its pool
    blob = own.groupBy("query_id", "_s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n").alias("blob"))
    s, t = prose_sentences(F.col("blob"), 3), themes(F.col("blob"))
    themed = F.when(F.size(t) == 1, F.element_at(t, 1)).when(F.size(t) == 2, F.array_join(t, " and ")).otherwise(F.concat(F.array_join(F.slice(t, 1, F.size(t) - 1), ", "), F.lit(", and "), F.element_at(t, -1)))
    answer = F.when(F.size(s) >= 2, F.array_join(s, " ")).when((F.size(t) >= 2) | ((F.size(t) == 1) & (F.size(s) == 0)), F.concat(F.lit("It provides an overview of "), themed, F.lit(".")))
    return blob.select("query_id", F.col("_s").alias("source_name"), answer.alias("answer")).where("answer is not null")


def section_quotes(texts: DataFrame, key: str = "document_id") -> DataFrame:
    """``<key>, section, quote``: for each section number that a text names, its first sentence of 10 to 420 characters that does."""
    flat = texts.where("text is not null").select(key, F.split(F.regexp_replace(collapse(F.col("text")), r"([.!?]) ", "$1\u0001"), "\u0001").alias("_p"))
    each = flat.select(key, F.posexplode("_p").alias("n", "quote")).where(F.regexp_like("quote", F.lit(r"(?i)section\s*\d+\b")) & F.char_length("quote").between(10, 420))
    numbered = each.select(key, "n", "quote", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("quote"), F.lit(r"section\s*(\d+)\b"), F.lit(1)))).alias("section"))
    return numbered.groupBy(key, "section").agg(F.min_by("quote", "n").alias("quote"))


def first_by(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
