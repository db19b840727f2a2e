"""Query functions as column expressions: normalising and intent predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse

# Phrase rewrites, in order (pattern, replacement), on the lower-cased query.
PHRASES = (
    (r"^and\s+phone\s*$", "what is the phone number"),
    (r"^and\s+phone\s+number\s*$", "what is the phone number"),
    (r"^and\s+website\s*$", "what is the website"),
    (r"^and\s+email\s*$", "what is the email"),
    (r"^and\s+address\s*$", "what is the address"),
    (r"^and\s+name\s*$", "what is the name"),
    (r"^what\s+about\s+phone\s*$", "what is the phone number"),
    (r"^what\s+about\s+website\s*$", "what is the website"),
    (r"^what\s+about\s+email\s*$", "what is the email"),
    (r"^what\s+about\s+address\s*$", "what is the address"),
    (r"^what\s+about\s+name\s*$", "what is the name"),
    (r"\bsummarize\s+this\s*$", "summarize this document"),
    (r"\bsummarise\b", "summarize"),
    (r"\bsumarize\b", "summarize"),
    (r"\b(what|help me understand)\s+(?:is\s+)?(?:this|the)(?:\s+document|\s+file)?\s+about\b", "summarize this document"),
    (r"\bsumary\b", "summary"),
    (r"\bsmmary\b", "summary"),
    (r"\bexplian\b", "explain"),
    (r"\bcontact\s+email\b", "email"),
    (r"\bcontact\s+number\b", "phone number"),
    (r"\bcompany\s+site\b", "website"),
    (r"\bfile\s*name\b", "document name"),
    (r"\bfilename\b", "document name"),
    (r"\bprojects\s+mentioned\b", "projects"),
    (r"\bprograms\s+mentioned\b", "programs"),
    (r"\btechnologies\s+are\s+used\b", "technologies"),
    (r"\btechnologies\s+used\b", "technologies"),
    (r"\bwhat\s+company\s+is\s+this\s+about\b", "what company is discussed"),
    (r"\bsummarize\s+this\s+doc\b", "summarize this document"),
    (r"\bexplain\s+this\s+doc\b", "explain this document"),
    (r"\bsummarize\s+this\s+file\b", "summarize this document"),
    (r"\bdoe\s+he\b", "does he"),
    (r"\bdoe\s+she\b", "does she"),
    (r"\bdoe\s+they\b", "do they"),
    (r"\bdid\s+they\s+included\b", "did they include"),
    (r"\bfullname\b", "full name"),
)
# Misspelt parts of words.
TYPOS = (
    ("webiste", "website"), ("conatct", "contact"), ("adress", "address"), ("emial", "email"), ("phne", "phone"), ("nuber", "number"),
    ("numbr", "number"), ("fone", "phone"), ("proejcts", "projects"), ("projets", "projects"), ("technolgies", "technologies"),
)
# Misspelt whole words.
NEAR_MISSES = (
    (r"\bsumm?ar(i|e)ze\b", "summarize"), (r"\bsummarzie\b", "summarize"), (r"\bsummarizee\b", "summarize"), (r"\bsummariy\b", "summary"),
    (r"\bsummery\b", "summary"), (r"\bexplan\b", "explain"),
)

# Patterns of the intents, searched without case in the normalised query.
ASSISTANT_IDENTITY = (
    r"^\s*(who\s+are\s+you\b|what\s+are\s+you\b|what(?:'s|\s+is)\s+your\s+name\b|who\s+(built|created|made|owns|runs)\s+(you|this(\s+app|\s+assistant|\s+tool|\s+product|\s+service)?)\b|"
    r"what\s+are\s+you\s+called\b|what\s+model\s+are\s+you\b|what\s+is\s+this\s+(app|tool|assistant|product|service|website)\b)\s*[?.!]*\s*$"
)
# Simplified from the usual value: alternatives that others cover are left out, and a lookahead that the end of the
# pattern implies.
SHORT_CONCEPT = (
    r"^\s*((what\s+is\s+)?(an?\s+)?(ml|machine\s+learning)\s+engineer\b|(what\s+is\s+)?(a\s+)?data\s+(engineer|scientist)\b|(what\s+is\s+)?(a\s+)?machine\s+learning\s+engineer\b|"
    r"(what\s+is\s+)?(an?\s+)?ml\b|(what\s+is\s+)?(a\s+)?machine\s+learning\b|data\s+(engineer|scientist)\b)\s*[?.!]*\s*$"
)
DOCUMENT_SCOPE = (
    r"\b(document|documents|file|files|pdf|upload|uploaded|page|pages|passage|passages|excerpt|excerpts|cite|citation|source\b|sources\b|section|library|chunk|table\b|tables\b|"
    r"these files|my files|the text|summarize|summary|summarise|key points?|main points?|bullet points?|takeaways?|highlights?|main topics?|key topics?|topics?\b|themes?\b|outline|gist|overview|"
    r"big picture|high[-\s]?level|tl;?dr|playbook|internal|handbook|memo|flash|brief|revenue|earnings|profit|loss|quarter|q[1-4]\b|fiscal|ceo|cfo|corp|finance|financial|acme|"
    r"extract|according to|from the|in the document|this (file|doc|pdf|paper)|what does (this|the|it|my)\s+(\w+\s+){0,4}(file|document|playbook)\s+(say|discuss|cover|mention)|"
    r"what (is|are)\s+(this|the|it|they)\s+(\w+\s+){0,3}about|what (is|are)\s+the\s+(main|key)\s+|purpose\s+of\s+(this|the|my)|what\s+is\s+the\s+purpose|central\s+theme|thesis|argument|conclusion|introduction|"
    r"explain\s+(this|the)\s+(document|file)|describe\s+(this|the)\s+(document|file)|performance|latency|latencies|throughput|benchmark|metric|metrics|sla\b|requirements?|p99|discussed|discussion|plain language"
    r"|loan|loans|applicant|application\s+number|disbursed\s+amount|repayment\s+schedule|interest\s+certificate|rate\s+of\s+interest|what\s+company|which\s+company|company\s+discussed|organization\s+discussed|employer\s+discussed"
    r"|what\s+projects|projects?\s+mentioned|programs?\s+mentioned|initiatives?\s+mentioned|what\s+technologies|technologies\s+(used|does|do|are)|technology\s+stack|how\s+many\s+employees|employee\s+count|headcount|workforce\s+size"
    r"|website\b|web\s*site|homepage|contact\s+email|contact\s+number|contact\s+info|contact\s+information|tell\s+me\s+more|details|elaborate|more\s+details|expand|what\s+else|\bdoes\s+[a-z][a-z]+\s+[a-z][a-z]+\s+know\b)\b"
)
STRUCTURED_FIELD = (
    r"(\bwhat\s*(?:'s|is|was)\s+(?:the\s+)?(?:his|her|their|its|my|your|our)?\s*(?:e-?mail(?:\s+address)?|email(?:\s+address)?|contact\s+e-?mail|contact\s+email|phone(?:\s+number)?|contact(?:\s+number)?|mobile\b|"
    r"(?:full\s+)?name\b|(?:current\s+)?address\b|website\b|web\s*page|homepage|\burl\b)\b|\b(?:his|her|their|its|my|your)\s+(?:e-?mail|email|phone|mobile|address|name)\b|\b(?:e-?mail|email|phone|contact|address)\s+(?:on\s+file|in\s+the\s+(?:file|document))\b)"
)
SUMMARIZE_ALONE = r"^\s*summarize\s*[?.!]*\s*$"
BROAD_OVERVIEW = (
    r"\b(what\s+is\s+(this|the|it)\s+.+\s+about|what\s+(is|are)\s+(this|the|it)\s+about|summarize|summarise|summary\b|overview\b|synopsis\b|main\s+points?|key\s+points?|key\s+ideas?|main\s+ideas?|main\s+topics?|key\s+topics?|"
    r"what\s+are\s+the\s+(main|key)\s+(points?|topics?|themes?|ideas?)|what\s+does\s+(this|the)\s+(file|document)\s+discuss|what\s+is\s+the\s+(purpose|topic|subject|gist|main\s+idea)|purpose\s+of\s+(this|the|my)\s+(file|document)?|"
    r"high[-\s]?level|big\s+picture|central\s+theme|takeaways?|highlights?|give\s+me\s+an?\s+overview|brief\s+overview|give\s+(me\s+)?(a\s+)?summary\b|explain\s+(this|the|my)\s+(document|file)\b|"
    r"summar(?:y|ise|izing)\s+(?:of\s+)?(?:this|the|my)\s+(?:document|file)\b|(?:give\s+me\s+)?a?\s*summary\s+of\s+(?:this|the|my)\s+(?:document|file)\b)\b"
)
COMPANY_QUESTION = r"\b(what\s+company|which\s+company|company\s+discussed|organization\s+discussed)\b"
PROJECT_QUESTION = r"\bwhat\s+projects\b|\bprojects?\s+mentioned\b"
TECHNOLOGY_QUESTION = r"\bwhat\s+technologies\b|\btechnologies\s+(does|do|are|used)\b"
PERFORMANCE_WORDS = r"\b(performance|latency|p99|throughput|workload|sla|benchmark|metrics?|reliability)\b"
VAGUE_DISCUSSION = r"\b(how|what)\b.+\b(discussed|discussion|covered|addressed|talked\s+about)\b"
ENTITY_LOOKUP = (
    r"\b(company\b|organization\b|employer\b|website\b|homepage\b|\burl\b|named\s+as\b|who\s+is\s+named\b|name\s+of\b|who\s+is\b|who\s+was\b|owner\b|maintainer\b|on-?call\b|manager\b|director\b|lead\b|author\b|reviewer\b|approver\b|"
    r"contact\b|point\s+of\s+contact\b|cfo\b|ceo\b|cto\b|coo\b|ciso\b|finance\b|financial\b|accounting\b|effective\s+date\b|expires?\b|deadline\b|due\s+date\b|invoice\b|po\b|purchase\s+order\b|order\s+id\b|ticket\b|case\b|issue\b|incident\b|"
    r"identifier\b|id\b|uuid\b|serial\b|tracking\b|reference\b|ref\b|applicant\b|application\s+number\b|disbursed\s+amount\b|loan\s+amount\b|e-?mail\b|email\b|phone\b|mobile\b|address\b|postal\b|zip\b)\b"
)
LOOKUP_ASK = r"\b(name|named|id|identifier|uuid|date|owner|lead|manager|contact|applicant|application|loan|disbursed|e-?mail|email|phone|mobile|address|website|homepage|url)\b"
LOOKUP_NEGATIVE = r"\b(recipe|chocolate cake|land on mars|on mars|exact recipe|impossible fact)\b"
WH_START = r"^\s*(who|what|when)\b"
SECTION_PATTERNS = (
    r"\bsection\s*(?:#|number|num\.?)?\s*\d+\b", r"\b(part|chapter|appendix|annex)\s+\d+\b", r"\b(in|under)\s+(appendix|chapter)\b", r"\bwhat\s+.*\b(section|subsection|appendix)\b",
)
SECTION_NUMBER_WORD = r"\b(seven|eight|nine|ten|eleven|twelve|\d+)\b"
# Kinds of field questions, the first that fits.
FIELD_KINDS = (
    ("person_name", r"\b(his|her|their)\s+name\b|\bwhat\s+is\s+(his|her|their)\s+name\b"),
    ("person_name", r"\bwhat\s*(?:'s|is)\s+(?:the\s+)?(?:full\s+)?name\b|\bname\s+on\s+(?:file|record)\b"),
    ("person_name", r"\b(applicant|subject|borrower|customer|account holder|full|legal)\b.*\bname\b|\bapplicant name\b"),
    ("application_number", r"\bapplication\b.*\b(number|no|#)\b|\bapplication number\b"),
    ("loan_disbursed_amount", r"\b(loan)\b.*\b(amount|disbursed)\b|\bdisbursed amount\b|\bloan amount\b|\bhow much\b.*\bloan\b"),
    ("email", r"\b(e-?mail(\s+address)?|email(\s+address)?|contact\s+e-?mail|contact\s+email)\b"),
    ("phone", r"\b(phone|phone number|mobile|contact number|contact|cell|telephone)\b"),
    ("website", r"\b(website|web\s*page|homepage|\burl\b)\b"),
    ("address", r"\b(current\s+)?address\b|\bstreet address\b|\bmailing address\b|\bcurrent\s+address\b"),
)
METADATA_QUESTION = (
    r"\b(file\s*name|filename|document\s*name|name\s+of\s+(the\s+)?(file|document)|which\s+file|what\s+file|what\s+is\s+the\s+(file|document)|which\s+document(\s+is\s+this)?|what\s+document(\s+is\s+this)?|source\s+file)\b"
)
TIME_SENSITIVE = r"\b(today|latest|news|current|recent|price|stock|market|weather|breaking|who is|who was|when did|20[2-3]\d)\b"
BLENDED_TIME = r"\b(today|latest|news|current|recent|price|stock|market|weather|breaking|who is|who was|when did|2024|2025|2026)\b"
STAFF_OR_TECHNOLOGY = r"\b(technologies|technology\s+stack|projects?\s+mentioned|employees|headcount|workforce)\b"
ABOUT_DOCUMENT = (
    r"\b(what\s+is\s+(this|the|it)\s+.*\s+about|what\s+is\s+this\s+document\s+about|summar(?:y|ise|izing)\s+(?:of\s+)?(?:this|the|my)\s+(?:document|file)\b|(?:give\s+me\s+)?a?\s*summary\s+of\s+(?:this|the|my)\s+(?:document|file)\b|"
    r"summarize\s+this\s+(file|document)|summarize\s+the\s+(file|document)|summarize\s+my\s+(file|document)|what\s+does\s+this\s+(file|document)\s+contain|what\s+is\s+in\s+this\s+(file|document))\b"
)
EXPANSION = r"^\s*(tell\s+me\s+more|continue|details|elaborate|more\s+details|expand|what\s+else|more|further)\s*[!.?]*\s*$"
CONFIRM = r"^\s*(yes|yeah|yep|yup|ok|okay|sure|go\s+on|continue)\s*[!.?]*\s*$"
# Words of numbers up to ten, and what is added to a query for a second look into the library.
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
OVERVIEW_BOOST = "main sections themes introduction conclusion purpose overview key ideas summary"
DISCUSSION_BOOST = "performance latency p99 workload reliability metrics discussion"
SECTION_BOOST = "section heading chapter appendix subsection disaster recovery"
FIELD_BOOST = "Full Name Email Phone Website Contact Address"
CONTACT_QUESTION = r"(details|contact|more\s+info|information|more\s+information|what\s+else|other\s+details)"


def has(c: Column, pattern: str) -> Column:
    """Whether a pattern occurs, without case."""
    return F.coalesce(F.regexp_like(c, F.lit("(?i)" + pattern)), F.lit(False))


def normalize_query(c: Column) -> Column:
    """A query on one line in lower case with known phrases, misspellings and near misses put right; null stays null."""
    q = F.lower(collapse(c))
    q = reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), PHRASES, q)
    q = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), TYPOS, q)
    q = reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), NEAR_MISSES, q)
    return collapse(q)


def is_assistant_identity(q: Column) -> Column:
    """Of a normalised query: asks about the assistant itself."""
    return (F.char_length(q) >= 3) & has(q, ASSISTANT_IDENTITY)


def is_short_concept(q: Column) -> Column:
    """Of a normalised query: a short question for a general concept."""
    return (F.char_length(q) <= 120) & has(q, SHORT_CONCEPT)


def bypasses_documents(q: Column) -> Column:
    return is_assistant_identity(q) | is_short_concept(q)


def expects_documents(q: Column) -> Column:
    """Of a normalised query: should be answered from the library."""
    n = F.char_length(q)
    return (n >= 4) & ~bypasses_documents(q) & (((n <= 160) & has(q, STRUCTURED_FIELD)) | has(q, DOCUMENT_SCOPE))


def is_broad_overview(q: Column) -> Column:
    """Of a normalised query: asks for an overview or summary."""
    n = F.char_length(q)
    return (n >= 4) & (has(q, SUMMARIZE_ALONE) | ((n >= 6) & has(q, BROAD_OVERVIEW)))


def uses_relaxed_gate(q: Column) -> Column:
    """Of a normalised query: broad or vague enough for the looser retrieval gate."""
    vague = has(q, PERFORMANCE_WORDS) & has(q, VAGUE_DISCUSSION)
    return is_broad_overview(q) | ((F.char_length(q) >= 10) & (has(q, COMPANY_QUESTION) | has(q, PROJECT_QUESTION) | has(q, TECHNOLOGY_QUESTION) | vague))


def is_entity_lookup(q: Column) -> Column:
    """Of a normalised query: asks for a named entity, role or identifier."""
    return (F.char_length(q) >= 10) & ~has(q, LOOKUP_NEGATIVE) & (has(q, WH_START) | has(q, LOOKUP_ASK)) & has(q, ENTITY_LOOKUP)


def is_section_navigation(q: Column) -> Column:
    """Of a normalised query: asks for a part of a document by its number or name."""
    parts = reduce(lambda a, p: a | has(q, p), SECTION_PATTERNS[1:], has(q, SECTION_PATTERNS[0]))
    worded = q.contains("section") & has(q, SECTION_NUMBER_WORD)
    return (F.char_length(q) >= 12) & (parts | worded | (q.contains("disaster") & q.contains("recover")))


def field_kind(q: Column) -> Column:
    """Of a normalised query: the kind of field asked for, or null."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(FIELD_KINDS):
        out = F.when(has(q, pattern), F.lit(kind)).otherwise(out)
    return out


def skips_rewrite(q: Column) -> Column:
    """Of a normalised query: short or like keywords, so that rewriting it gains nothing."""
    n, words = F.char_length(q), F.size(F.split(q, " "))
    explains = has(q, r"\b(why|how|explain|compare|summarize|difference)\b")
    return (n < 8) | ((n <= 52) & (words <= 6)) | ((n <= 80) & ~q.contains("?") & (words <= 12)) | ((n <= 36) & ~explains)


def takes_fast_path(q: Column) -> Column:
    """Of a normalised query: short and not about documents."""
    return F.char_length(q).between(4, 220) & ~expects_documents(q)


def asks_for_file(q: Column) -> Column:
    """Of a normalised query: asks for the name of the file."""
    return has(q, METADATA_QUESTION)


def asks_about_document(q: Column) -> Column:
    """Of a query: asks what the document is about."""
    return has(q, ABOUT_DOCUMENT)


def asks_for_contact(q: Column) -> Column:
    """Of a query: asks for contact details or more information."""
    return has(q, CONTACT_QUESTION)


def expands(q: Column) -> Column:
    """Of a query: asks for more of the last answer."""
    return has(q, EXPANSION)


def confirms(q: Column) -> Column:
    """Of a query: a mere yes or go on."""
    return has(q, CONFIRM)


def wants_blended_web(q: Column) -> Column:
    """Of a query: recent or outside facts may be needed beside the library's."""
    return ~is_entity_lookup(q) & ~has(q, STAFF_OR_TECHNOLOGY) & has(q, BLENDED_TIME)


def section_number(q: Column) -> Column:
    """The number of the section that a normalised query names, in digits or as a word up to ten; null without one."""
    digits = F.nullif(F.regexp_extract(q, r"section\s*(?:#|number|num\.?)?\s*(\d+)\b", 1), F.lit(""))
    words = reduce(lambda out, n: F.when(has(q, rf"\b{NUMBER_WORDS[n]}\b"), F.lit(str(n + 1))).otherwise(out), reversed(range(len(NUMBER_WORDS))), F.lit(None).cast("string"))
    return F.coalesce(digits, F.when(q.contains("section"), words))


def field_query(q: Column) -> Column:
    """The retrieval query of a normalised query: where it asks for a field, with the names of fields."""
    return F.when(field_kind(q).isNotNull(), F.concat(q, F.lit(" " + FIELD_BOOST))).otherwise(q)


def wider_query(q: Column) -> Column:
    """The second retrieval query of a normalised query that is broad, vague or asks for a section; null for others."""
    broad, relaxed, section = is_broad_overview(q), uses_relaxed_gate(q), is_section_navigation(q)
    more = F.concat_ws(" ", field_query(q), F.lit(OVERVIEW_BOOST), F.when(relaxed & ~broad, F.lit(DISCUSSION_BOOST)), F.when(section & ~broad, F.lit(SECTION_BOOST)))
    return F.when(relaxed | section, more)


ROUTING = {
    "asks_for_file": asks_for_file, "asks_about_document": asks_about_document, "asks_for_contact": asks_for_contact, "expands": expands, "confirms": confirms, "wants_blended_web": wants_blended_web,
}
INTENTS = {
    "assistant_identity": is_assistant_identity, "short_concept": is_short_concept, "expects_documents": expects_documents, "broad_overview": is_broad_overview, "relaxed_gate": uses_relaxed_gate,
    "entity_lookup": is_entity_lookup, "section_navigation": is_section_navigation, "skips_rewrite": skips_rewrite, "fast_path": takes_fast_path,
}
