"""SQL of the labelled fields, contact bundles and overviews."""

from __future__ import annotations

from ..operators import extract as E
from .retrieval_queries import HITS
from .text_queries import SEGMENTS, collapse_sql, lit

BLANK = "' ' || chr(9) || chr(10) || chr(13)"


def _labelled(kind: str) -> str:
    """The raw value of a field on ``line``, its label's next line being ``f[1]``. DuckDB's word edge knows ASCII letters
    only, so the one behind a name is written out."""
    edge = lambda p: p[: -len(r"\b")] + r"(?:[^\pL\pN_]|$)" if kind == "person_name" else p
    when = " ".join(f"WHEN regexp_matches(line, {lit(edge(p))}, 'i') THEN trim(regexp_extract(line, {lit(edge(p))}, {g}, 'i'))" for p, g in E.FIELDS[kind])
    if kind in E.LABEL_ALONE:
        when += f" WHEN regexp_matches(line, {lit(E.LABEL_ALONE[kind])}, 'i') AND regexp_matches(trim(coalesce(f[1], '')), {lit(E.VALUE_ALONE[kind])}) THEN trim(f[1])"
    return f"CASE {when} END"


def _fields() -> str:
    raw = ", ".join(f"{_labelled(k)} AS r_{k}" for k in E.FIELDS)
    names = ", ".join(lit(w) for w in ("or", "and", "number", "application", "loan", "amount", "date", "id", "no", "ref"))
    words = "list_transform(regexp_split_to_array(lower(r_person_name), '\\s+'), lambda w: trim(w, '.'))"
    goes = lambda i: f"(f[{i}] IS NOT NULL AND trim(f[{i}]) <> '' AND NOT regexp_matches(trim(f[{i}]), '^[A-Za-z][A-Za-z0-9 /]{{0,42}}:\\s*\\S'))"
    places = ("street", "st.", "road", "rd.", "avenue", "ave", "lane", "drive", "blvd", "suite", "unit", "apt", "city", "state", "zip", "pin", "country", "p.o", "po box")
    shaped = " OR ".join(f"contains(lower(v_address), {lit(w)})" for w in places)
    plain = [k for k in E.FIELDS if k not in ("phone", "person_name", "address")]
    values = ", ".join(
        [f"{{'kind': {lit(k)}, 'value': nullif(r_{k}, '')}}" for k in plain]
        + [f"{{'kind': 'phone', 'value': CASE WHEN length(regexp_replace(v_phone, '[^0-9]', '', 'g')) >= 10 THEN v_phone END}}", f"{{'kind': 'person_name', 'value': CASE WHEN len(list_intersect({words}, [{names}])) = 0 OR len({words}) < 2 THEN r_person_name END}}"]
        + [f"{{'kind': 'address', 'value': CASE WHEN length(v_address) BETWEEN 8 AND 260 AND (regexp_matches(v_address, '\\d') OR {shaped}) THEN v_address END}}"]
    )
    return (
        f"{SEGMENTS}, ln AS (SELECT source_name, document_id, regexp_split_to_array(trim(text, {BLANK}), '\\r\\n|\\n|\\r') AS a FROM seg), lx AS (SELECT source_name, document_id, unnest(range(1, len(a) + 1)) AS n, a FROM ln), ly AS (SELECT source_name, document_id, n, a[n] AS line, a[n + 1:n + 4] AS f FROM lx), "
        f"fr AS (SELECT *, {raw} FROM ly WHERE regexp_matches(line, '(name|holder|application|amount|mail|contact|phone|mobile|cell|tel|web|url|homepage|address)', 'i')), "
        f"f1 AS (SELECT *, {goes(1)} AND length(r_address) < 240 AS g1 FROM fr), f2 AS (SELECT *, CASE WHEN g1 THEN r_address || ' ' || trim(f[1]) ELSE r_address END AS t1 FROM f1), f3 AS (SELECT *, g1 AND {goes(2)} AND length(t1) < 240 AS g2 FROM f2), "
        f"f4 AS (SELECT *, CASE WHEN g2 THEN t1 || ' ' || trim(f[2]) ELSE t1 END AS t2 FROM f3), f5 AS (SELECT *, g2 AND {goes(3)} AND length(t2) < 240 AS g3 FROM f4), f6 AS (SELECT *, {collapse_sql("CASE WHEN g3 THEN t2 || ' ' || trim(f[3]) ELSE t2 END")} AS v_address, {collapse_sql('r_phone')} AS v_phone FROM f5), "
        f"fe AS (SELECT source_name, document_id, n, unnest([{values}]) AS x FROM f6), fields AS (SELECT source_name, x.kind AS kind, x.value AS value, document_id FROM fe WHERE x.value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_name, x.kind ORDER BY document_id, n, x.value) = 1)"
    )


FIELDS_SQL = f"WITH {_fields()} SELECT * FROM fields"
_PART = lambda k, label: f"'**{label}**: ' || max(value) FILTER (kind = '{k}')"
BUNDLE_SQL = (
    f"WITH {_fields()} SELECT source_name, count(*) AS fields, 'Here is the contact information from the document:' || chr(10) || concat_ws(chr(10), {_PART('email', 'Email')}, {_PART('phone', 'Phone')}, {_PART('website', 'Website')}, {_PART('address', 'Address')}) AS answer "
    "FROM fields WHERE kind IN ('email', 'phone', 'website', 'address') GROUP BY 1 HAVING count(*) >= 2"
)


def _overview() -> str:
    parts = f"list_transform(string_split(regexp_replace({collapse_sql('blob')}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda p: trim(p))"
    prose = f"(list_filter({parts}, lambda p: length(p) BETWEEN 48 AND 560 AND NOT (regexp_matches(p, '^[A-Za-z0-9_\\s\\-]{{2,52}}:\\s*\\S+$') AND length(p) < 140) AND length(p) - length(replace(p, ':', '')) <= 2))[1:3]"
    themes = f"list_filter([{', '.join(f'CASE WHEN contains(lower(blob), {lit(a)}) THEN {lit(b)} END' for a, b in E.THEMES)}], lambda x: x IS NOT NULL)"
    return (
        f"WITH {HITS}, c AS (SELECT query_id, trim(source_name) AS s, count(*) AS n, min(rank) AS first FROM h WHERE coalesce(trim(source_name), '') <> '' GROUP BY ALL), d AS (SELECT *, n / sum(n) OVER (PARTITION BY query_id) AS share, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first, s) AS r FROM c), "
        "b AS (SELECT query_id, s, coalesce(string_agg(page_content, chr(10) ORDER BY rank, page_content), '') AS blob FROM h JOIN d USING (query_id) WHERE r = 1 AND (n >= 3 OR share >= 0.6) AND trim(source_name) = s GROUP BY ALL), "
        f"p AS (SELECT query_id, s, {prose} AS sents, {themes} AS a FROM b), q AS (SELECT query_id, s, sents, (list_filter(a, lambda x, i: list_position(a, x) = i))[1:6] AS t FROM p), "
        "o AS (SELECT query_id, s AS source_name, CASE WHEN len(sents) >= 2 THEN array_to_string(sents, ' ') WHEN len(t) >= 2 OR (len(t) = 1 AND len(sents) = 0) THEN 'It provides an overview of ' || CASE WHEN len(t) = 1 THEN t[1] WHEN len(t) = 2 THEN t[1] || ' and ' || t[2] ELSE array_to_string(t[1:len(t) - 1], ', ') || ', and ' || t[len(t)] END || '.' END AS answer FROM q) "
        "SELECT * FROM o WHERE answer IS NOT NULL"
    )


OVERVIEW_SQL = _overview()
