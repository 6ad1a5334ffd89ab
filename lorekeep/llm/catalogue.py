"""The problems' queries by name, and SQL where it can say the same over whole tables."""

from __future__ import annotations

from lorekeep.llm import queries as q

QUERIES = {
    name: getattr(q, name)
    for name in (
        "p1_found", "p1_pieces",
        "p2_found", "p2_pairs",
        "p3_found", "p3_neighbors",
        "p4_found", "p4_terms",
        "p5_found",
        "p6_found", "p6_sequences", "p6_pages", "p6_chunks",
        "p7_ids",
        "p8_containers",
        "p9_found", "p9_languages",
    )
}

_WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _collapse(x: str) -> str:
    return f"regexp_replace({x}, '{_WS}+', ' ', 'g')"


def _concept(x: str) -> str:
    s = f"regexp_replace({_collapse(f'lower({_trim(x)})')}, '\\([^)]*\\)', ' ', 'g')"
    s = _trim(_collapse(f"regexp_replace({s}, '[''’´`]', '''', 'g')"))
    return _trim(f"regexp_replace({s}, '\\.$', '')")


def _current(name: str, keys: str) -> str:
    return (
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ingested_at DESC) AS version "
        f"FROM {name}) WHERE version = 1"
    )


_LISTS = "list_concat(coalesce(concepts, []), coalesce(refs, []))"
_ALL_LISTS = f"list_concat({_LISTS}, coalesce(defines, []))"

_PAIRS = f"""
WITH cur AS ({_current("sections", "section_id")}),
occ AS (SELECT section_id, unnest({_LISTS}) AS c FROM cur),
held AS (SELECT DISTINCT section_id, {_concept("c")} AS item FROM occ),
items AS (SELECT * FROM held WHERE item <> ''),
n AS (SELECT item, count(*) AS n FROM items GROUP BY item),
pairs AS (
  SELECT a.item AS concept_a, b.item AS concept_b, count(*) AS n_ab
  FROM items a JOIN items b ON a.section_id = b.section_id AND a.item < b.item GROUP BY 1, 2
),
total AS (SELECT count(*) AS n_all FROM cur),
found AS (
  SELECT concept_a, concept_b, n_ab, na.n AS n_a, nb.n AS n_b, n_ab * n_all / (na.n::DOUBLE * nb.n) AS lift
  FROM pairs JOIN n na ON na.item = concept_a JOIN n nb ON nb.item = concept_b CROSS JOIN total
  WHERE n_ab >= 12 AND n_ab * n_all >= 8.0 * na.n * nb.n
)
"""

_TERMS = f"""
WITH cur AS ({_current("sections", "section_id")}),
occ AS (SELECT section_id, unnest({_ALL_LISTS}) AS c FROM cur),
held AS (SELECT section_id, {_concept("c")} AS concept FROM occ),
total AS (SELECT count(*) AS n_all FROM cur),
terms AS (
  SELECT concept, count(*) AS occurrences, count(DISTINCT section_id) AS sections FROM held WHERE concept <> '' GROUP BY concept
),
found AS (
  SELECT concept, occurrences, sections,
    CASE WHEN sections < 3 THEN 'rare' WHEN sections > 0.2 * n_all THEN 'common' END AS mark
  FROM terms CROSS JOIN total
)
"""

_LINE = r"[\n\r\x0B\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_SPACE = r"[\t\n\x0B\f\r \x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_CLOSERS = r"[\p{Pe}\p{Pf}\p{Pi}\"''`´＂＇“„]*"
_MARK = ""


def _stretches(x: str) -> str:
    s = f"regexp_replace({x}, '([.!?…]{_CLOSERS})({_SPACE})', '\\1{_MARK}\\2', 'g')"
    s = f"regexp_replace({s}, '(\\r\\n|{_LINE})', '\\1{_MARK}', 'g')"
    s = f"regexp_replace({s}, '([。！？])', '\\1{_MARK}', 'g')"
    return f"list_max(list_transform(string_split({s}, '{_MARK}'), lambda part: length(part)))"


_LONG = f"""
WITH items AS (
  SELECT 'page' AS item_kind, doc_id || '/' || page_number AS item_id, content AS item
  FROM ({_current("pages", "doc_id, page_number")})
  UNION ALL
  SELECT 'chunk', chunk_id,
    CASE WHEN coalesce({_trim("section_heading")}, '') = '' THEN coalesce(text, '')
      ELSE {_trim("section_heading")} || chr(10) || chr(10) || coalesce(text, '') END
  FROM ({_current("chunks", "chunk_id")})
)
SELECT item_kind, item_id, CASE WHEN {_stretches("item")} <= 2000 THEN 'natural' ELSE 'forced' END AS cut
FROM items WHERE length(item) > 2000
"""


def _mutual(name: str, key: str) -> str:
    return f"""
  SELECT a.id AS id_a, a.other AS id_b FROM ranked_{name} a JOIN ranked_{name} b ON a.id = b.other AND a.other = b.id
  WHERE a.id < a.other AND a.cosine >= 0.9"""


def _ranked(name: str, key: str) -> str:
    return f"""
usable_{name} AS (
  SELECT {key} AS id, embedding::DOUBLE[64] AS v FROM ({_current(name, key)})
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
ranked_{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) AS place FROM (
      SELECT a.id, b.id AS other, array_cosine_similarity(a.v, b.v) AS cosine
      FROM usable_{name} a JOIN usable_{name} b ON a.id <> b.id
    ) WHERE cosine >= 0.9
  ) WHERE place <= 10
)"""


_FURNITURE = f"""
WITH cur AS ({_current("pages", "doc_id, page_number")}),
lines AS (
  SELECT doc_id, page_number, line_no, regexp_replace(lower(line), '[^\\p{{L}}]+', '', 'g') AS key FROM (
    SELECT doc_id, page_number, unnest(range(len(parts))) AS line_no, unnest(parts) AS line
    FROM (SELECT doc_id, page_number, string_split(content, chr(10)) AS parts FROM cur)
  )
),
keyed AS (SELECT * FROM lines WHERE key <> ''),
counts AS (SELECT doc_id, key, count(DISTINCT page_number) AS n FROM keyed GROUP BY 1, 2),
members AS (
  SELECT a.doc_id, a.key AS line, b.key FROM counts a JOIN counts b ON a.doc_id = b.doc_id AND (
    a.key = b.key OR (length(a.key) BETWEEN length(b.key) - 1 AND length(b.key) + 1
      AND b.n <= a.n AND levenshtein(a.key, b.key) <= 1))
  WHERE a.n > 1
),
need AS (SELECT doc_id, greatest(5, ceil(count(*) * 0.15 - 1e-9)) AS need FROM cur GROUP BY 1),
frequent AS (
  SELECT doc_id, line FROM members JOIN keyed USING (doc_id, key) JOIN need USING (doc_id)
  GROUP BY doc_id, line, need HAVING count(DISTINCT page_number) >= need
), gone AS (
  SELECT doc_id, page_number, line_no::INT AS line_no FROM keyed
  WHERE (doc_id, key) IN (SELECT doc_id, key FROM members JOIN frequent USING (doc_id, line))
)
"""

ORACLE_SQL = {
    "p1_found": _LONG,
    "p2_found": f"{_PAIRS} SELECT concept_a, concept_b FROM found",
    "p2_pairs": f"{_PAIRS} SELECT concept_a, concept_b, n_ab, n_a, n_b, round(lift, 6) AS lift, round(ln(lift), 6) AS pmi FROM found",
    "p3_found": f"WITH {_ranked('chunks', 'chunk_id')}, {_ranked('sections', 'section_id')} "
    f"{_mutual('chunks', 'chunk_id')} UNION ALL {_mutual('sections', 'section_id')}",
    "p4_found": f"{_TERMS} SELECT concept, mark FROM found WHERE mark IS NOT NULL",
    "p4_terms": f"{_TERMS} SELECT * FROM found",
    "p6_found": f"{_FURNITURE} SELECT * FROM gone",
    "p6_pages": f"""{_FURNITURE}, nos AS (SELECT doc_id, page_number, list(line_no) AS nos FROM gone GROUP BY 1, 2)
SELECT doc_id, page_number, CASE WHEN nos IS NULL THEN content
  ELSE array_to_string(list_filter(string_split(content, chr(10)), lambda x, i: NOT list_contains(nos, i - 1)), chr(10)) END AS content
FROM cur LEFT JOIN nos USING (doc_id, page_number)""",
}
