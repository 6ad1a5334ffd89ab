"""SQL (DuckDB) for the queries of ``queries.py``."""

from __future__ import annotations

# fixed values: words that say nothing about a question
QUESTION_STOP = (
    "does do did what when where which that this with from have has your you the and but for not can how why its our are "
    "was were been being into than then them they their about also any book rule rules game please"
).split()
# fixed values: words that say nothing about an answer
ANSWER_STOP = (
    "that this with from your have has will when what there they them must gain rule rules book text states state "
    "relevant excerpt excerpts provided answer question does any also into about such than then usually"
).split()
# fixed values: phrases of rules on several instances of an effect, and their weights
RULE_PHRASES = {
    "multiple afflictions": 0.12,
    "no additional effect": 0.15,
    "gain an affliction you already have": 0.16,
    "each instance of the affliction": 0.10,
    "remove each instance": 0.10,
}
# fixed values: terms added to a question about stacking
STACKING_TERMS = "multiple affliction afflictions additional already".split()
# fixed values: small words inside headings, topics that are no index entries
JOIN_WORDS = "a an the of and in on at to for or as by".split()
SKIP_TOPICS = [
    "index", "contents", "table of contents", "introduction", "appendix", "appendices", "references", "bibliography",
    "glossary",
]
# fixed values: patterns of answers and summaries
_INVENTED = r"(?i)\b(typically|here''s how|it works|stacks with)\b"
_DEFINITE = r"(?i)\b(does not|do not|never stacks|always|cannot|can''t|rules state|according to the excerpts)\b"
_DENIES = r"(?i)\b(does\s+not\s+stack|don''t\s+stack|never\s+stacks)\b"
_AFFIRMS = r"(?i)\b(stack|stacks|each\s+instance|instances?\s+of)\b"
_DENIES_TOO = r"(?i)\b(does\s+not\s+stack|don''t\s+stack|never\s+stacks|cannot\s+stack)\b"

_WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _collapse(x: str) -> str:
    return f"regexp_replace({x}, '{_WS}+', ' ', 'g')"


def _concept(x: str) -> str:
    s = f"regexp_replace({_collapse(f'lower({_trim(x)})')}, '\\([^)]*\\)', ' ', 'g')"
    s = _trim(_collapse(f"regexp_replace({s}, '[''’´`]', '''', 'g')"))
    return _trim(f"regexp_replace({s}, '\\.$', '')")


def _current(name: str, keys: str, newest: str = "ingested_at") -> str:
    return (
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {newest} DESC NULLS LAST) AS version "
        f"FROM {name}) WHERE version = 1"
    )


CHUNKS, SECTIONS = _current("chunks", "chunk_id"), _current("sections", "section_id")
PAGES = _current("pages", "doc_id, page_number")
RESULTS = _current("query_results", "result_id", "answered_at")
QUESTIONS = "SELECT DISTINCT ON (question_id) * FROM questions"
_stop = "[" + ", ".join(f"'{w}'" for w in QUESTION_STOP) + "]"
_more = "[" + ", ".join(f"'{w}'" for w in STACKING_TERMS) + "]"
_STACKING = r"(?i)\b(stack|stacks|stacking|duplicate|duplicates|twice|again|multiple)\b"
_one = "list_transform(regexp_extract_all(lower(question), '[a-z0-9'']+'), lambda w: regexp_replace(w, '^''|''$', '', 'g'))"
_own = f"list_filter({_one}, lambda w: length(w) >= 3 AND NOT list_contains({_stop}, w))"
# every term once, in order of its first place
_TERMS = f"""
SELECT question_id, regexp_matches(question, '{_STACKING}') AS stacking,
  list_filter(all_terms, lambda w, i: list_position(all_terms, w) = i) AS terms
FROM (SELECT *, CASE WHEN regexp_matches(question, '{_STACKING}') THEN list_concat({_own}, {_more}) ELSE {_own} END AS all_terms
  FROM ({{questions}}))
"""

_SURFACE = f"""CASE WHEN coalesce({_trim("section_heading")}, '') = '' THEN coalesce(text, '')
  ELSE {_trim("section_heading")} || chr(10) || chr(10) || coalesce(text, '') END"""

_rules = " + ".join(
    f"CASE WHEN regexp_matches(body, '(?i)\\b{p}\\b') THEN {w} ELSE 0 END" for p, w in RULE_PHRASES.items()
)
_LEX = f"""
WITH corpus AS (SELECT corpus_pos, chunk_id, doc_id, chunk_index, page_start, page_end, {_SURFACE} AS body FROM ({CHUNKS})),
asked AS ({_TERMS.format(questions="SELECT * FROM (" + QUESTIONS + ") WHERE question_id % @EVERY = 0")}),
t AS (SELECT question_id, len(terms) AS n_terms, unnest(terms) AS term FROM asked),
counted AS (
  SELECT question_id, corpus_pos, n_terms, term,
    len(regexp_extract_all(lower(body), '(^|[^a-z0-9_])' || term || '\\b')) AS hits
  FROM t, corpus WHERE contains(lower(body), term)
),
base AS (
  SELECT question_id, corpus_pos, count(*) FILTER (hits > 0) / max(n_terms) AS ratio, sum(hits) AS hits FROM counted GROUP BY 1, 2
),
ruled AS (
  SELECT question_id, corpus_pos, least(weight, 0.38) AS rule FROM (SELECT corpus_pos, {_rules} AS weight FROM corpus), asked
  WHERE weight > 0 AND stacking
),
glossary AS (
  SELECT question_id, corpus_pos, least(count(*) * 0.14, 0.22) AS glossary FROM t, corpus
  WHERE length(term) >= 6 AND contains(lower(body), term)
    AND regexp_matches(lower(body), '\\b' || term || '\\s+an?\\s+' || term || '\\b') GROUP BY 1, 2
),
scored AS (
  SELECT question_id, corpus_pos, coalesce(ratio, 0) AS ratio, coalesce(hits, 0) AS hits,
    coalesce(rule, 0) + coalesce(glossary, 0) AS boost
  FROM base FULL JOIN ruled USING (question_id, corpus_pos) LEFT JOIN glossary USING (question_id, corpus_pos)
),
lexical AS (
  SELECT *, 2 * ratio + least(hits * 0.04, 0.45) + boost AS lex FROM scored
  WHERE 2 * ratio + least(hits * 0.04, 0.45) + boost > 0
),
lane AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(lex, 9) DESC, corpus_pos) AS rank FROM lexical)
  WHERE rank <= 24
)
"""

_DENSE = f"""
vectors AS (
  SELECT corpus_pos, embedding::DOUBLE[] AS v FROM ({CHUNKS}) WHERE embedding IS NOT NULL
),
qs AS (SELECT question_id, query_vec::DOUBLE[] AS q FROM ({QUESTIONS}) WHERE question_id % @EVERY = 0 AND query_vec IS NOT NULL),
cosines AS (
  SELECT question_id, corpus_pos, CASE WHEN isfinite(c) THEN c ELSE 0 END AS dense FROM (
    SELECT question_id, corpus_pos, CASE WHEN len(v) = 0 THEN 0 ELSE coalesce(
      list_cosine_similarity(q[1:least(len(q), len(v))], v[1:least(len(q), len(v))]), 0) END AS c FROM qs, vectors)
),
dense_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(dense, 9) DESC, corpus_pos) AS rank FROM cosines
)
"""

def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_ENTRY = r"'^(.+?)\s+(\d{1,4}(?:\s*,\s*\d{1,4})*)\s*$'"
_INDEX = rf"""
index_pages AS (SELECT doc_id, page_number, content FROM ({PAGES})),
tail AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number DESC) AS r,
    count(*) OVER (PARTITION BY doc_id) AS n FROM index_pages)
  WHERE r <= least(greatest(14, floor(n * 0.22)), 95)
),
begun AS (
  SELECT *, min(page_number) FILTER (regexp_matches(content, '(?im)^[ \t]*(#{{1,6}}\s+)?index[ \t\r]*$')) OVER (PARTITION BY doc_id) AS first
  FROM tail
),
index_text AS (
  SELECT doc_id, page_number, first, CASE WHEN len(a) >= 5 THEN a ELSE b END AS lines FROM (
    SELECT *, list_filter(list_transform(regexp_split_to_array(content, '\r?\n'), lambda x: {_trim("x")}), lambda x: x <> '') AS a,
      list_filter(list_transform(regexp_split_to_array(content, '\s{{2,}}'), lambda x: {_trim("x")}), lambda x: x <> '') AS b
    FROM begun WHERE first IS NULL OR page_number >= first)
),
index_lines AS (
  SELECT doc_id, page_number, first, line_at, {_trim(_collapse("regexp_replace(line, '[.]{3,}|…+', ' ', 'g')"))} AS s
  FROM (SELECT doc_id, page_number, first, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_at FROM index_text)
),
index_parts AS (
  SELECT *, {_trim("regexp_replace(" + _trim(f"regexp_extract(s, {_ENTRY}, 1)") + ", '[.,;:]+$', '')")} AS topic,
    list_filter(list_transform(regexp_split_to_array(regexp_extract(s, {_ENTRY}, 2), '\s*,\s*'), lambda x: TRY_CAST(x AS INT)), lambda x: x > 0 AND x < 5000) AS pages
  FROM index_lines WHERE length(s) >= 4 AND NOT regexp_matches(s, '(?i)^see\b') AND NOT regexp_matches(s, '^\d+[.,]\s')
    AND regexp_matches(s, {_ENTRY})
),
index_found AS (
  SELECT *, {_trim(_collapse("lower(topic)"))} AS topic_norm FROM index_parts
  WHERE length(topic) BETWEEN 2 AND 160 AND NOT regexp_matches(topic, '^\d+$') AND NOT list_contains({_list(SKIP_TOPICS)}, lower(topic))
    AND len(string_split(topic, ' ')) <= 16 AND len(pages) > 0
),
index_merged AS (
  SELECT doc_id, topic_norm, arg_min(topic, (page_number, line_at)) AS topic, list_sort(list_distinct(flatten(list(pages)))) AS pages, max(first) AS first
  FROM index_found WHERE topic_norm <> '' GROUP BY 1, 2
),
hints AS (
  SELECT doc_id, topic, topic_norm, pages FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k FROM index_merged)
  WHERE k >= CASE WHEN first IS NOT NULL THEN 6 ELSE 22 END
)
"""
_HINTED = """
hinted AS (
  SELECT DISTINCT question_id, doc_id, unnest(pages) AS page FROM hint_terms JOIN hints
  ON length(term) >= 2 AND (topic_norm = term OR starts_with(topic_norm, term || ' '))
)
"""

_phrase_words = (
    f"list_filter(list_transform(regexp_extract_all(lower({_trim('question')}), '[a-z0-9'']+'), lambda w: "
    f"regexp_replace(w, '^''+|''+$', '', 'g')), lambda w: length(w) >= 4 AND NOT list_contains({_stop}, w))"
)


def _grams(n: int) -> str:
    joined = _concept(f"array_to_string(ws[i:i + {n - 1}], ' ')")
    return f"list_filter(list_transform(range(1, len(ws) - {n} + 2), lambda i: {joined}), lambda p: length(p) >= 5)"


def _phrases(step: str) -> str:
    """question_id, phrases: in order, each once, the first 64."""
    return f"""
phrase_terms AS ({_TERMS.format(questions=f"SELECT * FROM ({QUESTIONS}) WHERE question_id % {step} = 0")}),
phrase_words AS (SELECT question_id, {_phrase_words} AS ws FROM ({QUESTIONS}) WHERE question_id % {step} = 0),
phrase_lists AS (
  SELECT question_id, list_concat(list_filter(list_transform(terms, lambda t: {_concept("t")}), lambda t: length(t) >= 3), list_concat({_grams(2)}, {_grams(3)})) AS every
  FROM phrase_terms JOIN phrase_words USING (question_id)
),
phrases AS (SELECT question_id, list_filter(every, lambda w, i: list_position(every, w) = i)[1:64] AS phrases FROM phrase_lists)
"""


_DEFINES = f"""
define_keys AS (
  SELECT define, chunk_ids FROM (SELECT {_concept("c")} AS define, chunk_ids FROM (SELECT unnest(defines) AS c, chunk_ids FROM ({SECTIONS})))
  WHERE length(define) >= 3
),
define_distinct AS (SELECT DISTINCT define FROM define_keys),
define_pairs AS (
  SELECT question_id, phrase, define FROM (SELECT question_id, unnest(phrases) AS phrase FROM phrases) q JOIN define_distinct ON
    define = phrase
    OR (length(phrase) >= 5 AND contains(define, phrase)) OR (length(define) >= 5 AND contains(phrase, define))
    OR (length(phrase) >= 4 AND (starts_with(define, phrase || ' ') OR ends_with(define, ' ' || phrase)))
    OR (length(define) >= 4 AND (starts_with(phrase, define || ' ') OR ends_with(phrase, ' ' || define)))
),
define_chunks AS (SELECT DISTINCT define, chunk_id FROM (SELECT define, unnest(chunk_ids) AS chunk_id FROM define_keys))
"""

_HELD = {
    c: f"SELECT DISTINCT section_id, concept FROM (SELECT section_id, {_concept('c')} AS concept FROM (SELECT section_id, unnest({c}) AS c FROM ({SECTIONS}))) WHERE concept <> ''"
    for c in ("refs", "defines")
}
_EDGES = f"""
held_refs AS ({_HELD["refs"]}), held_defs AS ({_HELD["defines"]}),
also AS (
  SELECT DISTINCT doc_id, src, own, hint FROM (SELECT doc_id, section_id AS src, {_concept('title')} AS own, {_concept('x')} AS hint
  FROM (SELECT doc_id, section_id, title, unnest(see_also) AS x FROM ({SECTIONS}))) WHERE hint <> '' AND hint <> own
),
titled AS (SELECT doc_id, section_id AS dst, {_concept('title')} AS title FROM ({SECTIONS})),
links AS (
  SELECT r.section_id AS a, d.section_id AS b, 0.85 AS weight FROM held_refs r JOIN held_defs d USING (concept) WHERE a <> b
  UNION ALL SELECT src, dst, 0.5 FROM also JOIN titled USING (doc_id) WHERE src <> dst AND (contains(title, hint) OR contains(hint, title))
),
peers AS (
  SELECT section_id, peer, max(weight) AS weight FROM (SELECT a AS section_id, b AS peer, weight FROM links UNION ALL SELECT b, a, weight FROM links) GROUP BY 1, 2
),
peers_ranked AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY weight DESC, peer) AS r FROM peers),
members AS (SELECT section_id, section_index, unnest(chunk_ids) AS chunk_id FROM ({SECTIONS})),
section_of AS (SELECT chunk_id, arg_max(section_id, (section_index, section_id)) AS section_id FROM members GROUP BY 1),
seed_hits AS (
  SELECT question_id, section_id, count(*) AS n FROM dense_ranked JOIN (SELECT corpus_pos, chunk_id FROM ({CHUNKS})) USING (corpus_pos) JOIN section_of USING (chunk_id)
  WHERE rank <= 24 GROUP BY 1, 2
),
reached AS (SELECT question_id, peer AS section_id, max(weight) AS weight FROM seed_hits JOIN peers_ranked USING (section_id) WHERE r <= 3 * n GROUP BY 1, 2),
graph_found AS (SELECT question_id, chunk_id, (max(weight) * 0.1)::DOUBLE AS boost FROM reached JOIN members USING (section_id) GROUP BY 1, 2)
"""
_DOC_VECTORS = f"""
section_cells AS (
  SELECT doc_id, i, avg(embedding[i]::DOUBLE) AS x FROM (
    SELECT doc_id, embedding, unnest(range(1, 65)) AS i FROM ({SECTIONS})
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0) GROUP BY 1, 2
),
doc_vectors AS (SELECT doc_id, list(x ORDER BY i) AS v FROM section_cells GROUP BY 1),
routed AS (
  SELECT question_id, doc_id, CASE WHEN isfinite(c) THEN c ELSE 0 END AS c FROM (SELECT question_id, doc_id, coalesce(list_cosine_similarity(q, v), 0) AS c FROM qs, doc_vectors)
),
router AS (SELECT question_id, doc_id, c / greatest(max(c) OVER (PARTITION BY question_id), 1e-12) * 0.1 AS boost FROM routed)
"""


def _fused(lanes: str, added: str) -> str:
    return f"""
pool AS (
  SELECT question_id, corpus_pos, min((lane_no, rank)) AS o FROM (
    SELECT question_id, corpus_pos, 0 AS lane_no, rank FROM dense_ranked WHERE rank <= 96
    UNION ALL SELECT question_id, corpus_pos, 1, rank FROM lane {lanes}) GROUP BY 1, 2
),
pooled AS (SELECT * FROM pool JOIN corpus USING (corpus_pos)),
hint_terms AS (SELECT question_id, term FROM t),
{_HINTED},
hint_added AS (
  SELECT DISTINCT question_id, corpus_pos, 0.07::DOUBLE AS boost FROM pooled JOIN hinted USING (question_id, doc_id) WHERE page BETWEEN page_start AND page_end
),
added AS (SELECT question_id, corpus_pos, sum(boost) AS added FROM (SELECT * FROM hint_added {added}) GROUP BY 1, 2),
fused AS (
  SELECT question_id, corpus_pos, o, coalesce(dense, 0) + 0.2 * coalesce(ratio, 0) + coalesce(boost, 0) + coalesce(added, 0) AS score
  FROM pool LEFT JOIN cosines USING (question_id, corpus_pos) LEFT JOIN lexical USING (question_id, corpus_pos) LEFT JOIN added USING (question_id, corpus_pos)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, o, corpus_pos) AS rank FROM fused
),
capped AS (
  SELECT *, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY rank) > 2 AS over
  FROM placed JOIN corpus USING (corpus_pos)
),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY over, rank) AS pick FROM capped) WHERE pick <= 10)
"""


_HYBRID = f"{_LEX}, {_DENSE}, {_INDEX}, {_fused('', '')}"
_ALL_LANES = f"""{_LEX}, {_DENSE}, {_INDEX}, {_EDGES}, {_DOC_VECTORS}, {_phrases("@EVERY")}, {_DEFINES},
graph_lane AS (SELECT question_id, corpus_pos, boost, row_number() OVER (PARTITION BY question_id ORDER BY corpus_pos) AS rank FROM graph_found JOIN corpus USING (chunk_id)),
define_hits AS (
  SELECT question_id, corpus_pos, count(*) AS hits FROM define_pairs JOIN define_chunks USING (define) JOIN corpus USING (chunk_id) GROUP BY 1, 2
),
define_lane AS (
  SELECT question_id, corpus_pos, (least(hits, 4) * 0.05)::DOUBLE AS boost, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY hits DESC, corpus_pos) AS rank FROM define_hits) WHERE rank <= 12
),
""" + _fused(
    "UNION ALL SELECT question_id, corpus_pos, 2, rank FROM graph_lane UNION ALL SELECT question_id, corpus_pos, 3, rank FROM define_lane",
    "UNION ALL SELECT question_id, corpus_pos, boost FROM graph_lane UNION ALL SELECT question_id, corpus_pos, boost FROM define_lane "
    "UNION ALL SELECT question_id, corpus_pos, boost FROM pooled JOIN router USING (question_id, doc_id)",
)

_EXPANDED = f"""{_HYBRID},
offsets AS (SELECT unnest([0, -1, 1]) AS d, unnest([0, 1, 2]) AS turn),
wanted AS (
  SELECT question_id, doc_id, chunk_index + d AS chunk_index, min((pick, turn)) AS o
  FROM picked JOIN offsets ON d = 0 OR pick <= 3 GROUP BY 1, 2, 3
),
expanded AS (
  SELECT question_id, doc_id, chunk_index, row_number() OVER (PARTITION BY question_id ORDER BY o) AS place
  FROM wanted WHERE (doc_id, chunk_index) IN (SELECT doc_id, chunk_index FROM corpus)
)
"""

_EXCERPTS = f"""{_EXPANDED},
scored_excerpts AS (
  SELECT question_id, corpus_pos, chunk_id, doc_id, page_start, page_end, body, place AS rank, coalesce(lex, 0) AS lex
  FROM expanded JOIN corpus USING (doc_id, chunk_index) LEFT JOIN lexical USING (question_id, corpus_pos)
),
blended AS (
  SELECT *, 0.48 * CASE WHEN high > low THEN (lex - low) / (high - low) ELSE 1 END
    + 0.52 * CASE WHEN n > 1 THEN (n - rank) / (n - 1) ELSE 1 END AS blend
  FROM (SELECT *, min(lex) OVER w AS low, max(lex) OVER w AS high, count(*) OVER w AS n FROM scored_excerpts WINDOW w AS (PARTITION BY question_id))
),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(blend, 9) DESC, rank) AS place,
    '[CHUNK_ID: ' || chunk_id || ']' || chr(10) || body || chr(10) AS excerpt,
    3 * len(list_filter(regexp_split_to_array('[CHUNK_ID: ' || chunk_id || ']' || chr(10) || body || chr(10), '{_WS}+'), lambda w: w <> '')) AS tokens
  FROM blended
),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY question_id ORDER BY place) AS total_tokens FROM ordered),
excerpts AS (SELECT * FROM summed WHERE place = 1 OR total_tokens <= 3800)
"""

_PROVENANCE = f"""{_LEX},
valued AS (SELECT *, 2 * ratio + boost AS value FROM lexical JOIN corpus USING (corpus_pos)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(value, 9) DESC, hits DESC, corpus_pos) AS rank
  FROM valued WHERE hits > 0 OR value > 0
),
capped AS (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY rank) > 2 AS over FROM placed)
SELECT question_id, corpus_pos, round(value, 6) AS value, hits::BIGINT AS hits, pick
FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY over, rank) AS pick FROM capped) WHERE pick <= 5
"""

_TURNS = f"""
turns AS (
  SELECT question_id, turn - 1 AS turn, h.role AS role, h.content AS content FROM (
    SELECT question_id, unnest(history) AS h, generate_subscripts(history, 1) AS turn FROM ({QUESTIONS}))
)
"""
_SAID = "SELECT * FROM turns WHERE role IN ('user', 'assistant') AND content IS NOT NULL"

_CITED = f"""
cited AS (
  SELECT * FROM (
    SELECT result_id, library_id, ord - 1 AS ord,
      {_trim(f"regexp_replace({_trim('c.chunk_id')}, '(?i)^CHUNK_ID\\s*:\\s*', '')")} AS chunk_id
    FROM (SELECT result_id, library_id, unnest(citations) AS c, generate_subscripts(citations, 1) AS ord FROM ({RESULTS}))
  ) WHERE chunk_id <> ''
)
"""

_words = f"list_filter(regexp_split_to_array(text, '{_WS}+'), lambda w: w <> '')"
_any_rule = r"(?i)\b(" + "|".join(RULE_PHRASES) + r")\b"
_INSTANCES = r"(?i)\b(each\s+instance|remove\s+each|instances?\s+of|already\s+have|no\s+additional|same\s+affliction|stack|stacks|stacking)\b"


def _hit(text: str, term: str) -> str:
    return f"regexp_matches(lower({text}), '(^|[^a-z0-9_])' || {term} || '($|[^a-z0-9_])')"


def _hits(text: str, term: str) -> str:
    return rf"len(regexp_extract_all(lower({text}), '(^|[^a-z0-9_])' || {term} || '\b'))"


def _supported(source: str) -> str:
    """CTEs that give ``source`` (result_id, ord, answer, snippet) a support: the best of the answer's clauses."""
    return rf"""
clause_lists AS (
  SELECT result_id, ord, snippet, answer, list_filter(list_transform(
    string_split(regexp_replace(answer, '([.!?]){_WS}+', '\1' || chr(1), 'g'), chr(1)), lambda c: {_trim("c")}), lambda c: length(c) > 28) AS cs FROM {source}
),
clauses AS (SELECT result_id, ord, snippet, unnest(CASE WHEN len(cs) > 0 THEN cs ELSE [answer] END) AS clause FROM clause_lists),
clause_words AS (SELECT *, regexp_extract_all(lower(clause), '[a-z0-9'']+') AS ws FROM clauses),
clause_terms AS (
  SELECT *, list_distinct(list_filter(list_transform(ws, lambda w: regexp_replace(w, '^''+|''+$', '', 'g')), lambda w: length(w) >= 4 AND NOT list_contains({_list(ANSWER_STOP)}, w))) AS ts,
    list_filter(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), lambda p: length(p) >= 8 AND contains(lower(snippet), p)) AS ps
  FROM clause_words
),
clause_scores AS (
  SELECT result_id, ord,
    CASE WHEN len(ts) > 0 THEN 6.0::DOUBLE * len(list_filter(ts, lambda t: {_hit("snippet", "t")})) / len(ts) ELSE 0 END
    + CASE WHEN regexp_matches(clause, '{_any_rule}') AND regexp_matches(snippet, '{_any_rule}') THEN 4 ELSE 0 END
    + least(len(ps) * 1.1::DOUBLE, 4.0::DOUBLE) AS score
  FROM clause_terms
),
supports AS (SELECT result_id, ord, greatest(max(score), 0) AS support FROM clause_scores GROUP BY 1, 2)
"""


def _aligned(source: str) -> str:
    """CTEs that align ``source`` (result_id, ord, chunk_id, question, answer, snippet, terms, stacking)."""
    return f"""{_supported(source)},
align_scored AS (
  SELECT s.*, support, CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda t: {_hit("snippet", "t")})) / len(terms) ELSE 0 END AS lexical,
    count(*) OVER w AS n, max(support) OVER w AS best
  FROM {source} s JOIN supports USING (result_id, ord) WINDOW w AS (PARTITION BY s.result_id)
),
align_first AS (SELECT *, n = 1 OR best < 1.35 OR support >= best * 0.42 AS k1 FROM align_scored),
align_left AS (SELECT *, sum(k1::INT) OVER w AS m, max(CASE WHEN k1 THEN lexical END) OVER w AS top FROM align_first WINDOW w AS (PARTITION BY result_id)),
align_kept AS (
  SELECT *, k1 AND CASE WHEN m > 1 AND NOT stacking AND len(terms) >= 2 AND top >= 0.12 THEN lexical >= top * 0.38 ELSE true END AS kept FROM align_left
),
lined AS (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY kept DESC, round(support, 9) DESC, ord) AS place FROM align_kept)
"""


_QTERMS = f"qterms AS (SELECT question_id, question, terms, stacking FROM ({_TERMS.format(questions=QUESTIONS)}) JOIN ({QUESTIONS}) USING (question_id))"
_BODIES = f"bodies AS (SELECT chunk_id, doc_id, chunk_index, page_start, page_end, {_SURFACE} AS body FROM ({CHUNKS}))"


def _formatted() -> str:
    """CTEs over outputs (result_id, question, terms, stacking, answer, confidence), cited (result_id, ord, chunk_id) and prompt
    (result_id, place, chunk_id, doc_id, page_start, page_end, body)."""
    rules = " + ".join(rf"CASE WHEN regexp_matches(body, '(?i)\b{p}\b') THEN {w} ELSE 0 END" for p, w in RULE_PHRASES.items())
    glossary = r"least(len(list_filter(terms, lambda t: length(t) >= 6 AND regexp_matches(lower(body), '\b' || t || '\s+an?\s+' || t || '\b'))) * 0.14, 0.22)"
    total = f"list_sum(list_transform(terms, lambda t: {_hits('body', 't')}))"
    doc, no = r"'^(.+)#(\d+)$', 1", r"'^(.+)#(\d+)$', 2"
    return rf"""
exact AS (SELECT result_id, ord, c.chunk_id AS wanted, b.chunk_id, b.doc_id, b.page_start, b.page_end, b.body FROM cited c LEFT JOIN bodies b USING (chunk_id)),
missing AS (SELECT result_id, ord, wanted FROM exact WHERE chunk_id IS NULL),
edited AS (
  SELECT DISTINCT m.result_id, wanted, p.chunk_id, place, levenshtein(lower(regexp_extract(wanted, {doc})), lower(regexp_extract(p.chunk_id, {doc}))) AS edits
  FROM missing m JOIN prompt p ON m.result_id = p.result_id AND regexp_extract(wanted, {no}) = regexp_extract(p.chunk_id, {no})
  WHERE regexp_extract(wanted, {no}) <> ''
),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_id, wanted ORDER BY edits, place, chunk_id) AS r FROM edited WHERE edits BETWEEN 1 AND 4) WHERE r = 1),
resolved AS (
  SELECT * FROM exact WHERE chunk_id IS NOT NULL
  UNION ALL SELECT result_id, ord, wanted, chunk_id, doc_id, page_start, page_end, body FROM missing JOIN (SELECT result_id, wanted, chunk_id FROM near) USING (result_id, wanted)
    JOIN (SELECT result_id, chunk_id, doc_id, page_start, page_end, body FROM prompt) USING (result_id, chunk_id)
),
sized AS (SELECT result_id, count(*) AS n_prompt FROM prompt GROUP BY 1),
placed_cites AS (
  SELECT r.*, n_prompt IS NOT NULL AND p.chunk_id IS NULL AS dropped
  FROM resolved r LEFT JOIN sized USING (result_id) LEFT JOIN (SELECT DISTINCT result_id, chunk_id FROM prompt) p ON p.result_id = r.result_id AND p.chunk_id = r.chunk_id
),
held_cites AS (SELECT p.*, coalesce({total}, 0) AS hits FROM placed_cites p JOIN outputs USING (result_id) WHERE NOT dropped),
counts AS (
  SELECT o.*, n_prompt, n, best FROM outputs o LEFT JOIN sized USING (result_id)
  LEFT JOIN (SELECT result_id, count(*) AS n, max(hits) AS best FROM held_cites GROUP BY 1) USING (result_id)
),
need AS (
  SELECT *, CASE WHEN replaces THEN greatest(n, 3) ELSE 5 END AS most FROM (
    SELECT *, coalesce(n > 0 AND n_prompt > 0 AND len(terms) >= 3 AND best = 0, false) AS replaces, n IS NULL AND n_prompt > 0 AS falls
    FROM counts WHERE {_trim("question")} <> '')
  WHERE replaces OR falls
),
source_scores AS (
  SELECT n.result_id, place, chunk_id, doc_id, page_start, page_end, body, replaces, most, coalesce({total}, 0) AS hits,
    2.0 * len(list_filter(terms, lambda t: {_hit("body", "t")})) / len(terms) + CASE WHEN stacking THEN least({rules}, 0.38) ELSE 0 END + {glossary} AS value
  FROM need n JOIN prompt USING (result_id) WHERE len(terms) > 0
),
source_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY round(value, 9) DESC, hits DESC, place) AS rank FROM source_scores WHERE hits > 0 OR value > 0
),
source_capped AS (SELECT *, row_number() OVER (PARTITION BY result_id, doc_id ORDER BY rank) > 2 AS over FROM source_ranked),
source_picked AS (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY over, rank) AS pick FROM source_capped),
picks AS (SELECT * FROM (SELECT *, max(hits) OVER (PARTITION BY result_id) AS top FROM source_picked WHERE pick <= most) WHERE NOT replaces OR top > 0),
cites0 AS (
  SELECT result_id, ord, chunk_id, doc_id, page_start, page_end, body FROM held_cites WHERE result_id NOT IN (SELECT result_id FROM picks)
  UNION ALL SELECT result_id, pick, chunk_id, doc_id, page_start, page_end, CASE WHEN length(body) > 900 THEN body[1:900] || '…' ELSE body END FROM picks
),
lacking AS (
  SELECT result_id FROM outputs WHERE stacking AND (regexp_matches(answer, '{_any_rule}') OR regexp_matches(answer, '{_INSTANCES}'))
    AND result_id IN (SELECT result_id FROM cites0 GROUP BY 1 HAVING NOT bool_or(regexp_matches(body, '{_any_rule}')))
),
supplement AS (
  SELECT result_id, 1073741824 AS ord, chunk_id, doc_id, page_start, page_end, body FROM (
    SELECT p.*, row_number() OVER (PARTITION BY p.result_id ORDER BY place) AS r FROM prompt p LEFT JOIN (SELECT DISTINCT result_id, chunk_id, true AS had FROM cites0) c USING (result_id, chunk_id)
    WHERE result_id IN (SELECT result_id FROM lacking) AND regexp_matches(body, '{_any_rule}') AND had IS NULL) WHERE r = 1
),
cites1 AS (SELECT c.*, question, terms, stacking, answer FROM (SELECT * FROM cites0 UNION ALL SELECT * FROM supplement) c JOIN outputs USING (result_id)),
cites2 AS (
  SELECT *, bool_or(ok) OVER (PARTITION BY result_id) AND NOT ok AS pruned FROM (
    SELECT *, NOT stacking OR regexp_matches(body, '{_any_rule}') OR len(terms) = 0 OR coalesce({total}, 0) > 0 AS ok FROM cites1)
),
spoken AS (SELECT *, body AS snippet FROM cites2 WHERE NOT pruned AND {_trim("answer")} <> ''),
{_aligned("spoken")},
final_cites AS (
  SELECT result_id, ord, chunk_id, page_start, page_end, kept, place FROM lined
  UNION ALL SELECT result_id, ord, chunk_id, page_start, page_end, true, row_number() OVER (PARTITION BY result_id ORDER BY ord) FROM cites2
    WHERE NOT pruned AND {_trim("answer")} = ''
),
answers AS (
SELECT o.result_id,
  CASE WHEN confidence = 'high' AND (coalesce(dropped_ids, '') <> '' OR coalesce(replaced_ids, '') <> '') THEN 'mixed' ELSE confidence END AS confidence,
  coalesce(final_ids, '') AS final_ids, coalesce(page_hints, '') AS page_hints, coalesce(resolved_ids, '') AS resolved_ids,
  coalesce(unresolved_ids, '') AS unresolved_ids, coalesce(dropped_ids, '') AS dropped_ids, coalesce(replaced_ids, '') AS replaced_ids,
  coalesce(fallback_ids, '') AS fallback_ids, coalesce(supplement_ids, '') AS supplement_ids, coalesce(pruned_ids, '') AS pruned_ids,
  coalesce(weak_ids, '') AS weak_ids, o.result_id IN (SELECT result_id FROM need WHERE falls) AS used_fallback
FROM outputs o
LEFT JOIN (SELECT result_id, string_agg(chunk_id, ',' ORDER BY place) AS final_ids,
  string_agg(CASE WHEN page_start = page_end THEN 'p. ' || page_start ELSE 'pp. ' || page_start || '-' || page_end END, ',' ORDER BY place) AS page_hints
  FROM final_cites WHERE kept GROUP BY 1) USING (result_id)
LEFT JOIN (SELECT result_id, string_agg(wanted, ',' ORDER BY ord) AS resolved_ids FROM (SELECT result_id, wanted, min(ord) AS ord FROM resolved GROUP BY 1, 2) GROUP BY 1) USING (result_id)
LEFT JOIN (SELECT result_id, string_agg(wanted, ',' ORDER BY ord) AS unresolved_ids FROM (SELECT result_id, wanted, min(ord) AS ord
  FROM missing LEFT JOIN (SELECT result_id, wanted, true AS had FROM near) USING (result_id, wanted) WHERE had IS NULL GROUP BY 1, 2) GROUP BY 1) USING (result_id)
LEFT JOIN (SELECT result_id, string_agg(chunk_id, ',' ORDER BY ord, chunk_id) AS dropped_ids FROM placed_cites WHERE dropped GROUP BY 1) USING (result_id)
LEFT JOIN (SELECT result_id, string_agg(chunk_id, ',' ORDER BY ord, chunk_id) AS replaced_ids FROM held_cites WHERE result_id IN (SELECT result_id FROM picks WHERE replaces) GROUP BY 1) USING (result_id)
LEFT JOIN (SELECT result_id, string_agg(chunk_id, ',' ORDER BY pick) AS fallback_ids FROM picks WHERE NOT replaces GROUP BY 1) USING (result_id)
LEFT JOIN (SELECT result_id, string_agg(chunk_id, ',') AS supplement_ids FROM supplement GROUP BY 1) USING (result_id)
LEFT JOIN (SELECT result_id, string_agg(chunk_id, ',' ORDER BY ord, chunk_id) AS pruned_ids FROM cites2 WHERE pruned GROUP BY 1) USING (result_id)
LEFT JOIN (SELECT result_id, string_agg(chunk_id, ',' ORDER BY ord, chunk_id) AS weak_ids
  FROM final_cites LEFT JOIN (SELECT DISTINCT result_id, chunk_id, true AS stays FROM final_cites WHERE kept) USING (result_id, chunk_id) WHERE NOT kept AND stays IS NULL GROUP BY 1) USING (result_id)
)
"""


_OWN_PROMPTS = f"""
{_BODIES}, {_QTERMS},
outputs AS (
  SELECT result_id, coalesce(question, '') AS question, coalesce(terms, []) AS terms, coalesce(stacking, false) AS stacking, coalesce(answer, '') AS answer, confidence
  FROM ({RESULTS}) LEFT JOIN qterms USING (question_id)
),
cited_once AS (SELECT result_id, chunk_id, min(ord) AS ord FROM cited GROUP BY 1, 2),
steps AS (
  SELECT result_id, doc_id, chunk_index + d AS chunk_index, min(ord * 2 + d) AS o
  FROM cited_once JOIN bodies USING (chunk_id), (SELECT unnest([1, 2]) AS d) GROUP BY 1, 2, 3
),
prompt AS (
  SELECT result_id, place, chunk_id, doc_id, page_start, page_end, body FROM (
    SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY o, doc_id, chunk_index) AS place FROM steps JOIN bodies USING (doc_id, chunk_index))
  WHERE place <= 6
)
"""

_SEGMENT_LINES = r"regexp_split_to_array(regexp_replace(coalesce(content, ''), '\r\n?', chr(10), 'g'), chr(10))"
_marked = _trim(rf"regexp_extract(t, '^#{{1,6}}{_WS}+(.+?)(?:{_WS}+#*)?$', 1)")
_heading = rf"""CASE WHEN regexp_matches(t, '^#{{1,6}}{_WS}+.') THEN CASE WHEN length({_marked}) >= 2 THEN {_marked} END
  WHEN length(t) BETWEEN 4 AND 72 AND NOT regexp_matches(t, '[.!?:]$') AND (
    (length(regexp_replace(t, '[^A-Za-z]', '', 'g')) >= 4 AND length(regexp_replace(t, '[^A-Z]', '', 'g')) / length(regexp_replace(t, '[^A-Za-z]', '', 'g')) > 0.85)
    OR (len(ws) = 1 AND length(t) BETWEEN 4 AND 48 AND regexp_matches(t, '^[A-Z][\p{{L}}''’0-9\-]*$') AND regexp_matches(t, '[a-z]'))
    OR (len(ws) BETWEEN 2 AND 10 AND len(list_filter(ws, lambda w: NOT (list_contains({_list(JOIN_WORDS)}, lower(w)) OR regexp_matches(w, '^[A-Z0-9][A-Za-z0-9_''’\-]*$')))) = 0
      AND len(list_filter(ws, lambda w: NOT list_contains({_list(JOIN_WORDS)}, lower(w)))) > 0)
  ) THEN t END"""
_SEGMENTS = f"""
seg_lines AS (
  SELECT doc_id, page_number, line_at, t, list_filter(regexp_split_to_array(t, '{_WS}+'), lambda w: w <> '') AS ws FROM (
    SELECT doc_id, page_number, line_at, {_trim("line")} AS t FROM (
      SELECT doc_id, page_number, generate_subscripts(ls, 1) AS line_at, unnest(ls) AS line FROM (SELECT doc_id, page_number, {_SEGMENT_LINES} AS ls FROM ({PAGES}))))
  WHERE t <> ''
),
seg_heads AS (SELECT doc_id, page_number, line_at, t, {_heading} AS heading FROM seg_lines),
seg_groups AS (SELECT *, count(heading) OVER (PARTITION BY doc_id, page_number ORDER BY line_at) AS g FROM seg_heads),
seg_bodies AS (
  SELECT doc_id, page_number, g, max(heading) AS section_heading, string_agg(t, ' ' ORDER BY line_at) FILTER (heading IS NULL) AS content FROM seg_groups GROUP BY 1, 2, 3
),
segs AS (
  SELECT doc_id, page_number, (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY g) - 1)::INT AS seg_no, section_heading, content
  FROM seg_bodies WHERE content IS NOT NULL
  UNION ALL SELECT doc_id, page_number, 0, NULL, {_trim("coalesce(content, '')")} FROM ({PAGES})
    WHERE {_trim("coalesce(content, '')")} <> '' AND (doc_id, page_number) NOT IN (SELECT doc_id, page_number FROM seg_bodies WHERE content IS NOT NULL)
)
"""
_ISLANDS = f"""
isl_c AS ({CHUNKS}),
isl_f AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0
  WHEN section_heading IS DISTINCT FROM lag(section_heading) OVER w THEN 1 ELSE 0 END AS fresh FROM isl_c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)),
isl AS (SELECT *, (sum(fresh) OVER (PARTITION BY doc_id ORDER BY chunk_index))::INT AS section_index FROM isl_f)
"""
_NOT_WS = "[^" + _WS[1:]


def _names(c: str) -> str:
    """Normalised names of a list, each once, in order."""
    every = f"list_filter(list_transform(coalesce({c}, []), lambda x: {_concept('x')}), lambda x: x <> '')"
    return f"list_filter({every}, lambda w, i: list_position({every}, w) = i)"


def _held(column: str, name: str) -> str:
    return (
        f"SELECT DISTINCT {name}, concept FROM (SELECT section_id AS {name}, {_concept('c')} AS concept FROM "
        f"(SELECT section_id, unnest({column}) AS c FROM ({SECTIONS}))) WHERE concept <> ''"
    )


_SQL = {
    "dense_topk": f"WITH {_DENSE} SELECT question_id, corpus_pos, round(dense, 5) AS dense, rank FROM dense_ranked WHERE rank <= 10",
    "lexical_topk": f"{_LEX} SELECT question_id, corpus_pos, round(lex, 6) AS lex, rank FROM lane",
    "hybrid_retrieve": f"{_HYBRID} SELECT question_id, corpus_pos, doc_id, chunk_index, round(score, 5) AS score, rank, pick FROM picked",
    "hybrid_all_lanes": f"{_ALL_LANES} SELECT question_id, corpus_pos, doc_id, chunk_index, round(score, 5) AS score, rank, pick FROM picked",
    "router_boosts": f"WITH {_DENSE}, {_DOC_VECTORS} SELECT question_id, doc_id, round(boost, 5) AS boost FROM router",
    "define_lane": f"""WITH {_phrases("1")}, {_DEFINES},
h AS (SELECT question_id, chunk_id, count(*) AS hits FROM define_pairs JOIN define_chunks USING (define) GROUP BY 1, 2)
SELECT question_id, chunk_id, hits, round(least(hits, 4) * 0.05::DOUBLE, 6) AS boost FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY hits DESC, chunk_id) AS r FROM h) WHERE r <= 12""",
    "define_debug": f"""WITH {_phrases("1")}, {_DEFINES},
h AS (SELECT question_id, chunk_id, count(*) AS hits FROM define_pairs JOIN define_chunks USING (define) GROUP BY 1, 2),
s AS (SELECT question_id, least(count(*), 12) AS seeded FROM h GROUP BY 1),
p AS (SELECT question_id, string_agg(pair, '|' ORDER BY pair) AS pairs FROM (SELECT question_id, phrase || '↔' || define AS pair FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY phrase, define) AS r FROM define_pairs) WHERE r <= 48) GROUP BY 1)
SELECT question_id, len(phrases)::INT AS phrase_count, coalesce(seeded, 0)::BIGINT AS chunks_seeded, coalesce(pairs, '') AS matched_pairs
FROM phrases LEFT JOIN s USING (question_id) LEFT JOIN p USING (question_id)""",
    "concept_phrases": f"WITH {_phrases('1')} SELECT question_id, array_to_string(list_sort(phrases), '|') AS phrases FROM phrases",
    "graph_boosts": f"WITH {_DENSE}, {_EDGES} SELECT question_id, chunk_id, round(boost, 6) AS boost FROM graph_found",
    "index_entries": f"WITH {_INDEX} SELECT doc_id, topic, topic_norm, array_to_string(pages, ',') AS pages FROM hints",
    "index_hint_boosts": f"""WITH {_INDEX}, hint_terms AS (SELECT question_id, unnest(terms) AS term FROM ({_TERMS.format(questions=QUESTIONS)})), {_HINTED}
SELECT DISTINCT question_id, chunk_id, 0.07::DOUBLE AS boost FROM ({CHUNKS}) JOIN hinted USING (doc_id) WHERE page BETWEEN page_start AND page_end""",
    "page_segments": f"WITH {_SEGMENTS} SELECT * FROM segs",
    "chunk_pages": f"""WITH {_SEGMENTS},
seg_words AS (SELECT *, list_filter(regexp_split_to_array(content, '{_WS}+'), lambda w: w <> '') AS ws FROM segs),
seg_n AS (SELECT *, greatest(0, floor((len(ws) - 100) / 87)::INT + 1) AS full_ones FROM seg_words),
cut_up AS (SELECT doc_id, page_number, seg_no, section_heading, window_no, ws[87 * window_no + 1 : 87 * window_no + 100] AS part
  FROM (SELECT *, unnest(range(full_ones + 1)) AS window_no FROM seg_n)),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY page_number, seg_no, window_no) - 1)::INT AS chunk_index FROM cut_up WHERE len(part) = 100 OR 3 * len(part) > 10)
SELECT doc_id, chunk_index, doc_id || '#' || chunk_index AS chunk_id, page_number, section_heading, array_to_string(part, ' ') AS text, (3 * len(part))::INT AS token_count FROM numbered""",
    "section_synopses": f"""WITH {_ISLANDS},
body AS (SELECT doc_id, section_index, coalesce(arg_min_null(section_heading, chunk_index), 'Untitled (p. ' || arg_min(page_start, chunk_index) || ')')
  || chr(10) || chr(10) || string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY chunk_index) AS whole FROM isl GROUP BY 1, 2),
parts AS (SELECT *, regexp_extract_all(whole, '{_WS}*{_NOT_WS}+') AS ws FROM body)
SELECT doc_id, section_index, md5(CASE WHEN len(ws) <= 233 THEN whole ELSE array_to_string(ws[1:233], '') END) AS synopsis_md5 FROM parts""",
    "document_notes": f"""WITH s AS ({SECTIONS}),
l AS (SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC NULLS LAST) AS r FROM library_docs) WHERE r = 1),
b AS (SELECT doc_id, section_index, section_id, '## ' || coalesce(title, '') || chr(10) || 'topics: ' || array_to_string(({_names("concepts")})[1:12], ', ') || chr(10)
  || 'defines: ' || array_to_string({_names("defines")}, ', ') || chr(10) || 'refs: ' || array_to_string(({_names("refs")})[1:8], ', ') AS part FROM s),
w AS (SELECT doc_id, string_agg(part, chr(10) || chr(10) ORDER BY section_index, section_id) AS whole FROM b GROUP BY 1),
c AS (SELECT *, regexp_extract_all(whole, '{_WS}*{_NOT_WS}+') AS ws FROM w),
t AS (SELECT doc_id, CASE WHEN len(ws) <= 1166 THEN whole ELSE array_to_string(ws[1:1166], '') END AS rollup FROM c)
SELECT doc_id, coalesce(label, doc_id) || ': rules reference (MOC generation failed; using concept roll-up).' AS scope_summary, md5(rollup) AS rollup_md5, length(rollup)::INT AS rollup_chars
FROM t LEFT JOIN l USING (doc_id)""",
    "enrich_sections": f"""WITH s AS (SELECT *, sha256('1:' || coalesce(synopsis, '')) AS cache_key FROM ({SECTIONS})),
o AS (SELECT cache_key, arg_min({{'c': concepts, 'd': defines, 'r': refs, 'a': see_also}}, section_id) AS x FROM s GROUP BY 1),
g AS (SELECT cache_key, x.c AS c, x.d AS d, x.r AS r, len(list_filter(list_concat(coalesce(x.c, []), coalesce(x.d, []), coalesce(x.r, []), coalesce(x.a, [])), lambda v: v IS NULL)) = 0 AS good FROM o)
SELECT section_id, cache_key, CASE WHEN good THEN array_to_string({_names("c")}, '|') ELSE '' END AS concepts,
  CASE WHEN good THEN array_to_string(list_filter({_names("d")}, lambda v: contains(lower(coalesce(synopsis, '')), v)), '|') ELSE '' END AS defines,
  CASE WHEN good THEN array_to_string({_names("r")}, '|') ELSE '' END AS refs, good AS enriched
FROM s JOIN g USING (cache_key)""",
    "request_errors": f"""WITH l AS (SELECT DISTINCT library_id, embedding_model FROM libraries),
m AS (SELECT embedding_model AS model FROM (SELECT embedding_model, count(*) AS n FROM l GROUP BY 1) ORDER BY n DESC, embedding_model LIMIT 1),
k AS (SELECT library_id AS known, any_value(embedding_model) AS built FROM l GROUP BY 1)
SELECT * FROM (SELECT question_id, CASE WHEN coalesce({_trim("library_id")}, '') = '' THEN 'missing library'
  WHEN {_trim("coalesce(question, '')")} = '' THEN 'missing question' WHEN length({_trim("question")}) > 32768 THEN 'question too long'
  WHEN len(list_filter(history, lambda h: h IS NULL OR h.role IS NULL OR h.role NOT IN ('user', 'assistant') OR h.content IS NULL)) > 0 THEN 'invalid history'
  WHEN known IS NULL THEN 'library not found' WHEN built <> model THEN 'embedding model mismatch' END AS error
FROM (SELECT * FROM ({QUESTIONS}), m) LEFT JOIN k ON known = {_trim("library_id")}) WHERE error IS NOT NULL""",
    "ask_results": f"""{_EXCERPTS},
{_CITED.replace("FROM (" + RESULTS + ")", "FROM (SELECT * FROM (" + RESULTS + ") WHERE question_id % @EVERY = 0)")}, {_BODIES}, {_QTERMS},
asked_results AS (SELECT r.*, question, terms, stacking FROM ({RESULTS}) r JOIN qterms USING (question_id) WHERE question_id % @EVERY = 0),
outputs AS (
  SELECT result_id, question_id, question, terms, stacking, a AS answer,
    CASE WHEN level = 'not_in_book' AND coalesce(seen, 0) > 0 AND (coalesce(k, 0) > 0
      OR regexp_matches(a, '{_INVENTED}') OR length(a) > 200 OR (regexp_matches(a, '{_DEFINITE}') AND length(a) > 35)) THEN 'mixed' ELSE level END AS confidence
  FROM (SELECT *, coalesce(answer, 'Unable to generate an answer.') AS a, CASE WHEN confidence IN ('high', 'mixed', 'not_in_book', 'speculative') THEN confidence ELSE 'not_in_book' END AS level FROM asked_results)
  LEFT JOIN (SELECT result_id, count(*) AS k FROM cited GROUP BY 1) USING (result_id) LEFT JOIN (SELECT question_id, count(*) AS seen FROM excerpts GROUP BY 1) USING (question_id)
),
prompt AS (SELECT result_id, place, chunk_id, doc_id, page_start, page_end, body FROM outputs JOIN excerpts USING (question_id)),
{_formatted()} SELECT * FROM answers""",
    "format_results": f"WITH {_CITED}, {_OWN_PROMPTS}, {_formatted()} SELECT * FROM answers",
    "model_outputs": f"""WITH {_CITED},
c AS (SELECT result_id, string_agg(chunk_id, ',' ORDER BY ord) AS ids FROM cited GROUP BY 1)
SELECT result_id, coalesce(answer, 'Unable to generate an answer.') AS answer, coalesce(spoken_summary, '') AS spoken_summary,
  CASE WHEN confidence IN ('high', 'mixed', 'not_in_book', 'speculative') THEN confidence ELSE 'not_in_book' END AS confidence, coalesce(ids, '') AS cited
FROM ({RESULTS}) LEFT JOIN c USING (result_id)""",
    "citation_alignment": f"""WITH {_CITED}, {_BODIES}, {_QTERMS},
texts AS (SELECT c.result_id, ord, chunk_id, question, terms, stacking, answer, body AS snippet FROM cited c JOIN ({RESULTS}) r USING (result_id) JOIN qterms USING (question_id) JOIN bodies USING (chunk_id) WHERE trim(answer) <> ''),
{_aligned("texts")} SELECT result_id, ord::INT AS ord, chunk_id, round(support, 6) AS support, kept, place FROM lined""",
    "answer_reconcile": f"""WITH {_CITED},
n AS (SELECT result_id, count(*) AS seen FROM cited WHERE chunk_id IN (SELECT chunk_id FROM ({CHUNKS})) GROUP BY 1),
r AS (SELECT result_id, coalesce(answer, '') AS a, spoken_summary, confidence, coalesce(len(citations), 0) AS k, coalesce(seen, 0) AS seen FROM ({RESULTS}) LEFT JOIN n USING (result_id)),
f AS (SELECT *, {_trim(_collapse("a"))} AS flat FROM r)
SELECT result_id, CASE WHEN confidence = 'not_in_book' AND seen > 0 AND (k > 0 OR regexp_matches(a, '{_INVENTED}') OR length(a) > 200
    OR (regexp_matches(a, '{_DEFINITE}') AND length(a) > 35)) THEN 'mixed' ELSE confidence END AS confidence,
  CASE WHEN regexp_matches(spoken_summary, '{_DENIES}') AND regexp_matches(a, '{_AFFIRMS}') AND NOT regexp_matches(a, '{_DENIES_TOO}')
    THEN CASE WHEN length(flat) > 280 THEN flat[1:277] || '…' ELSE flat END ELSE spoken_summary END AS spoken_summary
FROM f""",
    "neighbor_expand": f"{_EXPANDED} SELECT * FROM expanded",
    "prompt_budget": f"{_EXCERPTS} SELECT question_id, chunk_id, place, tokens, total_tokens::BIGINT AS total_tokens FROM excerpts",
    "prompt_text": f"""{_EXCERPTS}, {_TURNS}, said AS ({_SAID}),
said_n AS (SELECT *, sum(3 * len(list_filter(regexp_split_to_array(content, '{_WS}+'), lambda w: w <> ''))) OVER (PARTITION BY question_id ORDER BY turn DESC) AS total FROM said),
past AS (SELECT question_id, string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS past FROM said_n WHERE total <= 1500 GROUP BY 1),
bodies_of AS (SELECT question_id, string_agg(excerpt, chr(10) || '---' || chr(10) ORDER BY place) AS texts FROM excerpts GROUP BY 1),
made AS (SELECT question_id, 'Answer from the excerpts only. Cite the CHUNK_ID of every excerpt you use. Say so if they do not answer.' || chr(10) || chr(10)
  || coalesce(texts, '') || chr(10) || chr(10) || coalesce(past, '') || chr(10) || chr(10) || 'Question: ' || question AS prompt
  FROM ({QUESTIONS}) LEFT JOIN bodies_of USING (question_id) LEFT JOIN past USING (question_id) WHERE question_id % @EVERY = 0)
SELECT question_id, md5(prompt) AS prompt_md5, length(prompt)::INT AS prompt_chars FROM made""",
    "provenance_pick": _PROVENANCE,
    "text_keys": "SELECT DISTINCT doc_id, label, regexp_replace(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, sha256(label) AS label_hash FROM library_docs",
    "title_keys": f"SELECT section_id, {_concept('title')} AS title_key FROM ({SECTIONS})",
    "question_terms": f"SELECT question_id, array_to_string(terms, ' ') AS terms, stacking FROM ({_TERMS.format(questions=QUESTIONS)})",
    "chunk_windows": f"""
WITH w AS (SELECT doc_id, {_words} AS ws FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, greatest(0, floor((len(ws) - 100) / 87)::INT + 1) AS full_ones FROM w),
cut AS (SELECT doc_id, window_no, ws[87 * window_no + 1 : 87 * window_no + 100] AS part
  FROM (SELECT *, unnest(range(full_ones + 1)) AS window_no FROM n))
SELECT doc_id, window_no::INT AS window_no, (3 * len(part))::INT AS token_count, md5(array_to_string(part, ' ')) AS text_md5
FROM cut WHERE len(part) = 100 OR 3 * len(part) > 10""",
    "section_islands": f"""
WITH c AS ({CHUNKS}),
f AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0
  WHEN section_heading IS DISTINCT FROM lag(section_heading) OVER w THEN 1 ELSE 0 END AS fresh FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)),
i AS (SELECT *, (sum(fresh) OVER (PARTITION BY doc_id ORDER BY chunk_index))::INT AS section_index FROM f)
SELECT doc_id, section_index, doc_id || '#sec:' || section_index AS section_id,
  coalesce(arg_min_null(section_heading, chunk_index), 'Untitled (p. ' || arg_min(page_start, chunk_index) || ')') AS title,
  arg_min(page_start, chunk_index) AS page_start, arg_max(page_end, chunk_index) AS page_end,
  string_agg(chunk_id, ',' ORDER BY chunk_index) AS chunk_ids
FROM i GROUP BY doc_id, section_index""",
    "section_edges": f"""
WITH p AS (SELECT section_id, lead(section_id) OVER (PARTITION BY doc_id ORDER BY section_index) AS nxt FROM ({SECTIONS}))
SELECT section_id AS src, nxt AS dst, 'next_section' AS type, 1.0::DOUBLE AS weight FROM p WHERE nxt IS NOT NULL
UNION ALL SELECT nxt, section_id, 'prev_section', 1.0::DOUBLE FROM p WHERE nxt IS NOT NULL""",
    "concept_edges": f"""
WITH r AS ({_held("refs", "ref")}), f AS ({_held("defines", "def")}),
p AS (SELECT ref, def, concept FROM r JOIN f USING (concept) WHERE ref <> def),
e AS (SELECT ref AS src, def AS dst, 'references' AS type, concept FROM p UNION ALL SELECT def, ref, 'defines', concept FROM p)
SELECT src, type, count(*) AS edges, count(DISTINCT concept) AS concepts FROM e GROUP BY src, type""",
    "see_also_edges": f"""
WITH s AS ({SECTIONS}),
h AS (SELECT DISTINCT doc_id, src, own, hint FROM (SELECT doc_id, section_id AS src, {_concept('title')} AS own, {_concept('x')} AS hint
  FROM (SELECT doc_id, section_id, title, unnest(see_also) AS x FROM s)) WHERE hint <> '' AND hint <> own),
t AS (SELECT doc_id, section_id AS dst, {_concept('title')} AS title FROM s)
SELECT DISTINCT src, dst, 'see_also' AS type, 0.5::DOUBLE AS weight FROM h JOIN t USING (doc_id)
WHERE src <> dst AND (contains(title, hint) OR contains(hint, title))""",
    "doc_summaries": f"""
WITH s AS ({SECTIONS}),
c AS (SELECT doc_id, section_index, pos, {_concept('x')} AS concept FROM
  (SELECT doc_id, section_index, unnest(concepts) AS x, generate_subscripts(concepts, 1) AS pos FROM s)),
n AS (SELECT doc_id, concept, count(*) AS n, min((section_index, pos)) AS first FROM c WHERE concept <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first, concept) AS r FROM n),
t AS (SELECT doc_id, string_agg(concept, '|' ORDER BY r) AS top_concepts FROM r WHERE r <= 40 GROUP BY 1),
d AS (SELECT doc_id, string_agg(DISTINCT concept, '|' ORDER BY concept) AS authoritative_for FROM
  (SELECT doc_id, {_concept('x')} AS concept FROM (SELECT doc_id, unnest(defines) AS x FROM s)) WHERE concept <> '' GROUP BY 1)
SELECT doc_id, coalesce(top_concepts, '') AS top_concepts, coalesce(authoritative_for, '') AS authoritative_for
FROM (SELECT DISTINCT doc_id FROM s) LEFT JOIN t USING (doc_id) LEFT JOIN d USING (doc_id)""",
    "history_budget": f"""
WITH {_TURNS}, said AS ({_SAID}),
k AS (SELECT *, (3 * len(list_filter(regexp_split_to_array(content, '{_WS}+'), lambda w: w <> '')))::INT AS tokens FROM said),
s AS (SELECT *, (sum(tokens) OVER (PARTITION BY question_id ORDER BY turn DESC))::BIGINT AS total_tokens FROM k)
SELECT question_id, turn::INT AS turn, role, tokens, total_tokens FROM s WHERE total_tokens <= 120""",
    "history_rejects": f"WITH {_TURNS} SELECT question_id, turn::INT AS turn, role FROM turns WHERE role IS NULL OR role NOT IN ('user', 'assistant') OR content IS NULL",
    "thread_depth": f"""
WITH {_TURNS}, said AS ({_SAID})
SELECT question_id, turn::INT AS turn, role, (sum((role = 'user')::INT) OVER (PARTITION BY question_id ORDER BY turn))::BIGINT AS depth FROM said""",
    "citation_resolve": f"""
WITH {_CITED}, k AS ({CHUNKS})
SELECT result_id, ord::INT AS ord, chunk_id, k.doc_id IS NOT NULL AS resolved, k.doc_id,
  CASE WHEN page_start = page_end THEN 'p. ' || page_start ELSE 'pp. ' || page_start || '-' || page_end END AS page_hint
FROM cited LEFT JOIN k USING (chunk_id)""",
    "near_ids": f"""
WITH {_CITED},
k AS (SELECT chunk_id FROM ({CHUNKS})),
w AS (SELECT DISTINCT result_id, chunk_id[1:1] || chunk_id[3:] AS chunk_id FROM cited WHERE (chunk_id[1:1] || chunk_id[3:]) NOT IN (SELECT chunk_id FROM k)),
a AS (SELECT *, lower(regexp_extract(chunk_id, '^(.+)#(\\d+)$', 1)) AS w, regexp_extract(chunk_id, '^(.+)#(\\d+)$', 2) AS n FROM w),
b AS (SELECT DISTINCT result_id, ord, chunk_id AS near_id, lower(regexp_extract(chunk_id, '^(.+)#(\\d+)$', 1)) AS c, regexp_extract(chunk_id, '^(.+)#(\\d+)$', 2) AS n FROM cited WHERE chunk_id IN (SELECT chunk_id FROM k)),
p AS (SELECT a.result_id, chunk_id, near_id, ord, levenshtein(w, c)::INT AS edits FROM a JOIN b ON a.result_id = b.result_id AND a.n = b.n AND a.n <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY result_id, chunk_id ORDER BY edits, ord, near_id) AS r FROM p WHERE edits BETWEEN 1 AND 4)
SELECT result_id, chunk_id, near_id, edits FROM r WHERE r = 1""",
    "change_gate": """
WITH d AS (SELECT DISTINCT doc_id, sha256, created_at FROM library_docs),
n AS (SELECT doc_id, sha256 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC NULLS LAST) AS r FROM d) WHERE r = 1)
SELECT doc_id, sha256 FROM n WHERE EXISTS (SELECT 1 FROM d WHERE d.doc_id = n.doc_id AND d.sha256 IS DISTINCT FROM n.sha256)""",
    "chunk_ranges": f"SELECT doc_id, min(corpus_pos) AS chunk_start, max(corpus_pos) AS chunk_end FROM ({CHUNKS}) GROUP BY doc_id",
    "scanned_only": f"""
SELECT doc_id, count(*) AS n_pages, sum(length(coalesce(content, '')))::BIGINT AS n_chars,
  count(*) > 1 AND sum(length(coalesce(content, ''))) < 50 AS scanned FROM ({PAGES}) GROUP BY doc_id""",
    "library_catalog": f"""
WITH l AS (SELECT DISTINCT library_id, label FROM libraries),
d AS (SELECT library_id, count(DISTINCT doc_id) AS documents FROM library_docs GROUP BY 1),
c AS (SELECT library_id, count(*) AS chunks FROM ({CHUNKS}) GROUP BY 1)
SELECT library_id, label, coalesce(documents, 0) AS documents, coalesce(chunks, 0) AS chunks FROM l LEFT JOIN d USING (library_id) LEFT JOIN c USING (library_id)""",
    "eval_score": f"""
WITH r AS (SELECT question_id, result_id, answered_at, answer, confidence FROM ({RESULTS})),
b AS (SELECT question_id, arg_min({{'a': answer, 'c': confidence}}, (answered_at, result_id)) AS one, arg_max({{'a': answer, 'c': confidence}}, (answered_at, result_id)) AS two FROM r GROUP BY 1 HAVING count(*) > 1)
SELECT question_id, coalesce(two.c = one.c AND (one.a IS NULL OR one.a = '' OR contains(lower(two.a), lower(one.a[1:12]))), false) AS passed FROM b""",
    "grounded_results": f"""
WITH {_CITED}, k AS (SELECT chunk_id FROM ({CHUNKS})),
o AS (SELECT result_id, max((k.chunk_id IS NOT NULL)::INT) AS ok FROM cited LEFT JOIN k USING (chunk_id) GROUP BY 1)
SELECT library_id, CASE WHEN confidence IN ('high', 'mixed', 'not_in_book', 'speculative') THEN confidence ELSE 'not_in_book' END AS confidence,
  count(*) AS results, sum(coalesce(ok, 0))::BIGINT AS grounded
FROM ({RESULTS}) LEFT JOIN o USING (result_id) GROUP BY 1, 2""",
}


# searches that ask every question unless they are told to ask fewer
WHOLE = ("hybrid_retrieve", "hybrid_all_lanes", "neighbor_expand", "prompt_budget", "ask_results")


def _of_all(sql: str) -> str:
    """``sql`` without the choice of questions."""
    return sql.replace("question_id % @EVERY = 0 AND ", "").replace(" WHERE question_id % @EVERY = 0", "")


def oracle_sql(every: int | None = None) -> dict[str, str]:
    """SQL of every query that has one; a search asks the questions whose id is divisible by ``every``.

    Without it those of ``WHOLE`` ask all questions, the other searches those divisible by 100.
    """
    return {name: (_of_all(sql) if every is None and name in WHOLE else sql).replace("@EVERY", str(every or 100)) for name, sql in _SQL.items()}


ORACLE_SQL = oracle_sql()
