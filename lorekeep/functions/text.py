"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.functions.concepts import normalize_concept
from lorekeep.functions.whitespace import WS, collapse_ws, is_blank, trim_ws

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
RULE_CAP = 0.38
GLOSSARY_WEIGHT, GLOSSARY_CAP = 0.14, 0.22
# fixed values: small words inside headings
JOIN_WORDS = "a an the of and in on at to for or as by".split()
# fixed values: topics that are no index entries
SKIP_TOPICS = (
    "index", "contents", "table of contents", "introduction", "appendix", "appendices", "references", "bibliography",
    "glossary",
)
# fixed values: terms added to a question about stacking
STACKING_TERMS = "multiple affliction afflictions additional already".split()

# fixed values: patterns of a question about stacking and of an answer about several instances
STACKING_WORDS = "stack|stacks|stacking|duplicate|duplicates|twice|again|multiple"
INSTANCE_WORDS = r"each\s+instance|remove\s+each|instances?\s+of|already\s+have|no\s+additional|same\s+affliction"
# fixed values: patterns of an answer that sounds invented, or definite
INVENTED_WORDS = "typically|here's how|it works|stacks with"
DEFINITE_WORDS = "does not|do not|never stacks|always|cannot|can't|rules state|according to the excerpts"
# fixed values: patterns of a text that denies stacking, affirms it, or denies it in another way
DENIES_STACKING = r"does\s+not\s+stack|don't\s+stack|never\s+stacks"
AFFIRMS_STACKING = r"stack|stacks|each\s+instance|instances?\s+of"
DENIES_TOO = r"does\s+not\s+stack|don't\s+stack|never\s+stacks|cannot\s+stack"

_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def whole(pattern: str) -> str:
    """A case-insensitive pattern between ASCII word boundaries; the JVM's own boundary knows more letters."""
    return f"(?i){_L}(?:{pattern}){_R}"


_STACKING = whole(STACKING_WORDS)
_RULES = whole("|".join(RULE_PHRASES))


def slug(s: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), r"^-|-\z", "")


def surface(heading: Column, text: Column) -> Column:
    """The text that is embedded and scored: trimmed heading, blank line, text."""
    return F.when(is_blank(heading), text).otherwise(F.concat(trim_ws(heading), F.lit("\n\n"), text))


def about_stacking(s: Column) -> Column:
    """Whether a question is about stacking or duplicates."""
    return s.rlike(_STACKING)


def has_rule_text(s: Column) -> Column:
    """Whether a text has one of the rule phrases."""
    return s.rlike(_RULES)


def about_instances(answer: Column) -> Column:
    """Whether an answer speaks of several instances of an effect."""
    return has_rule_text(answer) | answer.rlike(whole(INSTANCE_WORDS)) | answer.rlike(whole("stack|stacks|stacking"))


def rule_weight(text: Column) -> Column:
    """Sum of the weights of the rule phrases in a text, at most ``RULE_CAP``."""
    total, low = F.lit(0.0), F.lower(text)
    for phrase, weight in RULE_PHRASES.items():
        # the boundaries are looked at only where the phrase stands
        total = total + F.when(F.contains(low, F.lit(phrase)) & text.rlike(whole(phrase)), weight).otherwise(0.0)
    return F.least(total, F.lit(RULE_CAP))


def words_of(s: Column) -> Column:
    """Lower-case runs of a-z, 0-9 and apostrophes."""
    return F.regexp_extract_all(F.lower(s), F.lit("([a-z0-9']+)"), F.lit(1))


def _unquoted(w: Column) -> Column:
    return F.regexp_replace(w, r"^'+|'+\z", "")


def question_terms(q: Column) -> Column:
    """Distinct terms of a question in order: three letters or more, no stop word; a stacking question has five more."""
    stop = F.array(*(F.lit(w) for w in QUESTION_STOP))
    one = F.transform(words_of(q), lambda w: F.regexp_replace(w, r"^'|'\z", ""))
    own = F.array_distinct(F.filter(one, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)))
    more = F.array(*(F.lit(w) for w in STACKING_TERMS))
    return F.when(about_stacking(q), F.array_union(own, more)).otherwise(own)


def answer_terms(a: Column) -> Column:
    """Distinct terms of an answer worth matching: four letters or more, no stop word."""
    stop = F.array(*(F.lit(w) for w in ANSWER_STOP))
    return F.array_distinct(
        F.filter(F.transform(words_of(a), _unquoted), lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w))
    )


def concept_phrases(q: Column, most: int = 64) -> Column:
    """Normalised terms, and pairs and triples of longer words, that may name a concept; the first ``most``."""
    stop = F.array(*(F.lit(w) for w in QUESTION_STOP))
    terms = F.filter(F.transform(question_terms(q), normalize_concept), lambda t: F.length(t) >= 3)
    words = F.filter(
        F.transform(words_of(trim_ws(q)), _unquoted), lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w)
    )

    def grams(words: Column, n: int) -> Column:
        count = F.size(words) - (n - 1)
        at = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        joined = F.transform(at, lambda i: normalize_concept(F.array_join(F.slice(words, i, n), " ")))
        return F.filter(joined, lambda p: F.length(p) >= 5)

    # bound to a variable, so that the words are not looked for again at every place
    runs = F.get(F.transform(F.array(words), lambda w: F.concat(grams(w, 2), grams(w, 3))), F.lit(0))
    return F.slice(F.array_distinct(F.concat(terms, runs)), 1, most)


def concepts_overlap(define: Column, phrase: Column) -> Column:
    """Loose match of a defined concept and a phrase of a question."""
    d, p = trim_ws(define), trim_ws(phrase)

    def within(long: Column, short: Column) -> Column:
        near = F.startswith(long, F.concat(short, F.lit(" "))) | F.endswith(long, F.concat(F.lit(" "), short))
        return ((F.length(short) >= 5) & F.contains(long, short)) | ((F.length(short) >= 4) & near)

    return (F.length(d) > 0) & (F.length(p) > 0) & ((d == p) | within(d, p) | within(p, d))


def match_ratio(text: Column, terms: Column) -> Column:
    """Share of the terms that stand in the text as whole words; terms of one letter only add to the denominator."""
    hit = F.size(F.filter(terms, lambda t: (F.length(t) >= 2) & (hits_of(text, t) > 0)))
    return F.when(F.size(terms) > 0, hit / F.size(terms)).otherwise(0.0)


def hits_of(text: Column, term: Column) -> Column:
    """Occurrences of a term of letters, digits and apostrophes as a whole word."""
    return F.regexp_count(text, F.concat(F.lit(f"(?i){_L}"), term, F.lit(_R)))


def term_hits(text: Column, terms: Column) -> Column:
    """Occurrences of all terms as whole words."""
    return F.aggregate(
        F.filter(terms, lambda t: F.length(t) >= 2), F.lit(0), lambda n, t: n + hits_of(text, t)
    )


def glossary_boost(text: Column, terms: Column) -> Column:
    """A boost for each long term that the text introduces like a glossary: the term, a or an, the term again."""
    found = F.filter(
        terms,
        lambda t: (F.length(t) >= 6)
        & F.rlike(text, F.concat(F.lit(f"(?i){_L}"), t, F.lit(r"\s+An?\s+"), t, F.lit(_R))),
    )
    return F.least(F.size(found) * F.lit(GLOSSARY_WEIGHT), F.lit(GLOSSARY_CAP))


def heading_of(line: Column) -> Column:
    """The heading that a line is, else null: marked, capitals only, one capitalised word or title case."""
    t = trim_ws(line)
    marked = F.regexp_extract(t, rf"^#{{1,6}}[{WS}]+(.+?)(?:[{WS}]+#*)?$", 1)
    inner = trim_ws(marked)
    letters = F.regexp_replace(t, "[^A-Za-z]", "")
    upper = F.length(F.regexp_replace(letters, "[^A-Z]", ""))
    capitals = (F.length(letters) >= 4) & (upper / F.length(letters) > 0.85)
    words = F.filter(F.split(t, rf"[{WS}]+"), lambda w: w != "")
    single = (
        (F.size(words) == 1)
        & F.length(t).between(4, 48)
        & t.rlike(r"^[A-Z][\p{L}'’0-9\-]*\z")
        & t.rlike("[a-z]")
    )
    join = F.array(*(F.lit(w) for w in JOIN_WORDS))
    title = F.size(words).between(2, 10) & F.forall(
        words, lambda w: F.array_contains(join, F.lower(w)) | w.rlike(r"^[A-Z0-9][A-Za-z0-9_'’\-]*\z")
    ) & F.exists(words, lambda w: ~F.array_contains(join, F.lower(w)))
    plain = F.length(t).between(4, 72) & ~t.rlike(r"[.!?:]\z") & (capitals | single | title)
    return F.when(t.rlike(rf"^#{{1,6}}[{WS}]+."), F.when(F.length(inner) >= 2, inner)).when(plain, t)


def index_key(s: Column) -> Column:
    """Lower case with single spaces."""
    return trim_ws(collapse_ws(F.lower(s)))


def index_entry(line: Column) -> Column:
    """(topic, pages) of an index line, else null."""
    pattern = r"^(.+?)\s+(\d{1,4}(?:\s*,\s*\d{1,4})*)\s*$"

    def parsed(s: Column) -> Column:
        topic = trim_ws(F.regexp_replace(trim_ws(F.regexp_extract(s, pattern, 1)), r"[.,;:]+\z", ""))
        pages = F.filter(
            F.transform(F.split(F.regexp_extract(s, pattern, 2), r"\s*,\s*"), lambda p: F.try_to_number(p, F.lit("9999")).cast("int")),
            lambda p: (p > 0) & (p < 5000),
        )
        return F.when(
            (F.length(s) >= 4) & s.rlike(pattern) & ~s.rlike(rf"^(?i)see{_R}") & ~s.rlike(r"^\d+[.,]\s"),
            F.struct(topic.alias("topic"), pages.alias("pages")),
        )

    def kept(e: Column) -> Column:
        topic = e["topic"]
        good = (
            F.length(topic).between(2, 160)
            & ~topic.rlike(r"^\d+\z")
            & ~F.lower(topic).isin(*SKIP_TOPICS)
            & (F.size(F.split(topic, " ")) <= 16)
            & (F.size(e["pages"]) > 0)
        )
        return F.when(good, e)

    # each step is bound to a variable, so that the line is not trimmed and parsed again for every condition
    s = F.array(trim_ws(collapse_ws(F.regexp_replace(line, r"\.{3,}|…+", " "))))
    return F.get(F.transform(F.transform(s, parsed), kept), F.lit(0))


def chunk_id_of(raw: Column) -> Column:
    """A cited chunk id without the label that models copy along."""
    return trim_ws(F.regexp_replace(trim_ws(raw), r"(?i)^CHUNK_ID\s*:\s*", ""))


def truncated_snippet(s: Column, most: int = 900) -> Column:
    """A snippet of at most ``most`` characters and an ellipsis where it was longer."""
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("…"))).otherwise(s)


def first_words(text: Column, most: int) -> Column:
    """The text up to the end of its first ``most`` words, white space between them kept."""
    parts = F.regexp_extract_all(text, F.lit(rf"([{WS}]*[^{WS}]+)"), F.lit(1))
    return F.when(F.size(parts) <= most, text).otherwise(F.array_join(F.slice(parts, 1, most), ""))


def truncated_to_tokens(text: Column, most: int, per_word: int = 3) -> Column:
    """The first words of a text whose estimated tokens are at most ``most``."""
    return first_words(text, most // per_word)


def embed_input(text: Column, tokens: int = 1000, characters: int = 2000) -> Column:
    """What is handed to an embedding model: no NUL, at most so many estimated tokens and characters."""
    return F.substring(truncated_to_tokens(F.replace(text, F.lit("\0"), F.lit("")), tokens), 1, characters)


def page_hint(first: Column, last: Column) -> Column:
    """``p. 3`` or ``pp. 3-4``."""
    return F.when(first == last, F.concat(F.lit("p. "), first.cast("string"))).otherwise(
        F.concat(F.lit("pp. "), first.cast("string"), F.lit("-"), last.cast("string"))
    )


def estimated_tokens(text: Column, per_word: int = 3) -> Column:
    """Token estimate: three a word."""
    return F.size(F.filter(F.split(text, rf"[{WS}]+"), lambda w: w != "")) * per_word


def answer_support(answer: Column, snippet: Column) -> Column:
    """How far a snippet supports a part of an answer: shared terms, rule text, shared pairs of words."""
    words = words_of(answer)
    low = F.lower(snippet)
    pairs = F.filter(
        F.transform(
            F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: F.array_join(F.slice(words, i, 2), " "),
        ),
        lambda p: (F.length(p) >= 8) & F.contains(low, p),
    )
    rules = F.when(has_rule_text(answer) & has_rule_text(snippet), 4.0).otherwise(0.0)
    return match_ratio(snippet, answer_terms(answer)) * 6 + rules + F.least(F.size(pairs) * F.lit(1.1), F.lit(4.0))


def clauses(answer: Column) -> Column:
    """Clauses of more than 28 characters, else the whole answer."""
    parts = F.filter(
        F.transform(F.split(answer, rf"(?<=[.!?])[{WS}]+"), trim_ws), lambda c: F.length(c) > 28
    )
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(answer))


def best_support(answer: Column, snippet: Column) -> Column:
    """Greatest support of any clause."""
    return F.greatest(F.array_max(F.transform(clauses(answer), lambda c: answer_support(c, snippet))), F.lit(0.0))


def reconciled_confidence(confidence: Column, answer: Column, cited: Column, in_prompt: Column) -> Column:
    """``not_in_book`` becomes ``mixed`` where the answer cites or sounds like one. ``cited``, ``in_prompt``: counts."""
    invented = answer.rlike(whole(INVENTED_WORDS))
    definite = answer.rlike(whole(DEFINITE_WORDS))
    sounds = invented | (F.length(answer) > 200) | (definite & (F.length(answer) > 35))
    doubtful = (confidence == "not_in_book") & (in_prompt > 0) & ((cited > 0) | sounds)
    return F.when(doubtful, "mixed").otherwise(confidence)


def reconciled_summary(summary: Column, answer: Column) -> Column:
    """The answer, shortened, where the summary denies stacking and the answer does not."""
    denies = summary.rlike(whole(DENIES_STACKING))
    affirms = answer.rlike(whole(AFFIRMS_STACKING)) & ~answer.rlike(whole(DENIES_TOO))
    flat = trim_ws(collapse_ws(answer))
    short = F.when(F.length(flat) > 280, F.concat(F.substring(flat, 1, 277), F.lit("…"))).otherwise(flat)
    return F.when(denies & affirms, short).otherwise(summary)
