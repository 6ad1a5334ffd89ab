"""Defective prompt and response pairs: empty, echoed, refused, broken off, or in another language."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.bytecnn import NEUTRAL, ByteNet, letters
from lorekeep.llm.language import WordVotes
from lorekeep.llm.spread import spread, spread_rows
from lorekeep.session import cut

# a template recurs under so many unrelated prompts
TEMPLATE_PROMPTS = 3
SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 16, 4
# a clause with at least this share of words that sound text never uses is free of content
FREE_SHARE = 0.25
# a clause of at least so many words is content if fewer than this share of them are strange, or if it holds a digit;
# a shorter one is a template only if it has two strange words, for short sound answers recur too
CLAUSE_WORDS, PLAIN_SHARE = 4, 0.125
# a template that stands beside content under more than these shares of its prompts reports on the book, or answers
MIXED_SLOT, MIXED = 0.1, 0.5
# up to so many prompts that evidence is thin, and naming the source decides
SURE_PROMPTS = 20
NAME = "<name>"
# words with at least one in so many of all pairs of text and word, and in two texts, are known: never more than that many
KNOWN_OF = 200_000
# a language is sure if it leads the next by so much, in log-probability
LEAD = 3.0
# a lead-in to a repeated prompt has at most so many words, or as many as the prompt
LEAD_IN = 8

# fixed values: stand-ins for an answer that is not there, as their letters
STAND_INS = frozenset(
    "none null nil na nan tbd tba tbc todo undefined empty blank pending missing unknown ka nichts nichtverfügbar "
    "rien nada brak нет なし 回答なし"
    .split()
)
# fixed values: words that deny, what they deny, and words between, in the ten languages
DENIALS = frozenset(
    "no not none without kein keine keinen ohne nicht aucun aucune sans pas sin ningún ninguna ninguno nessun nessuna senza non "
    "sem nenhum nenhuma não geen zonder niet brak nie bez нет без не".split()
)
VOIDS = frozenset(
    "answer answers response reply data content text information info value entry result results output summary available "
    "applicable provided given found specified set antwort angabe angaben daten inhalt verfügbar vorhanden réponse réponses "
    "donnée données contenu disponible respuesta respuestas dato datos contenido risposta risposte dati contenuto resposta "
    "respostas dados conteúdo disponível antwoord gegevens inhoud beschikbaar odpowiedzi danych treści dostępne ответа данных "
    "ответ данные доступно".split()
)
BETWEEN = frozenset("a an any de is was yet to for".split())

# fixed values: what an answer calls its source when it says that the matter is not covered
SOURCE_WORDS = tuple(
    "book books rulebook text texts excerpt excerpts passage passages page pages rule rules document documents source sources "
    "buch regelbuch auszug auszüge auszügen regel regeln seite seiten quelle quellen livre texte extrait extraits règle "
    "règles libro texto fragmento fragmentos regla reglas página páginas"
    .split()
)

_BULLET = regex.compile(r"\s*(?:[-*•–]|\d+[.)])\s+\S")
_CLOSE = regex.compile(r"[\s\p{Cf}\"'“”’»›)\]*_`~#\p{So}\p{Sk}\p{Emoji_Modifier}️‍]+\Z")
_AFTERTHOUGHT = regex.compile(
    r"\s*(?:[(\[]\s*(?:p|pp|pg|page|s|seite|pág|página|pag|pagina|str|стр|с)\.?\s*\d+[^()\[\]]{0,24}[)\]]|[«“„\"‹][^«»“”„\"‹›]{1,200}[»”“\"›])\s*\Z",
    regex.IGNORECASE,
)
_FORMULA = regex.compile(r"[\s\d+\-−–*/×÷=().,:%<>≤≥]*(?:\d*[dDwW]\d+[\s\d+\-−–*/×÷=().,:%<>≤≥]*)*\Z")
_CLAUSE = regex.compile(r"[.!?…:;,\n。！？、，；：>*_]+|\s[-–—]+\s")


def bare(text: str) -> str:
    """Letters and digits only, without case or accents."""
    s = unicodedata.normalize("NFKD", text).casefold()
    return "".join(c for c in s if c.isalnum())


def is_empty(value: str | None) -> bool:
    """Whether nothing, or only a stand-in for nothing, is there: a fixed word, or a denial and what it denies."""
    s = bare(value or "")
    if not s or s in STAND_INS:
        return True
    words = regex.findall(r"[\p{L}\p{M}]+", unicodedata.normalize("NFC", value or "").casefold())
    if "".join(words) in STAND_INS:
        return True
    kinds = {("deny" if w in DENIALS else "void" if w in VOIDS else "between" if w in BETWEEN else "other") for w in words}
    return not any(c.isdigit() for c in s) and "other" not in kinds and {"deny", "void"} <= kinds


def is_echo(value: str, prompt: str | None) -> bool:
    """Whether the response is the prompt once or more, with at most a short lead-in and nothing after it.

    Words are compared without case, accents and signs, so a prompt of any length is found.
    """
    q = [w for w in (bare(x) for x in regex.findall(r"[\p{L}\p{N}\p{M}]+", prompt or "")) if w]
    s = [w for w in (bare(x) for x in regex.findall(r"[\p{L}\p{N}\p{M}]+", value)) if w]
    if not q or not s:
        return False
    whole = "".join(q)
    if "".join(s) == whole * (len("".join(s)) // len(whole)):
        return True
    n = len(s)
    while n >= len(q) and s[n - len(q) : n] == q:
        n -= len(q)
    return n < len(s) and n <= max(LEAD_IN, len(q)) and not _holds(s[:n], q)


def _holds(words: list[str], part: list[str]) -> bool:
    return any(words[i : i + len(part)] == part for i in range(len(words) - len(part) + 1))


def is_truncated(value: str) -> bool:
    """Whether the text breaks off before its last sentence is complete."""
    s = value.rstrip()
    lines = [x for x in s.split("\n") if x.strip()]
    if lines and _BULLET.match(lines[-1]):
        return False
    while True:
        t = _CLOSE.sub("", s)
        # a page reference, a quotation or a sign at the end may follow a complete sentence
        u = _AFTERTHOUGHT.sub("", s)
        if u != s and u.strip() and regex.search(r"[.!?。！？…:]\W*\Z", u):
            s = u
            continue
        break
    if not t or _FORMULA.match(t):
        return False
    if regex.search(r"(?:…|\.\.\.)\Z", t):
        return True
    if t[-1] in ".!?。！？":
        return False
    words = regex.findall(r"[\p{L}\p{N}]+", t)
    return len(words) > 2 or t[-1] in ",;:-–—("


def clauses_of(value: str, known: frozenset[str], names: frozenset[str]) -> tuple[list[tuple[str, bool]], bool]:
    """The opening clauses, each with whether content stands beside it, and whether the response is free of content.

    The opening goes up to the first clause of content, that one included; a response without content is all opening. Names
    become a slot, so a clause that names its subject is the same for every subject; a clause of names only, like a
    heading, is passed over. A response is free of content if enough of its words other than names are strange:
    words that sound text never uses.
    """
    found, plain = [], []
    total = strange = 0
    opening = True
    for part in _CLAUSE.split(value):
        words = letters(part).split()
        digit = any(c.isdigit() for c in part)
        if not words:
            plain.append(digit)
            opening = opening and not digit
            continue
        others = [w for w in words if w not in names]
        if not others and not digit:
            continue
        odd = sum(w not in known for w in others)
        total, strange = total + len(others), strange + odd
        plain.append(digit or (len(words) >= CLAUSE_WORDS and odd < PLAIN_SHARE * len(others)))
        if opening and (len(words) >= CLAUSE_WORDS or odd > 1):
            masked = [NAME if w in names else w for w in words]
            found.append((len(plain) - 1, " ".join(w for i, w in enumerate(masked) if w != NAME or masked[i - 1 : i] != [NAME])))
        opening = opening and not plain[-1]
    beside = sum(plain)
    free = total > 0 and strange >= FREE_SHARE * total
    return [(clause, beside > plain[i]) for i, clause in found], free


_WORD = re.compile(r"[^\W\d_]+")
_INSIDE = re.compile(r"[^\W_A-Z],? ([^\W\d_]+)")


def word_counts(texts: Iterator[str]) -> tuple[Counter, Counter, Counter]:
    """Texts that hold each word, that hold it in small letters, and that hold it capitalised inside a sentence."""
    held, lower, capital = Counter(), Counter(), Counter()
    for text in texts:
        words = set(_WORD.findall(text))
        held.update({w.lower() for w in words})
        lower.update(w for w in words if w[0].islower())
        capital.update({w.lower() for w in _INSIDE.findall(text) if len(w) > 1 and w[0].isupper()})
    return held, lower, capital


def sound_words(texts: DataFrame, text_col: str) -> DataFrame:
    """word, df, lower, capital: texts that hold a word, hold it in small letters, hold it capitalised inside a sentence.

    Only words in two texts and with at least one in ``KNOWN_OF`` of all pairs of text and word, so there are never more
    than ``KNOWN_OF``, whatever the corpus. Counts of a batch are combined before the shuffle.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held, lower, capital = word_counts(t for t in frame.iloc[:, 0] if isinstance(t, str))
            words = list(held)
            yield pd.DataFrame(
                {
                    "word": pd.Series(words, dtype=object),
                    "df": np.array([held[w] for w in words], dtype=np.int64),
                    "lower": np.array([lower[w] for w in words], dtype=np.int64),
                    "capital": np.array([capital[w] for w in words], dtype=np.int64),
                }
            )

    some = spread(texts.where(F.col(text_col).isNotNull()).select(text_col), text_col)
    # read for the total and for the words
    counted = cut(
        some.mapInPandas(run, "word string, df long, lower long, capital long")
        .groupBy("word")
        .agg(*(F.sum(c).alias(c) for c in ("df", "lower", "capital")))
    )
    total = counted.agg(F.sum("df").alias("pairs"))
    return (
        counted.where(F.col("df") >= 2)
        .crossJoin(F.broadcast(total))  # one row
        .where(F.col("df") * F.lit(KNOWN_OF) >= F.col("pairs"))
        .drop("pairs")
    )


def template_clauses(openings: DataFrame) -> DataFrame:
    """clause, root, prompts: clauses of openings (clause, prompt), their cluster and the unrelated prompts it recurs under.

    Clauses are clustered by MinHash over shingles of five words (a shorter clause is one shingle): distinct clauses
    that share a band are compared, and those with a Jaccard similarity of at least 0.8 are linked; clusters are the
    connected components of all links. Clauses of one shingle have no near ones, so only long clauses enter the bands.
    """
    distinct = openings.distinct()
    words = F.split("clause", " ")
    long = distinct.select("clause").distinct().where(F.size(words) > SHINGLE)
    shingles = F.transform(
        F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda i: F.array_join(F.slice(words, i, SHINGLE), " ")
    )
    held = long.withColumn("sh", F.array_distinct(shingles))
    least = [F.array_min(F.transform("sh", lambda s, k=k: F.xxhash64(s, F.lit(k)))) for k in range(BANDS * ROWS)]
    banded = held.withColumn("sig", F.array(*least)).select(
        "clause", "sh", F.posexplode(F.array(*(F.xxhash64(F.slice("sig", b * ROWS + 1, ROWS)) for b in range(BANDS)))).alias("band", "h")
    )
    # a bucket of one clause, as nearly all are, has no link
    several = banded.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "h")
    shared = banded.join(several, ["band", "h"])
    other = shared.select("band", "h", F.col("clause").alias("b"), F.col("sh").alias("sh_b"))
    both = F.size(F.array_intersect("sh", "sh_b"))
    links = cut(
        shared.join(other, ["band", "h"])
        .where((F.col("clause") != F.col("b")) & (both / (F.size("sh") + F.size("sh_b") - both) >= SIMILAR))
        .select(F.col("clause").alias("a"), "b")
        .distinct()
    )
    every = distinct.select("clause").distinct()
    roots = every.withColumn("root", F.col("clause"))
    if not links.isEmpty():
        labels = components(links).select(F.col("node").alias("clause"), F.col("label").alias("root"))
        roots = every.join(labels, "clause", "left").withColumn("root", F.coalesce("root", "clause"))
    support = (
        distinct.join(roots, "clause").select("root", "prompt").distinct().groupBy("root").agg(F.count(F.lit(1)).alias("prompts"))
    )
    return roots.join(support, "root").select("clause", "root", "prompts")


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node that each node of ``links`` (a, b, given both ways) is connected with.

    Least labels spread along the links, and each node also takes the label of its label, until nothing changes.
    """
    labels = cut(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    for _ in itertools.count():
        near = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        grown = cut(
            labels.join(near, "node")
            .join(far, "label", "left")
            .select("node", F.least("label", "near", "far").alias("label"), F.col("label").alias("before"))
        )
        if grown.where("label <> before").isEmpty():
            return grown.select("node", "label")
        labels = grown.select("node", "label")


def refusal_templates(openings: DataFrame) -> DataFrame:
    """clause, covers, pure: recurring clauses of openings (prompt, clause, mixed, free).

    Clauses recur in responses free of content under at least three prompts. ``covers`` marks those that say the book does not
    cover the matter, which is no refusal: answers go on to content after them, refusals do not; where prompts are
    few, a clause that names the source is one. ``pure`` marks clauses that hardly ever stand beside content. Clauses
    that mostly do, like an apology before an answer, are left out.
    """
    # read twice, and few
    found = cut(template_clauses(openings.where("free").select("clause", "prompt")).where(F.col("prompts") >= TEMPLATE_PROMPTS))
    mixed = (
        openings.where("mixed")
        .join(found.select("clause", "root"), "clause")
        .groupBy("root")
        .agg(F.count_distinct("prompt").alias("mixed"))
    )
    words = F.split("root", " ")
    slot = F.array_contains(words, NAME)
    source = F.arrays_overlap(words, F.array(*map(F.lit, SOURCE_WORDS)))
    beside = F.coalesce("mixed", F.lit(0)) / F.col("prompts")
    return (
        found.join(mixed, "root", "left")
        .select(
            "clause",
            (((slot | source) & (beside > MIXED_SLOT)) | (source & (F.col("prompts") < SURE_PROMPTS))).alias("covers"),
            (beside <= MIXED_SLOT).alias("pure"),
            beside.alias("beside"),
        )
        .where(F.col("covers") | (F.col("beside") <= MIXED))
        .drop("beside")
    )


def pair_defects(
    responses: DataFrame,
    fields: dict[str, bool],
    sound: DataFrame,
    sound_col: str,
    model: ByteNet,
    votes: WordVotes,
    id_col: str,
) -> DataFrame:
    """id, field, defect: at most one row for each field of ``responses`` (id, prompt, the fields).

    ``fields`` says for each field whether it is required and must be complete (an answer) or may be null and cut short (a
    summary). The checks, in order: ``empty``; ``echo``; ``refusal``, a response whose opening has a template that recurs
    under at least three prompts and none that says the book does not cover the matter; templates are collected from
    responses free of content and looked up in all, where content follows only those that hardly ever stand beside
    it; ``truncated``, required fields only; ``wrong_language``, where prompt and response both have a sure language.
    A null prompt has no echo and no language. Repeated rows of ``responses`` give repeated rows. Known words come
    from ``sound``; there are at most ``KNOWN_OF`` of them, so they are broadcast.
    """
    spark = responses.sparkSession
    words = sound_words(sound, sound_col).collect()
    known = frozenset(r["word"] for r in words)
    names = frozenset(r["word"] for r in words if r["capital"] >= 0.3 * r["df"] and r["lower"] * 20 < r["capital"])
    shipped = spark.sparkContext.broadcast((known, names, model, votes))
    kind = responses.schema[id_col].dataType.simpleString()
    optional = [f for f, required in fields.items() if not required]
    rows = responses.select(
        id_col,
        "prompt",
        F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("x"),
    ).select(id_col, "prompt", "x.field", "x.value")
    rows = rows.where(F.col("value").isNotNull() | ~F.col("field").isin(optional))

    def inspect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, names, net, votes = shipped.value
        for frame in frames:
            n = len(frame)
            defect: list[str | None] = [None] * n
            clauses: list[list[tuple[str, bool]]] = [[] for _ in range(n)]
            free = [False] * n
            prompts = [p if isinstance(p, str) else None for p in frame["prompt"]]
            values = [v if isinstance(v, str) else None for v in frame["value"]]
            rest = []
            for i, (prompt, value, field) in enumerate(zip(prompts, values, frame["field"], strict=True)):
                if is_empty(value):
                    defect[i] = "empty"
                elif is_echo(value, prompt):
                    defect[i] = "echo"
                else:
                    clauses[i], free[i] = clauses_of(value, known, names)
                    if fields[field] and is_truncated(value):
                        defect[i] = "truncated"
                    else:
                        rest.append(i)
            spoken = languages_of([values[i] for i in rest], net, votes, names)
            asked = dict(zip(dict.fromkeys(prompts), languages_of([p or "" for p in dict.fromkeys(prompts)], net, votes, names), strict=True))
            for i, mine in zip(rest, spoken, strict=True):
                theirs = asked[prompts[i]]
                if mine and theirs and mine != theirs:
                    defect[i] = "wrong_language"
            keep = [i for i in range(n) if defect[i] or clauses[i]]
            yield pd.DataFrame(
                {
                    id_col: frame[id_col].iloc[keep].to_numpy(),
                    "field": frame["field"].iloc[keep].to_numpy(),
                    "prompt": pd.Series([bare(prompts[i] or "") for i in keep], dtype=object),
                    "defect": pd.Series([defect[i] for i in keep], dtype=object),
                    "free": [free[i] for i in keep],
                    "clauses": pd.Series([[c for c, _ in clauses[i]] for i in keep], dtype=object),
                    "mixed": pd.Series([[m for _, m in clauses[i]] for i in keep], dtype=object),
                }
            )

    seen = cut(
        spread_rows(rows, id_col).mapInPandas(
            inspect,
            f"`{id_col}` {kind}, field string, prompt string, defect string, free boolean, clauses array<string>, mixed array<boolean>",
        )
    )
    tagged = seen.withColumn("row", F.monotonically_increasing_id())
    openings = tagged.select("row", "prompt", "free", F.inline(F.arrays_zip(F.col("clauses").alias("clause"), "mixed")))
    refused = (
        openings.join(refusal_templates(openings), "clause")
        .where("free or not mixed or pure or covers")
        .groupBy("row")
        .agg(F.bool_or("covers").alias("covers"))
        .where("not covers")
        .select("row", F.lit(True).alias("refused"))
    )
    final = F.when(F.col("refused"), "refusal").otherwise(F.col("defect"))
    return (
        tagged.join(refused, "row", "left").select(id_col, "field", final.alias("defect")).where("defect is not null")
    )


def languages_of(texts: list[str], net: ByteNet, votes: WordVotes, names: frozenset[str]) -> list[str | None]:
    """The sure language of each text, null where there is none: network and words together, without names."""
    clean = [" ".join(w for w in letters(t).split() if w not in names) for t in texts]
    scores = net.scores(clean)
    at = [net.labels.index(lang) for lang in votes.labels]
    found: list[str | None] = []
    for text, own in zip(clean, scores, strict=True):
        both = own[at] + votes.score(text)
        order = np.argsort(-both)
        lead = both[order[0]] - both[order[1]] if len(order) > 1 else LEAD
        silent = NEUTRAL in net.labels and net.labels[int(own.argmax())] == NEUTRAL and not any(w in votes.votes for w in text.split())
        found.append(votes.labels[order[0]] if text and not silent and lead >= LEAD else None)
    return found
