"""Languages of documents and of their parts, and labels that are missing or wrong."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.bytecnn import NEUTRAL, ByteNet, NetParams, letters, without_accents
from lorekeep.llm.spread import spread

# the classifier is fitted on at most so many labelled rows
MAX_SAMPLES = 5_000
# what it costs, in log-probability, that the language changes from one sentence to the next
SWITCH = 2.0
_FLOOR = -7.0

# fixed values: ISO 639 codes and names of the languages, in English and in the language itself
NAMES = {
    "en": "en eng english anglais englisch inglés inglese",
    "de": "de deu ger german deutsch allemand alemán",
    "fr": "fr fra fre french français francais französisch francés",
    "es": "es spa spanish español espanol castellano castilian spanisch",
    "it": "it ita italian italiano italienisch",
    "pt": "pt por portuguese português portugues portugiesisch",
    "nl": "nl nld dut dutch nederlands niederländisch flemish vlaams",
    "pl": "pl pol polish polski polnisch",
    "ru": "ru rus russian русский russkij russisch",
    "ja": "ja jpn japanese 日本語 nihongo japanisch",
}
# fixed values: other languages, so that a label that names one is wrong rather than missing
OTHERS = (
    "ar ara arabic bg bul bulgarian ca cat catalan cs ces cze czech cy welsh da dan danish el ell greek et est estonian "
    "eu basque fa fas persian fi fin finnish ga irish gl galician he heb hebrew hi hin hindi hr hrv croatian hu hun "
    "hungarian id ind indonesian is isl icelandic ko kor korean la lat latin lt lit lithuanian lv lav latvian ms malay "
    "nb nn no nor norwegian ro ron rum romanian sk slk slovak sl slv slovenian sr srp serbian sv swe swedish svenska th "
    "tha thai tr tur turkish uk ukr ukrainian vi vie vietnamese zh zho chi chinese"
)
_CODES = {name: code for code, names in NAMES.items() for name in names.split()}
_OTHER = frozenset(OTHERS.split())



def _kinds(*wanted: str) -> str:
    """A character class body of all characters of some Unicode categories."""
    return "".join(re.escape(chr(c)) for c in range(0x10000) if unicodedata.category(chr(c)) in wanted)


_SEGMENT = re.compile(
    rf"(?P<end>[.!?…]+[{_kinds('Pe', 'Pf', 'Pi')}\"'`´“„]*(?=\s|\Z)|[。！？]+[{_kinds('Pe', 'Pf')}\"']*)"
    r"|[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]+"
)
_QUOTED = regex.compile(r"\s*[\"'“”„«»‘’‹›「『(\[].*[\"'“”„«»‘’‹›」』)\]][.!?…。]*\s*\Z", regex.DOTALL)
_LETTER = re.compile(r"[^\W\d_]")
_QUOTES = "\"'“”„«»‘’‹›「『(["


def label_code(label: str | None) -> str | None:
    """The language a label names: a code of ``NAMES``, ``other``, or null where it names none.

    A code or name may be followed by a region, a script or an addition; behind a mere space a short code needs a region,
    for in "no label" it is a word.
    """
    if label is None:
        return None
    s = regex.sub(r"[\s\p{Cf}]+", " ", label).strip().lower()
    head, rest = regex.match(r"([^-_ (/,;.]*)(.*)", s, regex.DOTALL).groups()
    loose = len(head) < 4 and regex.match(r" (?![(\[]|\p{L}{2}\Z)", rest)
    for name in (s,) if loose else (s, head):
        if name in _CODES:
            return _CODES[name]
        if name in _OTHER:
            return "other"
    return None


def sentences(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether it is a whole sentence outside quotes) of the stretches of ``text`` with any letter.

    ``start`` is that of the first character that is not white space.
    """
    found, start = [], 0
    cuts = [(m.end(), m.group("end") is not None) for m in _SEGMENT.finditer(text)]
    for end, ended in [*cuts, (len(text), False)]:
        part = text[start:end]
        if _LETTER.search(part):
            bare = part.lstrip()
            quoted = bare[0] in _QUOTES and _QUOTED.match(bare)
            found.append((end - len(bare), end, ended and not quoted))
        start = end
    return found


def training_set(texts: list[str], labels: list[str]) -> tuple[list[str], list[str]]:
    """Sentences of the labelled texts, also as they look without accents, and neutral texts of invented names.

    A name is a word that occurs in texts of three languages or more, or a Latin word in a text of another script; new
    names are made of their halves.
    """
    x, y, seen = [], [], {}
    for text, label in zip(texts, labels, strict=True):
        for a, b, _ in sentences(text):
            clean = letters(text[a:b])
            if clean:
                x += [clean, without_accents(clean)]
                y += [label, label]
        x.append(letters(text))
        y.append(label)
        for word in regex.findall(r"\p{Lu}\p{L}{4,}", text):
            seen.setdefault(word.lower(), set()).add(label)
    foreign = {"ru", "ja"}
    names = sorted(w for w, langs in seen.items() if w.isascii() and (len(langs) > 2 or langs & foreign))
    rng = np.random.default_rng(5)

    def invented() -> str:
        a, b = names[rng.integers(len(names))], names[rng.integers(len(names))]
        return a if rng.random() < 0.3 else a[: len(a) // 2 // 2 * 2] + b[len(b) // 2 // 2 * 2 :]

    if names:
        # a sentence keeps its language whatever names stand in it
        for text, label in list(zip(x, y, strict=True)):
            words = text.split()
            if label not in foreign and len(words) > 4:
                words.insert(int(rng.integers(1, len(words))), invented())
                x.append(" ".join(words))
                y.append(label)
        for _ in range(max(200, len(x) // 12)):
            parts = [invented() for _ in range(int(rng.integers(1, 4)))]
            if rng.random() < 0.3:
                parts = [s for n in parts for s in (n, "d")]
            x.append(" ".join(parts))
            y.append(NEUTRAL)
    return x, y


class WordVotes:
    """Which language the words of a text speak for, learned from labelled texts; names in several languages say nothing."""

    def __init__(self, texts: list[str], labels: list[str]) -> None:
        self.labels = sorted(set(labels))
        seen = {lang: Counter() for lang in self.labels}
        for text, lang in zip(texts, labels, strict=True):
            seen[lang].update(letters(text).split())
        words = {w for c in seen.values() for w in c}
        total = {lang: sum(c.values()) + 0.1 * len(words) for lang, c in seen.items()}
        self.votes: dict[str, np.ndarray] = {}
        for w in words:
            v = np.array([np.log((seen[lang][w] + 0.1) / total[lang]) for lang in self.labels])
            self.votes[w] = np.maximum(v - v.max(), -4.0)

    def score(self, clean: str) -> np.ndarray:
        """Sum of the votes of the words of ``letters(text)``."""
        found = [self.votes[w] for w in clean.split() if w in self.votes]
        return np.sum(found, axis=0) if found else np.zeros(len(self.labels))


_FITTED: dict[str, ByteNet] = {}


def labelled_rows(samples: DataFrame, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """At most ``MAX_SAMPLES`` labelled rows, the first by hash."""
    rows = (
        samples.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
        .select(text_col, lang_col)
        .orderBy(F.xxhash64(text_col, lang_col), text_col, lang_col)
        .limit(MAX_SAMPLES)
        .collect()
    )
    return [(r[0], r[1]) for r in rows]


def fit_languages(samples: DataFrame, text_col: str = "text", lang_col: str = "lang", p: NetParams | None = None) -> ByteNet:
    """A network for the languages of at most ``MAX_SAMPLES`` labelled rows; equal rows are fitted once a process."""
    rows = labelled_rows(samples, text_col, lang_col)
    key = hashlib.sha256(repr((rows, p)).encode()).hexdigest()
    if key not in _FITTED:
        x, y = training_set([r[0] for r in rows], [r[1] for r in rows])
        _FITTED[key] = ByteNet(sorted(set(y)), p or NetParams()).fit(x, y)
    return _FITTED[key]


def fit_words(samples: DataFrame, text_col: str = "text", lang_col: str = "lang") -> WordVotes:
    """Word votes of at most ``MAX_SAMPLES`` labelled rows."""
    rows = labelled_rows(samples, text_col, lang_col)
    return WordVotes([r[0] for r in rows], [r[1] for r in rows])


def best_path(scores: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Label of each sentence: the most probable path where a change costs ``SWITCH``; unsure sentences follow."""
    n, m = scores.shape
    gain = np.where(sure[:, None], np.maximum(scores, _FLOOR), 0.0)
    best = gain[0].copy()
    back = np.zeros((n, m), dtype=np.int32)
    for i in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - SWITCH
        back[i] = np.where(stay, np.arange(m), top)
        best = np.where(stay, best, best[top] - SWITCH) + gain[i]
    path = np.zeros(n, dtype=np.int32)
    path[-1] = int(best.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i][path[i]]
    return path


def runs_of(texts: list[str], net: ByteNet) -> list[list[tuple]]:
    """(start, end, label, confidence) of the maximal runs in one language of each text; none where nothing has a language.

    The sentences of all texts are scored together. Where all sentences of a text are most likely in the same language the
    best path is that language; only other texts need the path itself.
    """
    parts = [sentences(t) for t in texts]
    flat = [p for ps in parts for p in ps]
    if not flat:
        return [[] for _ in texts]
    scores = net.scores([letters(t[a:b]) for t, ps in zip(texts, parts, strict=True) for a, b, _ in ps])
    langs = [j for j, name in enumerate(net.labels) if name != NEUTRAL]
    names = [net.labels[j] for j in langs]
    own = scores[:, langs]
    own = own - np.log(np.exp(own).sum(1, keepdims=True))
    if NEUTRAL in net.labels:
        voices = (scores.argmax(1) != net.labels.index(NEUTRAL)).tolist()
    else:
        voices = [True] * len(flat)
    best = own.argmax(1).tolist()
    found: list[list[tuple]] = []
    at = 0
    for ps in parts:
        lo, at = at, at + len(ps)
        sure = [i for i in range(lo, at) if voices[i] and flat[i][2]] or [i for i in range(lo, at) if voices[i]]
        if not sure:
            found.append([])
            continue
        path = best
        if any(best[i] != best[sure[0]] for i in sure):
            mask = np.zeros(at - lo, bool)
            mask[np.array(sure) - lo] = True
            path = dict(enumerate(best_path(own[lo:at], mask).tolist(), lo))
        runs: list[list] = []
        for i in sure:
            a, b, _ = flat[i]
            weight = (b - a, float(np.exp(own[i, path[i]])))
            if runs and runs[-1][2] == path[i]:
                runs[-1][1] = b
                runs[-1][3].append(weight)
            else:
                runs.append([a, b, path[i], [weight]])
        found.append(
            [(a, b, names[k], round(sum(n * c for n, c in w) / sum(n for n, _ in w), 6)) for a, b, k, w in runs]
        )
    return found


def main_language(runs: list[tuple]) -> tuple[str | None, float | None]:
    """The language with most characters and its confidence, the mean over its runs by length."""
    size: Counter = Counter()
    for a, b, lang, _ in runs:
        size[lang] += b - a
    if not size:
        return None, None
    main = min(size, key=lambda k: (-size[k], k))
    return main, sum((b - a) * c for a, b, lang, c in runs if lang == main) / size[main]


def language_runs(df: DataFrame, model: ByteNet, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """One row for each row of ``df``: id, ``keep``, main lang, confidence, runs array of (start, end, lang, confidence).

    The main language is the one with most characters; it, its confidence (the mean probability of its sentences, by
    length) and the runs are null or empty for a text without sentences: null, empty, blank, numbers or names only.
    Only whole sentences outside quotes make runs; where a text has none, its other lines do. Repeated rows stay
    repeated, null ids stay null. The network is broadcast: its size is fixed by its shape. Batches of sentences are
    scored together as windows of fixed length; one narrow pass, no shuffle unless there are fewer files than cores.
    """
    shipped = df.sparkSession.sparkContext.broadcast(model)
    names = [id_col, *keep]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + (
        ", main string, confidence double, runs array<struct<start:int,end:int,lang:string,confidence:double>>"
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shipped.value
        for frame in frames:
            for a in range(0, len(frame), 2000):
                part = frame.iloc[a : a + 2000]
                texts = [t if isinstance(t, str) else "" for t in part.iloc[:, len(names)]]
                runs = runs_of(texts, net)
                mains = [main_language(r) for r in runs]
                yield part.iloc[:, : len(names)].assign(
                    main=[m for m, _ in mains], confidence=[c for _, c in mains], runs=runs
                )

    return spread(df.select(*names, text_col), id_col).mapInPandas(run, schema)


def label_defects(runs: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """id, defect, seg_start, lang: labels that are missing or wrong, and each run of a text in several languages."""

    def codes(labels: pd.Series) -> pd.Series:
        found = {x: label_code(x) for x in labels.dropna().unique()}
        return pd.Series([found.get(x) for x in labels], dtype=object)

    code = F.pandas_udf(codes, "string")(F.col(label_col))
    # one pass: the defects of a row are gathered in an array, so the texts are read and scored once
    checked = runs.where("main is not null").withColumn("__code", code)
    shape = "array<struct<defect:string,seg_start:int,lang:string>>"

    def one(defect: Column, start: Column, lang: Column) -> Column:
        return F.struct(defect.alias("defect"), start.alias("seg_start"), lang.alias("lang"))

    named = F.when(F.col("__code").isNull(), "missing").otherwise("wrong")
    label = F.when(~F.col("__code").eqNullSafe(F.col("main")), F.array(one(named, F.lit(0), F.col("main"))))
    several = F.size(F.array_distinct(F.transform("runs", lambda r: r["lang"]))) > 1
    mixed = F.when(several, F.transform("runs", lambda r: one(F.lit("mixed"), r["start"], r["lang"])))
    none = F.array().cast(shape)
    found = F.concat(F.coalesce(label.cast(shape), none), F.coalesce(mixed.cast(shape), none))
    return checked.select(id_col, F.explode(found).alias("d")).select(id_col, "d.defect", "d.seg_start", "d.lang")
