"""Narrowing a cited text to the part that supports an answer.

The best window is an arg-max over overlapping slices of each text; as nested expressions that would be evaluated many
times over, so the texts go through Arrow in batches.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.functions.text import ANSWER_STOP, RULE_PHRASES

# fixed values: what follows a block of rules, and the sizes of windows and blocks
STOPS = (r"\bThe Environment\b", r"\.\s+Objects\b", r"\nObjects\b", r"\nObstacles\b")
WINDOW, STEP, SHORT, CAP = 460, 48, 420, 960

_STOPS = [re.compile(p, re.ASCII) for p in STOPS]
_RULES = re.compile(rf"\b(?:{'|'.join(RULE_PHRASES)})\b", re.IGNORECASE | re.ASCII)
_HEADING = re.compile(r"\bMultiple Afflictions\b", re.IGNORECASE | re.ASCII)
_WORD = re.compile(r"[a-z0-9']+")
_TOKEN = re.compile(r"[a-z0-9_]+")
_STOP_WORDS = frozenset(ANSWER_STOP)


class _Clause:
    """A part of an answer, ready to be held against many windows."""

    def __init__(self, text: str) -> None:
        words = _WORD.findall(text.lower())
        terms = [t for t in dict.fromkeys(w.strip("'") for w in words) if len(t) >= 4 and t not in _STOP_WORDS]
        self.count = len(terms)
        self.plain = frozenset(t for t in terms if "'" not in t)
        self.quoted = [re.compile(rf"(?<![a-z0-9_]){re.escape(t)}(?![a-z0-9_])") for t in terms if "'" in t]
        self.pairs = [p for p in map(" ".join, zip(words, words[1:], strict=False)) if len(p) >= 8]
        self.ruled = bool(_RULES.search(text))

    def support(self, low: str, tokens: set[str] | None = None, ruled: bool | None = None) -> float:
        tokens = set(_TOKEN.findall(low)) if tokens is None else tokens
        hits = len(self.plain & tokens) + sum(bool(t.search(low)) for t in self.quoted)
        score = 6 * hits / self.count if self.count else 0.0
        if self.ruled and (bool(_RULES.search(low)) if ruled is None else ruled):
            score += 4
        return score + min(1.1 * sum(p in low for p in self.pairs), 4)


@functools.lru_cache(maxsize=1024)
def _clauses(answer: str) -> tuple[_Clause, ...]:
    parts = [p.strip() for p in re.split(r"(?<=[.!?])\s+", answer)]
    return tuple(_Clause(p) for p in [p for p in parts if len(p) > 28] or [answer])


def _best(parts: tuple[_Clause, ...], low: str) -> float:
    tokens = set(_TOKEN.findall(low))
    ruled = bool(_RULES.search(low)) if any(c.ruled for c in parts) else False
    return max(c.support(low, tokens, ruled) for c in parts)


def support(answer: str | None, snippet: str | None) -> float | None:
    """The greatest support that a snippet gives any clause of an answer; null where either is null."""
    if answer is None or snippet is None:
        return None
    return float(max(_best(_clauses(answer), snippet.lower()), 0.0))


def supported(answer: Column, snippet: Column) -> Column:
    """``support`` as a column."""

    def run(answers: pd.Series, snippets: pd.Series) -> pd.Series:
        return pd.Series([support(a, s) for a, s in zip(answers, snippets, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(answer, snippet)


def _block(body: str, start: int, stop_from: int, least: int) -> str | None:
    tail = body[start:]
    ends = [m.start() for m in (s.search(tail) for s in _STOPS) if m and m.start() >= stop_from]
    block = tail[: min(ends, default=len(tail))].strip()
    return block if len(block) >= least else None


def rule_block(body: str) -> str | None:
    """The block from its heading, else from its first rule phrase, to the next section."""
    for pattern, stop_from, least in ((_HEADING, 120, 80), (_RULES, 80, 60)):
        m = pattern.search(body)
        found = _block(body, m.start(), stop_from, least) if m else None
        if found:
            return found
    return None


def best_window(body: str, answer: str) -> str:
    """The window that best supports the answer, the first of equal ones, with margins snapped to spaces."""
    if len(body) <= WINDOW + 120:
        return body
    parts, low = _clauses(answer), body.lower()
    at = max(range(0, len(body) - WINDOW + 1, STEP), key=lambda i: (_best(parts, low[i : i + WINDOW]), -i))
    lo, hi = max(0, at - 32), min(len(body), at + WINDOW + 72)
    if lo > 0 and (gap := body.rfind(" ", 0, lo + 49)) > lo - 48:
        lo = gap + 1
    if hi < len(body):
        gap = body.find(" ", max(at + WINDOW - 48, hi - 96))
        if at <= gap < hi:
            hi = min(hi, gap + 96)
    return body[lo:hi]


def capped(text: str, most: int = CAP) -> str:
    """At most ``most`` characters, ended at a sentence, else at a space, with an ellipsis."""
    if len(text) <= most:
        return text
    head = text[:most]
    stop, gap = max(head.rfind("."), head.rfind("!")), head.rfind(" ")
    if stop >= most * 0.5:
        head = head[: stop + 1]
    elif gap >= most * 0.6:
        head = head[:gap]
    return head.strip() + "…"


def focus(body: str | None, answer: str | None) -> str | None:
    """The part of a cited text to show beside an answer; null stays null, short texts and blank answers leave it whole."""
    if body is None:
        return None
    body, answer = body.strip(), (answer or "").strip()
    if not answer or len(body) < SHORT:
        return body
    block = rule_block(body)
    if block and 80 <= len(block) <= len(body) * 0.98:
        return capped(block)
    window = best_window(body, answer)
    return body if window == body else capped(window.strip())


def focused(body: Column, answer: Column) -> Column:
    """``focus`` as a column."""

    def run(bodies: pd.Series, answers: pd.Series) -> pd.Series:
        return pd.Series([focus(b, a) for b, a in zip(bodies, answers, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(body, answer)
