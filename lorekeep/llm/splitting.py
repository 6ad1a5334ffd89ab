"""Splitting oversized texts at natural boundaries by agglomerative merging."""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# what may close a sentence after its end mark: every closing bracket and every quotation mark
_CLOSERS = r"[\p{Pe}\p{Pf}\p{Pi}\"'`´＂＇“„]*"
_BOUNDARY = regex.compile(
    rf"(?P<line>\r\n|[\n\r\v\f\x1c-\x1e\x85\u2028\u2029])|[.!?…]{_CLOSERS}(?=\s|\Z)|[。！？]"
)
# strength of the boundary after a segment: the weakest goes first
FORCED, WORD, SENTENCE, LINE, PARAGRAPH = range(5)


def segments(text: str, limit: int, room: int) -> tuple[list[tuple[int, int, int]], int]:
    """Atomic segments (start, end, strength of the boundary at the end), and the longest natural stretch.

    Stretches longer than ``limit`` are cut into parts of at most ``room``, at white space, else anywhere, never before a
    combining mark or joiner; shorter ones stay whole.
    """
    marks: list[tuple[int, int]] = []
    for m in _BOUNDARY.finditer(text):
        at = m.end()
        if m.group("line") is None:
            marks.append((at, SENTENCE))
        elif marks and marks[-1][1] >= LINE and not text[marks[-1][0] : m.start()].strip():
            marks.append((at, PARAGRAPH))
        else:
            marks.append((at, LINE))
    if not marks or marks[-1][0] < len(text):
        marks.append((len(text), PARAGRAPH))
    found, start, longest = [], 0, 0
    for end, strength in marks:
        longest = max(longest, end - start)
        long = end - start > limit
        while long and end - start > room:
            at, kind = _forced(text, start, start + room)
            found.append((start, at, kind))
            start = at
        if end > start:
            found.append((start, end, strength))
        start = end
    return found, longest


def _forced(text: str, start: int, most: int) -> tuple[int, int]:
    for at in range(most, start + (most - start) // 2, -1):
        if text[at - 1].isspace():
            return at, WORD
    at = most
    while at > start + 1 and (unicodedata.combining(text[at]) or text[at] in "\u200d\ufe0f" or text[at - 1] == "\u200d"):
        at -= 1
    return (at if at > start + 1 else most), FORCED


def merge(parts: list[tuple[int, int, int]], room: int) -> list[tuple[int, int, int]]:
    """Joins neighbours over the weakest boundary first while the result is at most ``room`` long.

    Boundaries of equal strength go by the smaller joined size, then by place, so the result is always the same.
    """
    n = len(parts)
    start = [p[0] for p in parts]
    end = [p[1] for p in parts]
    strength = [p[2] for p in parts]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and end[j] - start[i] <= room:
            heapq.heappush(heap, (strength[i], end[j] - start[i], i, j))

    for i in range(n):
        offer(i)
    while heap:
        power, size, i, j = heapq.heappop(heap)
        if not alive[i] or after[i] != j or end[j] - start[i] != size or strength[i] != power:
            continue
        alive[j] = False
        end[i], strength[i], after[i] = end[j], strength[j], after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [(start[i], end[i], strength[i]) for i in range(n) if alive[i]]


def split_text(text: str, limit: int = 2000, overlap: int = 200) -> tuple[list[tuple[int, int, int, bool]], bool]:
    """Pieces (start, start of the new part, end, ends naturally) of at most ``limit``, and whether all cuts are natural.

    Each piece after the first begins about ``overlap`` characters back, at the start of a word where one is near. A
    natural stretch that nearly fills a piece leaves less room, and the overlap shrinks to it.
    """
    room = limit if len(text) <= limit else limit - overlap
    # a natural stretch that fits a piece only alone stays whole: its overlap shrinks instead
    parts, longest = segments(text, limit, room)
    pieces = []
    for k, (start, end, strength) in enumerate(merge(parts, room)):
        back = 0 if k == 0 else min(overlap, limit - (end - start), start)
        pieces.append((_overlap_start(text, start, back), start, end, strength >= SENTENCE))
    return pieces, longest <= limit


def _overlap_start(text: str, start: int, back: int) -> int:
    if back <= 0:
        return start
    at = start - back
    for k in range(at, min(start, at + back // 4)):
        if k == 0 or text[k - 1].isspace() and not text[k].isspace():
            return k
    while at < start and unicodedata.combining(text[at]):
        at += 1
    return at


_PIECE = T.StructType(
    [
        T.StructField("piece_no", T.IntegerType(), False),
        T.StructField("start", T.IntegerType(), False),
        T.StructField("new_start", T.IntegerType(), False),
        T.StructField("end", T.IntegerType(), False),
        T.StructField("natural_end", T.BooleanType(), False),
        T.StructField("piece", T.StringType(), False),
    ]
)


def split_oversized(
    df: DataFrame, id_cols: list[str], text_col: str, limit: int = 2000, overlap: int = 200
) -> DataFrame:
    """One row for each row of ``df`` whose text has more than ``limit`` code points: ids, ``cut``, ``pieces``.

    ``cut`` is ``natural`` if no stretch between natural boundaries is longer than ``limit``, else ``forced``.
    ``pieces`` is an array of (piece_no, start, new_start, end, natural_end, piece): ``piece`` is the text from
    ``start`` to ``end``, of which all before ``new_start`` repeats the piece before; the parts from ``new_start`` to
    ``end`` make up the text exactly. Null, empty and short texts are no oversized items and give no row; repeated
    rows stay repeated, null ids stay null, other columns are not read. The length filter runs before Python starts.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    ids = [df.schema[c] for c in id_cols]
    out = T.StructType([*ids, T.StructField("cut", T.StringType(), False), T.StructField("pieces", T.ArrayType(_PIECE, False), False)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cuts, pieces = [], []
            for text in frame.iloc[:, len(id_cols)]:
                found, natural = split_text(text, limit, overlap)
                cuts.append("natural" if natural else "forced")
                pieces.append([(k, a, b, c, ok, text[a:c]) for k, (a, b, c, ok) in enumerate(found)])
            yield frame.iloc[:, : len(id_cols)].assign(
                cut=pd.Series(cuts, index=frame.index, dtype=object), pieces=pd.Series(pieces, index=frame.index, dtype=object)
            )

    return df.where(F.length(text_col) > limit).select(*id_cols, text_col).mapInPandas(run, out)
