"""Byte-pair encoding by prefix dynamic programming.

For every prefix of a byte string the byte-pair encoding has exactly one last token, so the encoding is a chain of
"last tokens". ``PrefixChain`` stores that chain: appending bytes extends it without touching what is there, cutting
it back is free, and the tokens of any prefix are read by walking back. ``Encoder`` adds the pre-splitting pattern of
byte-level vocabularies and re-encodes only the neighbourhood of an edit.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import regex

# fixed value: the pre-splitting pattern published with the byte-level vocabularies
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NO_LIMIT = 1 << 62


def read_ranks(raw: bytes) -> list[bytes]:
    """Token bytes by id from a rank file: a base64 token and its id on each line."""
    pairs = [line.split() for line in raw.splitlines() if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Vocabulary:
    """Ids, the merge that makes each token, and which tokens may follow each other.

    The merge of a token is found while the table grows: the chain over its bytes under the earlier tokens alone
    ends in exactly two parts.
    """

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        # by last byte first, so that all tokens that end at a place are met on one walk back
        self._ending: dict = {}
        for i, token in enumerate(tokens):
            if len(token) > 1:
                chain = PrefixChain(self)
                chain.append(token)
                parts = chain.ids()
                if len(parts) != 2:
                    raise ValueError(f"token {i} is not made of two earlier ones")
                self.parts[i] = (parts[0], parts[1])
                self.merged[parts[0], parts[1]] = i
                self._fits.clear()
            node = self._ending
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = i

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is just these two tokens.

        It is, unless some merge across the seam comes earlier than the merges inside; these are undone from the
        latest back, and at each step the pair that then meets at the seam is looked up.
        """
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            known = self._fits[key] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        before = _NO_LIMIT
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < before:
                return False
            if left > right:
                before = left
                if left not in self.parts:
                    return True
                left = self.parts[left][1]
            else:
                before = right + 1  # of equal merges the one further left comes first
                if right not in self.parts:
                    return True
                right = self.parts[right][0]


class PrefixChain:
    """Last token of every prefix of a growing byte string."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self._v = vocabulary
        self._bytes = bytearray()
        self._last: list[int] = []

    def __len__(self) -> int:
        return len(self._bytes)

    def append(self, more: bytes) -> PrefixChain:
        """Extends the string; the chain so far stays as it is."""
        v, data, last = self._v, self._bytes, self._last
        start = len(data)
        data.extend(more)
        for end in range(start, len(data)):
            node, at, found = v._ending, end, -1
            while at >= 0:
                node = node.get(data[at])
                if node is None:
                    break
                token = node.get(-1)
                if token is not None and (at == 0 or v.fits(last[at - 1], token)):
                    found = token
                    break
                at -= 1
            if found < 0:
                raise ValueError(f"no token ends at byte {end}")
            last.append(found)
        return self

    def cut(self, length: int) -> PrefixChain:
        """Goes back to the first ``length`` bytes."""
        del self._bytes[length:]
        del self._last[length:]
        return self

    def ids(self, length: int | None = None) -> list[int]:
        """Tokens of the first ``length`` bytes, of all by default."""
        at = len(self._last) if length is None else length
        found = []
        while at > 0:
            token = self._last[at - 1]
            found.append(token)
            at -= len(self._v.tokens[token])
        found.reverse()
        return found


class Encoder:
    """Texts to ids; the ids of each distinct piece are kept, up to ``keep`` pieces."""

    def __init__(self, vocabulary: Vocabulary, keep: int = 300_000) -> None:
        self.vocabulary = vocabulary
        self._split = regex.compile(PATTERN).findall
        self._keep = keep
        self._known: dict[str, tuple[int, ...]] = {}

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = tuple(PrefixChain(self.vocabulary).append(piece.encode()).ids())
        if len(piece) <= 64:
            if len(self._known) >= self._keep:
                self._known.clear()
            self._known[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text`` as it is; of null and of the empty text none."""
        found: list[int] = []
        if text:
            known, more = self._known.get, found.extend
            for piece in self._split(text):
                more(known(piece) or self._piece(piece))
        return found

    def count(self, text: str | None) -> int:
        """Number of ids of ``text``."""
        if not text:
            return 0
        known = self._known.get
        return sum(len(known(p) or self._piece(p)) for p in self._split(text))

    def decode(self, ids: Iterable[int]) -> bytes:
        """Bytes of the tokens."""
        return b"".join(self.vocabulary.tokens[i] for i in ids)

    def edit(self, text: str, ids: list[int], start: int, end: int, new: str) -> tuple[str, list[int]]:
        """The text with characters ``start`` to ``end`` replaced by ``new``, and its ids.

        Pieces that end before the edit keep their ids. Re-encoding goes on only until a piece starts where one
        started before the edit, for from there on the pattern splits alike.
        """
        after = text[:start] + new + text[end:]
        shift = len(new) - (end - start)
        old_starts, at, n = {}, 0, 0
        keep_chars = keep_ids = 0
        for piece in self._split(text):
            old_starts[at] = n
            size = len(self._known.get(piece) or self._piece(piece))
            # a piece may change if the edit touches it or the one character the pattern looks ahead
            if at + len(piece) + 1 < start:
                keep_chars, keep_ids = at + len(piece), n + size
            at += len(piece)
            n += size
        found = ids[:keep_ids]
        for m in regex.compile(PATTERN).finditer(after, keep_chars):
            old = m.start() - shift
            if m.start() >= start + len(new) + 1 and old in old_starts and old > end:
                return after, found + ids[old_starts[old] :]
            found.extend(self._known.get(m.group()) or self._piece(m.group()))
        return after, found
