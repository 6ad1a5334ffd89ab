"""Compressed sets of 16-bit numbers: a sorted list, runs or a bit field, whichever is smallest."""

from __future__ import annotations

import numpy as np

LIST, RUNS, BITS = b"\x00", b"\x01", b"\x02"
_BITS_SIZE = 8192


def encode(low: np.ndarray) -> bytes:
    """Bytes of a sorted array of distinct uint16."""
    n = len(low)
    if n > 8:
        breaks = np.flatnonzero(np.diff(low.astype(np.int32)) != 1)
        if 4 * (len(breaks) + 1) < min(2 * n, _BITS_SIZE):
            first = low[np.concatenate(([0], breaks + 1))]
            last = low[np.concatenate((breaks, [n - 1]))]
            return RUNS + np.stack([first, last], 1).astype("<u2").tobytes()
    if 2 * n <= _BITS_SIZE:
        return LIST + low.astype("<u2").tobytes()
    field = np.zeros(1 << 16, dtype=np.uint8)
    field[low] = 1
    return BITS + np.packbits(field).tobytes()


def decode(raw: bytes) -> np.ndarray:
    """The sorted numbers of ``encode``."""
    kind, body = raw[:1], raw[1:]
    if kind == LIST:
        return np.frombuffer(body, dtype="<u2")
    if kind == RUNS:
        runs = np.frombuffer(body, dtype="<u2").reshape(-1, 2).astype(np.int64)
        return np.concatenate([np.arange(a, b + 1) for a, b in runs]).astype(np.uint16)
    return np.flatnonzero(np.unpackbits(np.frombuffer(body, dtype=np.uint8))).astype(np.uint16)


def union(raws: list[bytes]) -> tuple[bytes, int]:
    """The union of sets and its cardinality."""
    if len(raws) == 1:
        return raws[0], cardinality(raws[0])
    low = np.unique(np.concatenate([decode(r) for r in raws]))
    return encode(low), len(low)


def cardinality(raw: bytes) -> int:
    """Number of members."""
    kind, body = raw[:1], raw[1:]
    if kind == LIST:
        return len(body) // 2
    if kind == RUNS:
        runs = np.frombuffer(body, dtype="<u2").reshape(-1, 2).astype(np.int64)
        return int((runs[:, 1] - runs[:, 0] + 1).sum())
    return int(np.unpackbits(np.frombuffer(body, dtype=np.uint8)).sum())
