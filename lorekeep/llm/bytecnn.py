"""A byte convolutional network: filters of several widths, max pooling, softmax. Trained and applied in numpy."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd

NEUTRAL = ""


class _Folded(dict):
    """What each character becomes: small letters and apostrophes stay, marks and invisible signs go, the rest is a gap."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        kind = unicodedata.category(c)
        found: str | None = " "
        if kind in ("Cf", "Mn", "Cc"):
            found = None
        elif kind[0] == "L":
            found = c.lower()
        elif c in "'’":
            found = "'"
        self[code] = found
        return found


_FOLDED = _Folded()


@dataclass(frozen=True)
class NetParams:
    """Shape and training of the network."""

    window: int = 96
    stride: int = 72
    widths: tuple[int, ...] = (2, 3, 4, 5)
    filters: int = 20
    dims: int = 12
    steps: int = 500
    batch: int = 96
    rate: float = 0.004
    seed: int = 11


def letters(text: str) -> str:
    """Lower-case letters and single spaces: digits, signs, marks of combination and invisible characters go."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return " ".join(text.translate(_FOLDED).split())


def without_accents(text: str) -> str:
    """``text`` as it looks when its accents were lost."""
    plain = (c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) not in ("Cf", "Mn", "Cc"))
    return unicodedata.normalize("NFC", "".join(plain))


def windows(texts: list[str], p: NetParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte windows, how many bytes each holds, and the text each belongs to; every text has at least one.

    Rows are padded with zeros and have room for the widest filter to start at the last byte.
    """
    rows, size, owner = [], [], []
    full = p.window + max(p.widths) - 1
    for i, text in enumerate(texts):
        raw = b" " + text.encode() + b" "
        at = 0
        while True:
            part = raw[at : at + p.window]
            rows.append(part.ljust(full, b"\0"))
            size.append(len(part))
            owner.append(i)
            if at + p.window >= len(raw):
                break
            at += p.stride
    x = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, full)
    return x, np.array(size, dtype=np.int64), np.array(owner, dtype=np.int64)


class ByteNet:
    """The trained network; ``labels`` may hold ``NEUTRAL`` for text without a language."""

    def __init__(self, labels: list[str], p: NetParams) -> None:
        rng = np.random.default_rng(p.seed)
        self.labels, self.p = labels, p
        n = len(p.widths) * p.filters
        self.w = {"e": rng.normal(0, 0.3, (256, p.dims)), "o": rng.normal(0, 0.1, (n, len(labels))), "c": np.zeros(len(labels))}
        for width in p.widths:
            self.w[f"k{width}"] = rng.normal(0, (width * p.dims) ** -0.5, (width * p.dims, p.filters))
            self.w[f"b{width}"] = np.zeros(p.filters)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self._tables: list[np.ndarray] | None = None

    def fit(self, texts: list[str], labels: list[str]) -> ByteNet:
        """Adam on cross-entropy over random crops of the texts, each class drawn equally often."""
        p, w = self.p, self.w
        rng = np.random.default_rng(p.seed + 1)
        raws = [b" " + t.encode() + b" " for t in texts]
        by_class = [[i for i, y in enumerate(labels) if y == c] for c in self.labels]
        by_class = [c for c in by_class if c]
        m = {k: np.zeros_like(v) for k, v in w.items()}
        v2 = {k: np.zeros_like(v) for k, v in w.items()}
        where = {c: j for j, c in enumerate(self.labels)}
        full = p.window + max(p.widths) - 1
        for step in range(1, p.steps + 1):
            picked = [c[rng.integers(len(c))] for c in (by_class[rng.integers(len(by_class))] for _ in range(p.batch))]
            rows = []
            for i in picked:
                raw = raws[i]
                size = int(rng.integers(min(20, len(raw)), min(p.window, len(raw)) + 1))
                at = int(rng.integers(0, len(raw) - size + 1))
                rows.append(raw[at : at + size].ljust(full, b"\0"))
            x = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, full)
            grads = self._grads(x, np.array([where[labels[i]] for i in picked]), rng)
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.999 * v2[k] + 0.001 * g * g
                rate = p.rate * (0.5 + 0.5 * np.cos(np.pi * step / p.steps)) + 1e-5
                w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def _grads(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
        p, w = self.p, self.w
        n = len(x)
        emb = w["e"][x]
        pooled, kept = [], []
        for width in p.widths:
            k = w[f"k{width}"]
            h = emb[:, : p.window] @ k[: p.dims]
            for j in range(1, width):
                h += emb[:, j : j + p.window] @ k[j * p.dims : (j + 1) * p.dims]
            at = h.argmax(1)
            top = np.take_along_axis(h, at[:, None, :], 1)[:, 0] + w[f"b{width}"]
            pooled.append(np.maximum(top, 0))
            kept.append((at, top > 0))
        f = np.concatenate(pooled, 1)
        drop = (rng.random(f.shape) > 0.2) / np.float32(0.8)
        z = (f * drop) @ w["o"] + w["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        d = z / z.sum(1, keepdims=True)
        d[np.arange(n), y] -= 1
        d /= n
        g = {"o": (f * drop).T @ d, "c": d.sum(0), "e": np.zeros_like(w["e"])}
        df = (d @ w["o"].T) * drop
        for j, width in enumerate(p.widths):
            at, on = kept[j]
            dp = df[:, j * p.filters : (j + 1) * p.filters] * on
            g[f"b{width}"] = dp.sum(0)
            rows = at[:, :, None] + np.arange(width)
            byte = x[np.arange(n)[:, None, None], rows]
            best = w["e"][byte].reshape(n, p.filters, width * p.dims)
            g[f"k{width}"] = np.einsum("nfc,nf->cf", best, dp)
            back = (dp[:, :, None] * w[f"k{width}"].T[None]).reshape(-1, p.dims)
            at_byte = byte.ravel()
            for c in range(p.dims):
                g["e"][:, c] += np.bincount(at_byte, weights=back[:, c], minlength=256).astype(np.float32)
        return g

    def _answers(self, grams: np.ndarray) -> np.ndarray:
        """What every filter answers to each row of bytes, as wide as the widest filter, that starts at its first byte."""
        p, w = self.p, self.w
        if self._tables is None:
            # a filter's answer to a byte at one of its places does not depend on the rest: it is looked up
            n = len(p.widths) * p.filters
            self._tables = [np.zeros((256, n), dtype=np.float32) for _ in range(max(p.widths))]
            for j, width in enumerate(p.widths):
                own = slice(j * p.filters, (j + 1) * p.filters)
                for k in range(width):
                    self._tables[k][:, own] = w["e"] @ w[f"k{width}"][k * p.dims : (k + 1) * p.dims]
        found = self._tables[0][grams[:, 0]]
        for k, table in enumerate(self._tables[1:], 1):
            found += table[grams[:, k]]
        return found

    def _window_scores(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Scores of windows. Each distinct run of bytes meets the filters once; pooling then only takes the greatest.

        Windows go through by length, so that the padding of a short one costs nothing: its answer is a constant.
        """
        p, w = self.p, self.w
        reach = max(p.widths)
        out = np.empty((len(x), len(self.labels)), dtype=np.float32)
        bias = np.concatenate([w[f"b{width}"] for width in p.widths])
        blank = self._answers(np.zeros((1, reach), dtype=np.uint8))[0]
        order = np.argsort(-size, kind="stable")
        for a in range(0, len(x), 4096):
            rows = order[a : a + 4096]
            part, left = x[rows], size[rows]
            most = int(left[0])
            code = np.zeros((len(rows), most), dtype=np.int64)
            for k in range(reach):
                code = (code << 8) | part[:, k : k + most]
            # by place, then by row, so that each step below reads one stretch
            inside = np.arange(most)[:, None] < left[None, :]
            ids, distinct = pd.factorize(code.T[inside])
            grams = (distinct[:, None] >> (8 * np.arange(reach - 1, -1, -1))) & 255
            table = self._answers(grams)
            alive = inside.sum(1)
            top = np.full((len(rows), table.shape[1]), -np.inf, dtype=np.float32)
            top[left < p.window] = blank
            step, at = np.empty_like(top), 0
            for n in alive.tolist():
                got = step[:n]
                np.take(table, ids[at : at + n], axis=0, out=got, mode="clip")
                np.maximum(top[:n], got, out=top[:n])
                at += n
            out[rows] = np.maximum(top + bias, 0) @ w["o"] + w["c"]
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log-probabilities (texts, labels); the windows of a long text are averaged."""
        if not texts:
            return np.zeros((0, len(self.labels)), dtype=np.float32)
        distinct = list(dict.fromkeys(texts))
        x, size, owner = windows(distinct, self.p)
        z = self._window_scores(x, size)
        z -= z.max(1, keepdims=True)
        z -= np.log(np.exp(z).sum(1, keepdims=True))
        total = np.zeros((len(distinct), z.shape[1]), dtype=np.float32)
        np.add.at(total, owner, z)
        total /= np.bincount(owner, minlength=len(distinct))[:, None]
        total -= np.log(np.exp(total).sum(1, keepdims=True))
        at = {t: i for i, t in enumerate(distinct)}
        return total[[at[t] for t in texts]]
