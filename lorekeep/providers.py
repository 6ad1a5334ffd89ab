"""What the engine asks of the outside: parsers, token counters, embedding and chat models; and a deterministic stand-in."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import embed_input, estimated_tokens, truncated_to_tokens


class DocumentParser(Protocol):
    """Turns files into pages: doc_id, page_number, content."""

    def pages(self, spark: SparkSession, path: str) -> DataFrame: ...


class TokenCounter(Protocol):
    """Counts the tokens of a text and cuts it to a number of them."""

    def count(self, text: Column) -> Column: ...

    def truncate(self, text: Column, most: int) -> Column: ...


class Embedder(Protocol):
    """Embeds a batch of texts; sent to the executors, so it must pickle."""

    width: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class WordEstimate:
    """Three tokens a word."""

    def __init__(self, per_word: int = 3) -> None:
        self.per_word = per_word

    def count(self, text: Column) -> Column:
        return estimated_tokens(text, self.per_word)

    def truncate(self, text: Column, most: int) -> Column:
        return truncated_to_tokens(text, most, self.per_word)


class MarkdownParser:
    """Text and Markdown files, each as one page."""

    def pages(self, spark: SparkSession, path: str) -> DataFrame:
        from lorekeep.sources.files import text_documents

        return text_documents(spark, path).select("doc_id", "page_number", "content")


class HashEmbedder:
    """Unit vectors from digests of the words: the same text always gives the same vector. For tests."""

    def __init__(self, width: int = 64) -> None:
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.width)
            for word in text.lower().split():
                d = hashlib.sha256(word.encode()).digest()
                v[int.from_bytes(d[:4], "little") % self.width] += 1.0 if d[4] & 1 else -1.0
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).astype(np.float32).tolist())
        return out


def embedded(df: DataFrame, text: str, embedder: Embedder, name: str = "embedding", batch: int = 100) -> DataFrame:
    """``df`` with a vector of ``text`` made safe for the model, in calls of at most ``batch`` texts; null texts get none."""
    held = "__safe_text"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{name}` array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[held].tolist()
            vectors: list[list[float] | None] = [None] * len(texts)
            some = [i for i, t in enumerate(texts) if isinstance(t, str)]
            for a in range(0, len(some), batch):
                part = some[a : a + batch]
                for i, v in zip(part, embedder.embed([texts[i] for i in part]), strict=True):
                    vectors[i] = v
            yield frame.drop(columns=[held]).assign(**{name: pd.Series(vectors, index=frame.index, dtype=object)})

    return df.withColumn(held, embed_input(F.col(text))).mapInPandas(run, schema)
