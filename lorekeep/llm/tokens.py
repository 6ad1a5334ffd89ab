"""Encoding of a text column with a public byte-level vocabulary."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lorekeep.llm.bpe import Encoder, Vocabulary, read_ranks
from lorekeep.llm.spread import spread

DEFAULT = "byte_bpe_50k.tiktoken"
# a vocabulary file beyond this is not shipped to the executors
MAX_FILE_BYTES = 64 << 20
_ENCODERS: dict[str, Encoder] = {}


def tokenizer_folder() -> str:
    """Folder of the public vocabularies: LOREKEEP_TOKENIZERS, else the installed package."""
    own = os.environ.get("LOREKEEP_TOKENIZERS")
    if own:
        return own
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"


def vocabulary_bytes(name: str = DEFAULT, folder: str | None = None) -> bytes:
    """Content of a rank file, whose size is checked since it is broadcast."""
    path = os.path.join(folder or tokenizer_folder(), name)
    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def encoder(key: str, raw: bytes) -> Encoder:
    """The encoder of a rank file, built once per process."""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(Vocabulary(read_ranks(raw)))
    return _ENCODERS[key]


def shipped(spark: SparkSession, name: str = DEFAULT, folder: str | None = None):
    """(key, broadcast) of a rank file of checked size."""
    return f"{folder}/{name}", spark.sparkContext.broadcast(vocabulary_bytes(name, folder))


def encode_corpus(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = DEFAULT, folder: str | None = None
) -> DataFrame:
    """``id_col`` and ``ids``, the list of token ids of ``text_col``, one row for each row of ``df``.

    The text is encoded as it is, without special tokens. Null and empty texts give an empty list. Repeated rows
    stay repeated, a null id stays null, other columns are not read. One narrow pass, no shuffle unless the input has
    fewer files than the cluster has cores.
    """
    key, ranks = shipped(df.sparkSession, name, folder)
    id_type = df.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(key, ranks.value)
        for batch in batches:
            flat: list[int] = []
            ends = np.zeros(batch.num_rows + 1, dtype=np.int32)
            parts = []
            for i, text in enumerate(batch.column(1)):
                ids = e.encode(text.as_py())
                ends[i + 1] = ends[i] + len(ids)
                flat.extend(ids)
                if len(flat) > 1 << 20:
                    parts.append(np.array(flat, dtype=np.int32))
                    flat = []
            parts.append(np.array(flat, dtype=np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "ids"])

    return spread(df.select(id_col, text_col), id_col).mapInArrow(run, out)
