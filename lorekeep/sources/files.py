"""Text, page and vector files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import slug

# rows of vectors that one task reads at once
VECTOR_ROWS = 1 << 16


def discovered(spark: SparkSession, path: str, pattern: str = "*.{md,txt}") -> DataFrame:
    """path, doc_id, label, size, sha256 of the files under a folder, or of the one file that ``path`` names."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    label = F.element_at(F.split("path", "/"), -1)
    return raw.select(
        "path", slug(F.regexp_replace(label, r"\.[^.]*\z", "")).alias("doc_id"), label.alias("label"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")
    )


def text_documents(spark: SparkSession, path: str, pattern: str = "*.{md,txt}") -> DataFrame:
    """path, doc_id, label, page_number, content, sha256: each text file as one page; folders are searched all through."""
    raw = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    )
    label = F.element_at(F.split("path", "/"), -1)
    return raw.select(
        "path",
        slug(F.regexp_replace(label, r"\.[^.]*\z", "")).alias("doc_id"),
        label.alias("label"),
        F.lit(1).alias("page_number"),
        F.decode("content", "UTF-8").alias("content"),
        F.sha2("content", 256).alias("sha256"),
    )


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a fixed schema; a line that does not parse is a row of nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """A parquet table, replaced if it is there; with a partition column only the partitions at hand are."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def write_vectors(df: DataFrame, path: str, width: int, key: str = "corpus_pos", vector: str = "embedding") -> None:
    """A folder of flat files of little-endian float32 rows in the order of ``key``, each named after its first row.

    Every vector must have ``width`` values, and keys must run from 0 without a gap. A file holds ``VECTOR_ROWS`` rows. Nothing is
    written where there are no rows.
    """
    import os

    target = path.removeprefix("file://")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for frame in frames:
            for no, part in frame.groupby("__file"):
                at = os.path.join(target, f"{int(no) * VECTOR_ROWS:012d}.f32")
                values = np.array(part.sort_values(key)[vector].tolist(), dtype="<f4").reshape(len(part), width)
                with open(f"{at}.part", "wb") as f:
                    f.write(values.tobytes())
                os.replace(f"{at}.part", at)  # a task that runs again leaves the same file
                yield pd.DataFrame({"file": [at], "rows": [len(part)]})

    os.makedirs(target, exist_ok=True)
    filed = df.select(key, vector).withColumn("__file", F.floor(F.col(key) / VECTOR_ROWS))
    # one group of rows is one file, so its rows are sorted in one task
    filed.groupBy("__file").applyInPandas(lambda g: next(run(iter([g]))), "file string, rows long").count()


def vector_rows(spark: SparkSession, path: str, width: int) -> DataFrame:
    """corpus_pos, embedding: the rows of ``write_vectors``, or of one flat file of any size.

    A file's rows are numbered on from the number in its name, else from 0; several files must be named so. A task reads
    ``VECTOR_ROWS`` rows by seeking in the file, which must be on a mounted path, so a large file is read by many.
    """
    import os

    where = path.removeprefix("file://")
    files = [os.path.join(where, f) for f in sorted(os.listdir(where)) if not f.endswith(".part")] if os.path.isdir(where) else [where]
    step = 4 * width * VECTOR_ROWS
    pieces = []
    for f in files:
        stem = os.path.basename(f).split(".")[0]
        first = int(stem) if stem.isdigit() else 0
        if not stem.isdigit() and len(files) > 1:
            raise ValueError(f"{f}: several vector files must be named after their first row")
        pieces += [(f, at, first + at // (4 * width)) for at in range(0, os.path.getsize(f), step)]
    schema = "corpus_pos long, embedding array<float>"
    if not pieces:
        return spark.createDataFrame([], schema)
    df = spark.createDataFrame(pieces, "file string, at long, first long").repartition(len(pieces), "file", "at")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for frame in frames:
            for file, at, first in zip(frame["file"], frame["at"], frame["first"], strict=True):
                with open(file, "rb") as f:
                    f.seek(at)
                    raw = f.read(step)
                x = np.frombuffer(raw[: len(raw) // (4 * width) * 4 * width], dtype="<f4").reshape(-1, width)
                for a in range(0, len(x), 10_000):
                    part = x[a : a + 10_000]
                    yield pd.DataFrame({"corpus_pos": np.arange(first + a, first + a + len(part)), "embedding": list(part)})

    return df.mapInPandas(run, schema)
