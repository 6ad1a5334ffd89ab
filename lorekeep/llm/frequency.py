"""Occurrences of every term and the records that hold it, in a vertical layout of compressed bitmaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm import bitmaps

_FLUSH = 1 << 18
_COLUMNS = "term string, block long, bitmap binary, records long, occurrences long"
_NAMES = ["term", "block", "bitmap", "records", "occurrences"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=_NAMES
    )


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per term and block of 65,536 record ids: the bitmap of the records and the number of occurrences."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush() -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held)
        codes = whole.column(1).combine_chunks().dictionary_encode()
        terms, term = codes.dictionary, codes.indices.to_numpy()
        ids = whole.column(0).to_numpy()
        order = np.lexsort((ids, term))
        term, ids = term[order], ids[order]
        block = ids >> 16
        starts = np.flatnonzero(np.concatenate(([True], (np.diff(term) != 0) | (np.diff(block) != 0))))
        ends = np.append(starts[1:], len(ids))
        fresh = np.concatenate(([True], (np.diff(term) != 0) | (np.diff(ids) != 0)))
        low = (ids & 0xFFFF).astype(np.uint16)
        names = terms.to_pylist()
        out = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            members = low[a:b][fresh[a:b]]
            out.append((names[term[a]], int(block[a]), bitmaps.encode(members), len(members), b - a))
            if len(out) >= 20_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _FLUSH:
            yield from flush()
            held, rows = [], 0
    if rows:
        yield from flush()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unions the bitmaps of neighbouring rows of one term and block."""
    key, raws, records, occurrences = None, [], 0, 0
    out: list[tuple] = []

    def close() -> None:
        bitmap, n = (raws[0], records) if len(raws) == 1 else bitmaps.union(raws)
        out.append((*key, bitmap, n, occurrences))

    for batch in batches:
        for term, block, bitmap, n, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (term, block) != key:
                if key is not None:
                    close()
                key, raws, occurrences = (term, block), [], 0
            raws.append(bitmap)
            records, occurrences = n, occurrences + seen
        if len(out) >= 20_000:
            yield _batch(out)
            out.clear()
    if key is not None:
        close()
    yield _batch(out)


def term_bitmaps(df: DataFrame, terms_col: str) -> DataFrame:
    """Vertical layout: term, block, bitmap, records, occurrences; one record for each row of ``df``.

    Record ids are given here, dense within each partition, so that bitmaps stay small and a lost task that runs again
    gives the records it holds distinct ids again. Bitmaps are built before the shuffle; a term that stands in very many records
    is spread over its blocks.
    """
    named = (
        df.select(F.monotonically_increasing_id().alias("record"), F.col(terms_col).alias("__terms"))
        .select("record", F.explode("__terms").alias("term"))
        .where("term is not null and term <> ''")
    )
    built = named.mapInArrow(_build, _COLUMNS)
    return built.repartition("term", "block").sortWithinPartitions("term", "block").mapInArrow(_merge, _COLUMNS)


def term_frequency(df: DataFrame, terms_col: str) -> DataFrame:
    """term, occurrences, records for every distinct non-empty term of the string arrays in ``terms_col``.

    Each row of ``df`` is one record: repeated rows are records of their own. A term that stands twice in a record
    has two occurrences and one record. Null lists and null or empty terms count for nothing; an empty table has no
    terms. Other columns are not read.
    """
    return (
        term_bitmaps(df, terms_col)
        .groupBy("term")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    )


def marked(terms: DataFrame, total: DataFrame, rare_below: int, common_share: float) -> DataFrame:
    """``terms`` with ``mark``: ``rare`` below so many records, ``common`` above that share of ``total``, else null.

    ``total`` is one row with the number of all records in its only column.
    """
    total = total.select(F.col(total.columns[0]).cast("long").alias("n_all"))
    return (
        terms.crossJoin(F.broadcast(total))  # one row
        .withColumn(
            "mark",
            F.when(F.col("records") < rare_below, "rare").when(
                F.col("records") > F.lit(common_share) * F.col("n_all"), "common"
            ),
        )
        .drop("n_all")
    )
