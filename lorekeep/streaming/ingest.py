"""Incremental ingest: pages that arrive become chunks of their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lorekeep.operators.ingest import page_segments, token_windows
from lorekeep.params import Params


def window_stream(pages: DataFrame, p: Params | None = None) -> DataFrame:
    """doc_id, page_number, seg_no, section_heading, window_no, text, token_count for each page row of a stream.

    Segments and windows need one page at a time, so the stream keeps no state; chunk numbers, which need the whole document,
    are given when the table is read.
    """
    p = p or Params()
    segments = page_segments(pages, ["doc_id", "page_number"])
    keys = ["doc_id", "page_number", "seg_no", "section_heading"]
    return token_windows(segments, keys, "content", p.target_tokens, p.overlap_tokens)


def start_ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Reads new parquet files of ``source`` once and appends their windows to ``target``."""
    pages = spark.readStream.schema(schema).parquet(source)
    return (
        window_stream(pages)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
