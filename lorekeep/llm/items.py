"""The items of this project's tables that the problems speak of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.whitespace import is_blank, trim_ws
from lorekeep.operators.current import current_rows
from lorekeep.sources.tables import table


def headed_text(heading: Column, text: Column) -> Column:
    """Trimmed heading, two line feeds and text; the text alone where the heading is null or blank."""
    text = F.coalesce(text, F.lit(""))
    return F.when(is_blank(heading), text).otherwise(F.concat(trim_ws(heading), F.lit("\n\n"), text))


def long_items(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    """Current pages and chunks as (item_kind, item_id, item), ``item`` null where it is not longer than ``limit``.

    Which version of a key is current must be settled over all rows, but only long texts travel for it.
    """

    def long_only(c: Column) -> Column:
        return F.when(F.length(c) > limit, c)

    pages = table(spark, sf_dir, "pages").select(
        F.concat_ws("/", "doc_id", F.col("page_number").cast("string")).alias("item_id"),
        long_only(F.col("content")).alias("item"),
        "ingested_at",
    )
    chunks = table(spark, sf_dir, "chunks").select(
        F.col("chunk_id").alias("item_id"),
        long_only(headed_text(F.col("section_heading"), F.col("text"))).alias("item"),
        "ingested_at",
    )
    parts = [
        current_rows(df, ["item_id"]).select(F.lit(kind).alias("item_kind"), "item_id", "item")
        for kind, df in (("page", pages), ("chunk", chunks))
    ]
    return parts[0].unionAll(parts[1])


def current_sections(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``section_id`` and ``columns`` of the current sections."""
    df = table(spark, sf_dir, "sections").select("section_id", *columns, "ingested_at")
    return current_rows(df, ["section_id"]).drop("ingested_at")
