"""Filling the concept lists of sections from model outputs, kept under a digest of the synopsis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.parsing import enrichment_key, parsed_enrichment, supported_defines


def enriched(sections: DataFrame, outputs: DataFrame) -> DataFrame:
    """``sections`` (section_id, synopsis, ...) with concepts, defines, refs, see_also, enrich_confidence and ``enriched``.

    ``outputs`` (cache_key, raw): a model's JSON for a synopsis. Equal synopses share one output; of several outputs under
    one key one that parses counts, the first by its text. Where there is none, or none that parses, the lists are empty.
    Defined concepts that do not stand in the synopsis are left out.
    """
    parsed = (
        outputs.select("cache_key", "raw", parsed_enrichment(F.col("raw")).alias("e"))
        .where("e is not null")
        .groupBy("cache_key")
        .agg(F.min_by("e", "raw").alias("e"))
    )
    none = F.array().cast("array<string>")
    plain = sections.drop("concepts", "defines", "refs", "see_also")
    joined = plain.withColumn("cache_key", enrichment_key(F.coalesce("synopsis", F.lit("")))).join(parsed, "cache_key", "left")
    return joined.select(
        *plain.columns,
        "cache_key",
        F.coalesce("e.concepts", none).alias("concepts"),
        supported_defines(F.coalesce("e.defines", none), F.coalesce("synopsis", F.lit(""))).alias("defines"),
        F.coalesce("e.refs", none).alias("refs"),
        F.col("e.see_also").alias("see_also"),
        F.col("e.confidence").alias("enrich_confidence"),
        F.col("e").isNotNull().alias("enriched"),
    )


def unseen(sections: DataFrame, outputs: DataFrame) -> DataFrame:
    """cache_key, synopsis: each distinct synopsis that has no output yet: what a model still has to read."""
    keyed = sections.select(enrichment_key(F.coalesce("synopsis", F.lit(""))).alias("cache_key"), F.coalesce("synopsis", F.lit("")).alias("synopsis"))
    return keyed.dropDuplicates(["cache_key"]).join(outputs.select("cache_key").distinct(), "cache_key", "left_anti")
