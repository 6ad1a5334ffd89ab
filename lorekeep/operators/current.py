"""Current rows of a re-ingested table."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.session import cut, if_small


def current_rows(df: DataFrame, keys: list[str], newest: str = "ingested_at") -> DataFrame:
    """One row per key: that with the greatest ``newest``.

    Rows of one key with equal ``newest`` are taken as repeats and one of them stays. Null keys form a key of their
    own; a null ``newest`` is older than any other. An empty table stays empty. The rank filter runs on the map side
    too (``WindowGroupLimit``), so a key with many versions sends one row per map task.
    """
    rank = "__rank_of_version"
    w = Window.partitionBy(*keys).orderBy(F.col(newest).desc_nulls_last())
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def current_apart(df: DataFrame, keys: list[str], newest: str = "ingested_at") -> DataFrame:
    """``current_rows`` of a table of files, to be read again and again, without moving the rows whose key stands once.

    The keys that stand several times are found from the key columns alone, and only their current rows are written, so that
    every read has the same. Where those keys are too many for a broadcast, or files so uneven that a task would read much
    more than its share, all current rows are written.
    """
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("__p")).count().collect()]
    if max(sizes, default=0) * df.sparkSession.sparkContext.defaultParallelism > 2 * sum(sizes):
        return cut(current_rows(df, keys, newest))
    again = df.groupBy(*(F.col(k).alias(f"__key_{k}") for k in keys)).agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1").drop("__rows")
    again = cut(again)
    few = if_small(again, F.length(F.concat_ws("", *(F.col(f"__key_{k}").cast("string") for k in keys))) + 24 * len(keys))
    if few is again:
        return cut(current_rows(df, keys, newest))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys))
    return df.join(few, same, "left_anti").unionAll(cut(current_rows(df.join(few, same, "left_semi"), keys, newest)))
