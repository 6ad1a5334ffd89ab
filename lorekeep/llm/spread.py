"""Enough partitions for a stage that is heavy on CPU."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan as it is if it can feed every core, else shuffled by ``key`` into two partitions a core.

    It can with a file for every core, or with so many bytes that files of any size have a split for every core; less is
    little enough to be shuffled. Hashing a key, unlike dealing rows round, gives the same partitions when a lost task
    runs again.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if len(df.inputFiles()) >= cores or size >= cores * split:
        return df
    return df.repartition(2 * cores, key)


def spread_rows(df: DataFrame, key: str) -> DataFrame:
    """What a join or aggregate left, in at least two partitions a core; adaptive execution would join them by bytes alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(2 * cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)
