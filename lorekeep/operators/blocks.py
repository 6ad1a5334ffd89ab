"""Running totals and neighbours inside groups of any size.

A window over a whole document would put that document into one task. Here rows are taken in blocks of their order number;
a task holds one block, and only one row for each block takes part in the step over the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def _block(order: str) -> Column:
    return F.floor(F.col(order) / BLOCK)


def running_total(df: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the group before this one.

    ``order`` is a whole number, once in a group; rows with a null ``order`` come first, together.
    """
    keyed = df.withColumn("__block", _block(order))
    sums = keyed.groupBy(group, "__block").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(group).orderBy(F.col("__block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col(group).alias("__g"), F.col("__block").alias("__b"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__at_block")
    )
    inside = Window.partitionBy(group, "__block").orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = F.col(group).eqNullSafe(F.col("__g")) & F.col("__block").eqNullSafe(F.col("__b"))
    return local.join(starts, on).withColumn(name, F.col(name) + F.col("__at_block")).drop("__g", "__b", "__block", "__at_block")


def with_previous(df: DataFrame, group: str, order: str, columns: list[str], prefix: str = "prev_") -> DataFrame:
    """``df`` with the ``columns`` of the row before it in its group, and ``prefix`` + ``exists``."""
    row = F.struct(*columns)
    keyed = df.withColumn("__block", _block(order))
    last = keyed.groupBy(group, "__block").agg(F.max_by(row, F.col(order)).alias("__last"))
    by_block = Window.partitionBy(group).orderBy("__block")
    edge = last.select(F.col(group).alias("__g"), F.col("__block").alias("__b"), F.lag("__last").over(by_block).alias("__edge"))
    inside = Window.partitionBy(group, "__block").orderBy(order)
    local = keyed.withColumn("__prev", F.lag(row).over(inside)).withColumn("__first", F.row_number().over(inside) == 1)
    on = F.col(group).eqNullSafe(F.col("__g")) & F.col("__block").eqNullSafe(F.col("__b"))
    got = F.when(F.col("__first"), F.col("__edge")).otherwise(F.col("__prev"))
    out = local.join(edge, on).withColumn("__got", got)
    for c in columns:
        out = out.withColumn(prefix + c, F.col("__got")[c])
    return out.withColumn(prefix + "exists", F.col("__got").isNotNull()).drop("__g", "__b", "__block", "__prev", "__first", "__edge", "__got")
