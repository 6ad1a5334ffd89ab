"""Items that appear together: pair counts, lift and pointwise mutual information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.session import cut


def cooccurrence(
    baskets: DataFrame,
    basket_col: str,
    items_col: str,
    total: DataFrame,
    min_count: int = 1,
    min_lift: float = 0.0,
    wide: int = 256,
) -> DataFrame:
    """Pairs ``item_a < item_b`` held by the same basket: n_ab, n_a, n_b, lift, pmi (natural logarithm).

    ``items_col`` is an array of strings; null lists and null or empty items count for nothing, an item repeated in
    a basket or in repeated rows of a basket counts once, a null basket id is a basket of its own. ``total`` is one
    row with the number of baskets in its only column, those without items included. Ordering is by code points.

    Only pairs with ``n_ab >= min_count`` and ``lift >= min_lift`` come out, and that prunes the items exactly before
    any pair is made: ``n_ab <= min(n_a, n_b)``, so an item needs ``n >= min_count`` and ``n <= total / min_lift``.
    Very common items, which make most pairs, drop out. The items of baskets are written once and read for the marginals
    and for the pairs. Pair counts are combined on the map side. The items of a basket with more than ``wide`` left
    are dealt out to blocks, and each pair of blocks is a group of its own, so no task holds more than about twice
    ``wide`` items of a basket and an item is copied once for every ``wide`` others.
    """
    total = total.select(F.col(total.columns[0]).cast("long").alias("n_all"))
    held = cut(
        baskets.select(F.col(basket_col).alias("basket"), F.explode(F.array_distinct(items_col)).alias("item"))
        .where("item is not null and item <> ''")
        .distinct()
    )
    marginals = (
        held.groupBy("item")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_count)
        .crossJoin(F.broadcast(total))  # one row
        .where(F.lit(min_lift) * F.col("n") <= F.col("n_all"))
        .drop("n_all")
    )
    left = held.join(marginals, "item").withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("basket")))
    item = F.struct("item", "n")

    def pairs(df: DataFrame, rest: Column) -> DataFrame:
        return df.select(F.posexplode("xs").alias("i", "a"), "*").select("a", F.explode(rest).alias("b"))

    narrow = left.where((F.col("size") > 1) & (F.col("size") <= wide)).groupBy("basket").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    blocks = F.ceil(F.col("size") / wide).cast("int")
    dealt = left.where(F.col("size") > wide).withColumn("of", F.pmod(F.xxhash64("item"), blocks).cast("int"))
    # each item goes to the groups of its block and every block; own and other block meet there
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "basket", F.least("of", "with").alias("lo"), F.greatest("of", "with").alias("hi"), F.col("of") == F.least("of", "with"), item.alias("x")
    )
    met = met.toDF("basket", "lo", "hi", "low", "x")
    broad = met.groupBy("basket", "lo", "hi").agg(
        F.collect_list(F.when(F.col("low"), F.col("x"))).alias("xs"), F.collect_list(F.when(~F.col("low"), F.col("x"))).alias("ys")
    )
    inside = pairs(broad.where("lo = hi").select(F.array_sort("xs").alias("xs")), F.slice("xs", F.col("i") + 2, F.size("xs")))
    across = pairs(broad.where("lo < hi").select("xs", "ys"), F.col("ys"))
    # of two blocks, the lesser item comes first
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return (
        pairs(narrow.select("xs"), F.slice("xs", F.col("i") + 2, F.size("xs")))
        .unionAll(inside)
        .unionAll(across)
        .groupBy(
            F.col("a.item").alias("item_a"),
            F.col("b.item").alias("item_b"),
            F.col("a.n").alias("n_a"),
            F.col("b.n").alias("n_b"),
        )
        .agg(F.count(F.lit(1)).alias("n_ab"))
        .where(F.col("n_ab") >= min_count)
        .crossJoin(F.broadcast(total))  # one row
        .withColumn("lift", F.col("n_ab") * F.col("n_all") / (F.col("n_a").cast("double") * F.col("n_b")))
        .where(F.col("n_ab") * F.col("n_all") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
        .select("item_a", "item_b", "n_ab", "n_a", "n_b", "lift", F.log("lift").alias("pmi"))
    )
