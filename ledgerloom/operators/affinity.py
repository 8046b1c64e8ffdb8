"""Items that are bought together."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.scratch import materialize

#: Lines of a basket that one task pairs; larger baskets are dealt into parts.
PART = 256
#: Pairs that one task makes and counts, about: their number, not Spark's size of the lines, sets the tasks.
PAIRS = 1 << 19
#: Items up to which their list is sent to all tasks.
FEW = 200_000


def frequent_items(lines: DataFrame, item: str, least: int) -> DataFrame:
    """Items in ``least`` baskets or more, of different (basket, item) rows."""
    return lines.groupBy(item).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(item)


def prune(lines: DataFrame, item: str, least: int) -> DataFrame:
    """Only rows of items that can be in a frequent pair: one in fewer baskets than ``least`` is in no such pair."""
    kept = frequent_items(lines, item, least)
    # only a list that has been counted as short is sent to all
    return lines.join(F.broadcast(kept) if kept.limit(FEW + 1).count() <= FEW else kept, item, "left_semi")


def pairs(lines: DataFrame, basket: str, item: str) -> DataFrame:
    """``basket, item_1, item_2`` with item_1 < item_2, of different (basket, item) rows.

    A basket of more than ``PART`` rows is dealt into parts by a hash of the item; a row
    meets the rows of each part under a key of its own, so that no task pairs a whole basket.
    """
    sizes = lines.groupBy(basket).agg(F.count(F.lit(1)).alias("_size"))
    made, large = sizes.agg(F.sum(F.col("_size") * (F.col("_size") - 1) / 2), F.coalesce(F.max("_size"), F.lit(0)) > PART).first()
    tasks = max(1, ceil((made or 0) / PAIRS))
    if not large:
        dealt = lines.repartition(tasks, basket)
        return dealt.select(basket, F.col(item).alias("item_1")).join(dealt.select(basket, F.col(item).alias("item_2")), basket).where("item_1 < item_2")
    sizes = sizes.where(F.col("_size") > PART)
    parts = F.coalesce(F.ceil(F.col("_size") / PART), F.lit(1)).cast("int")
    dealt = lines.select(basket, item).join(sizes, basket, "left").withColumn("_parts", parts).withColumn("_own", F.pmod(F.xxhash64(item), F.col("_parts")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    left = dealt.select(basket, F.col(item).alias("item_1"), F.col("_own").alias("_a"), others.alias("_b"))
    right = dealt.select(basket, F.col(item).alias("item_2"), F.col("_own").alias("_b"), others.alias("_a"))
    met = [basket, "_a", "_b"]
    return left.repartition(tasks, *met).join(right.repartition(tasks, *met), met).where("item_1 < item_2").select(basket, "item_1", "item_2")


def affinity(lines: DataFrame, basket: str, item: str, least: int) -> DataFrame:
    """``item_1, item_2, times_bought_together`` of pairs in ``least`` baskets or more. Rows with a null basket or item count nowhere."""
    different = materialize(lines.select(basket, item).where(F.col(basket).isNotNull() & F.col(item).isNotNull()).distinct())
    counted = pairs(materialize(prune(different, item, least)), basket, item).groupBy("item_1", "item_2").agg(F.count(F.lit(1)).alias("times_bought_together"))
    return counted.where(F.col("times_bought_together") >= least)
