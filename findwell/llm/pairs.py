"""Pairs within groups of any size, in blocks, so that no task holds a large group whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096  # items of a group that meet in one place


def block_count(n: Column, block: int = BLOCK) -> Column:
    return F.greatest(F.ceil(n / F.lit(block)), F.lit(1)).cast("int")


def pairs_within(df: DataFrame, group: list[str], item: str, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct items of each group; a pair may come from several groups.

    ``df`` has one row per group and item. A group of more than ``block`` items is cut by hash into
    blocks of about that size, and each two blocks meet under a key of their own. So a hot group is
    spread over as many keys as it has pairs of blocks; what is shuffled for it is its items times
    the blocks, far less than its pairs. Null groups meet nothing.
    """
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    rows = df.join(counts, group).withColumn("__of", block_count(F.col("__n"), block))
    rows = rows.withColumn("__mine", F.pmod(F.xxhash64(F.lit(11), F.col(item)), F.col("__of")).cast("int"))
    left = rows.select(*group, F.col(item).alias("__x"), F.col("__mine").alias("__i"), F.explode(F.sequence("__mine", F.col("__of") - 1)).alias("__j"))
    right = rows.select(*group, F.col(item).alias("__y"), F.explode(F.sequence(F.lit(0), "__mine")).alias("__i"), F.col("__mine").alias("__j"))
    met = left.join(right, [*group, "__i", "__j"]).where((F.col("__i") < F.col("__j")) | (F.col("__x") < F.col("__y")))
    return met.select(F.least("__x", "__y").alias("a"), F.greatest("__x", "__y").alias("b")).where(F.col("a") != F.col("b"))
