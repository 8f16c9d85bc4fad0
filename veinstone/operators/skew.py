"""Joins that survive hot keys, and pairs within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone.session import BROADCAST_ROWS

#: A key is hot beyond this many rows, or beyond the share of all rows that keeps the hot keys few enough to broadcast.
HOT_ROWS = 50_000
#: Rows of a block of a group in `pairs_within`.
BLOCK_ROWS = 1_000


def join_hot(big: DataFrame, small: DataFrame, key: str, rows: str) -> DataFrame:
    """Inner join of big with small on `key`, which is unique in small; small[rows] is the number of big's rows of the key.

    Keys with more than max(HOT_ROWS, all rows / BROADCAST_ROWS) rows are at most BROADCAST_ROWS, whatever the data: these are
    broadcast and never shuffled, the rest join by shuffle. small should be stored or cheap, it is read up to three times.
    """
    total = small.agg(F.sum(rows)).first()[0] or 0
    most = max(HOT_ROWS, total // BROADCAST_ROWS)
    if not small.where(F.col(rows) > most).limit(1).count():
        return big.join(small, key)
    hot = F.broadcast(small.where(F.col(rows) > most))
    return big.join(hot, key).unionByName(big.join(hot, key, "left_anti").join(small.where(F.col(rows) <= most), key))


def pairs_within(members: DataFrame, group: str, member: str) -> DataFrame:
    """All pairs (member_a < member_b) of each group. Groups are cut into blocks of about BLOCK_ROWS members and every pair of
    blocks is a join key of its own, so one task never holds more than two blocks, however large the group."""
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows = join_hot(members.select(group, member), sizes, group, "_n")
    blocks = F.ceil(F.col("_n") / BLOCK_ROWS).cast("int")
    rows = rows.withColumn("_blocks", blocks).withColumn("_b", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    span = lambda a, b: F.explode(F.sequence(a, b))
    left = rows.select(group, F.col(member).alias("_x"), F.col("_b").alias("_i"), span(F.col("_b"), F.col("_blocks") - 1).alias("_j"))
    right = rows.select(group, F.col(member).alias("_y"), span(F.lit(0), F.col("_b")).alias("_i"), F.col("_b").alias("_j"))
    once: Column = (F.col("_i") < F.col("_j")) | (F.col("_x") < F.col("_y"))
    pairs = left.join(right.hint("merge"), [group, "_i", "_j"]).where(once)  # exploded rows look few to Spark: never broadcast
    return pairs.select(group, F.least("_x", "_y").alias(f"{member}_a"), F.greatest("_x", "_y").alias(f"{member}_b"))
