"""Best-fit packing of items into containers of fixed capacity, in supersteps over size classes.

Sizes are whole numbers up to the capacity, so items of one size are interchangeable and so are containers of one gap: the
documents range-sorted by size, and the containers by gap, are at most `capacity` classes each, whatever the number of documents.
A superstep takes the largest size class left, matches it to the successor of its size among the gap classes, resolves who gets
which container by rank within the class, updates the gaps, and repeats until the class is placed; what finds no gap opens
containers. This is best-fit decreasing exactly. The plan (intervals of ranks) is small and is applied to the documents in one
distributed pass; ranks come from a range partitioning, so a size that a third of all documents have is spread over many tasks.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.session import cut

#: Largest capacity: the plan, which the driver makes and all tasks get, has a few rows for each size up to it.
MOST_CAPACITY = 1 << 16

#: One interval of the plan: ranks [first, first + count) of `size` go to containers `container + (rank - first) // per`.
Interval = tuple[int, int, int, int, int]


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Interval], int]:
    """(intervals, containers) of best-fit decreasing for histogram[size] items of each size, 1 <= size <= capacity."""
    out: list[Interval] = []
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> [(first container, how many)]
    gaps: list[int] = []

    def put(gap: int, first: int, many: int) -> None:
        if gap > 0 and many > 0:
            if not groups[gap]:
                bisect.insort(gaps, gap)
            groups[gap].append((first, many))

    containers = 0
    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left > 0:
            at = bisect.bisect_left(gaps, size)
            if at < len(gaps):
                gap = gaps[at]
                first, many = groups[gap].pop()
                if not groups[gap]:
                    del groups[gap]
                    gaps.pop(at)
            else:
                gap, first, many = capacity, containers, -(-left // (capacity // size))
                containers += many
            per = gap // size
            full = min(many, left // per)
            if full:
                out.append((size, rank, full * per, first, per))
                rank, left = rank + full * per, left - full * per
                put(gap - per * size, first, full)
            rest = many - full
            if left and rest:  # fewer than `per` are left: one container takes them
                out.append((size, rank, left, first + full, left))
                put(gap - left * size, first + full, 1)
                left, full, rest = 0, full + 1, rest - 1
            put(gap, first + full, rest)
    return out, containers


def pieces(sized: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece_no, start, size): items above the capacity in pieces of it, the rest whole; items of size 0 give none."""
    n = F.ceil(F.col(size) / capacity).cast("int")
    rows = sized.where(F.col(size) > 0).select(F.col(key).alias("key"), F.col(size).alias("total"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece_no"))
    start = F.col("piece_no").cast("bigint") * capacity
    return rows.select("key", "piece_no", start.alias("start"), F.least(F.col("total") - start, F.lit(capacity)).cast("int").alias("size"))


def _local_ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number the rows of each size of a partition, which is sorted by size."""
    last, seen = -1, 0
    for batch in batches:
        local = batch.groupby("size").cumcount()
        local += np.where(batch["size"] == last, seen, 0)
        if len(batch):
            last, seen = int(batch["size"].iloc[-1]), int(local.iloc[-1]) + 1
        yield batch.assign(local=local.astype("int64"))


def pack(sized: DataFrame, key: str = "doc_id", size: str = "tokens", capacity: int = 2048) -> DataFrame:
    """(key, piece_no, start, size, container): every piece's container, numbered from 0.

    sized: one row per item. Null sizes and sizes below 1 take no space: one row with piece 0, size 0 and a null container. Ties
    are resolved by key; an empty table gives an empty result; a capacity above MOST_CAPACITY is refused, since sizes would no longer
    be few.
    """
    if not 1 <= capacity <= MOST_CAPACITY:
        raise ValueError(f"capacity must be from 1 to {MOST_CAPACITY}")
    spark = sized.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sized = sized.select(F.col(key).alias("_key"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size"))
    ranged = pieces(sized, "_key", "_size", capacity).repartitionByRange(parts, "size", "key", "piece_no").sortWithinPartitions("size", "key", "piece_no")
    columns = "key bigint, piece_no int, start bigint, size int, part int, local bigint"
    ranked = cut(ranged.withColumn("part", F.spark_partition_id()).mapInPandas(_local_ranks, columns))
    # Range-sorted, so a size lies in neighbouring partitions: at most `capacity` plus the number of partitions rows.
    counts = ranked.groupBy("part", "size").count().collect()
    totals: dict[int, int] = defaultdict(int)
    offsets: dict[tuple[int, int], int] = {}
    for part, of, many in sorted(map(tuple, counts)):
        offsets[part, of] = totals[of]
        totals[of] += many
    lots: dict[int, list] = defaultdict(list)
    for of, *rest in plan(totals, capacity)[0]:
        lots[of].append(rest)
    shared = spark.sparkContext.broadcast((offsets, {of: np.array(sorted(rest), np.int64) for of, rest in lots.items()}))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, table = shared.value
        for batch in batches:
            out = np.empty(len(batch), np.int64)
            for (part, of), rows in batch.groupby(["part", "size"]).indices.items():
                rank = batch["local"].to_numpy()[rows] + starts[int(part), int(of)]
                lot = table[int(of)]
                at = np.searchsorted(lot[:, 0], rank, "right") - 1
                out[rows] = lot[at, 2] + (rank - lot[at, 0]) // lot[at, 3]
            yield batch[["key", "piece_no", "start", "size"]].assign(container=out)

    placed = ranked.mapInPandas(place, "key bigint, piece_no int, start bigint, size int, container bigint")
    none = sized.where("_size < 1").select(F.col("_key").alias("key"), F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("start"), F.lit(0).alias("size"), F.lit(None).cast("bigint").alias("container"))
    return placed.unionByName(none).withColumnRenamed("key", key)
