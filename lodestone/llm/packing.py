"""Problem 8: containers of fixed capacity, planned over a histogram of lengths.

The plan knows how many items there are of each length, never the items: best fit, the longest first, puts groups of equal items into groups of
equal containers. It says which containers the items of a length take by their rank within the length; the items find theirs by a
join on length and rank.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.llm.common import stored

BLOCK, SALTS = 64, 64


def plan(histogram: dict[int, int], capacity: int) -> Iterable[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number of items, first container, items a container): the items of a run fill containers in a row, so
    many each. Lengths are from 1 to capacity; containers are numbered from 0."""
    free: list[int] = []  # spaces left, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # space left -> ranges (first container, number)
    made = 0

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in groups:
                bisect.insort(free, space)
                groups[space] = []
            groups[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            i = bisect.bisect_left(free, length)
            if i < len(free):
                space = free[i]
                each = space // length
                first, n = groups[space].pop()
                if not groups[space]:
                    del groups[space]
                    free.pop(i)
            else:
                space, each = capacity, capacity // length
                n = -(-left // each)
                first, made = made, made + n
            # whole containers take `each` items; the last of them perhaps fewer
            whole = min(n, left // each)
            if whole:
                yield length, rank, whole * each, first, each
                put(space - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if left and whole < n:
                yield length, rank, left, first + whole, left
                put(space - left * length, first + whole, 1)
                whole, rank, left = whole + 1, rank + left, 0
            put(space, first + whole, n - whole)


def ranked(df: DataFrame, by: str, order: Column, rank: str = "rank") -> DataFrame:
    """df with a number from 0 within equal values of `by`. A value's rows are numbered in 64 parts, so one that most rows have isn't one task."""
    x = df.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(SALTS)).cast("int"))
    before = x.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    before = before.select(by, "_part", (F.sum("_n").over(W.partitionBy(by).orderBy("_part")) - F.col("_n")).alias("_before"))
    x = x.withColumn("_in", F.row_number().over(W.partitionBy(by, "_part").orderBy(order)) - 1)
    return x.join(before, [by, "_part"]).withColumn(rank, F.col("_before") + F.col("_in")).drop("_part", "_before", "_in")


def pieces(items: DataFrame, capacity: int) -> DataFrame:
    """item, piece, length: an item within the capacity is one piece; a longer one is cut into full pieces and the rest. Items of no length have none."""
    n = F.ceil(F.col("size") / capacity).cast("int")
    x = items.where("size > 0").select("item", "size", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    return x.select("item", "piece", F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("int").alias("length"))


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """item, piece, length, container of each piece. items: item (unique), size. Only the histogram, at most `capacity` numbers, is read to the driver."""
    spark = items.sparkSession
    p = stored(pieces(items, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = list(plan(histogram, capacity))
    slots = spark.createDataFrame(runs, "length int, first long, n long, container long, each long")
    slots = slots.withColumn("block", F.explode(F.sequence(F.expr(f"first div {BLOCK}"), F.expr(f"(first + n - 1) div {BLOCK}"))))
    x = ranked(p, "length", F.struct("item", "piece")).withColumn("block", F.expr(f"rank div {BLOCK}"))
    got = x.join(slots, ["length", "block"]).where("rank >= first and rank < first + n")
    return got.select("item", "piece", "length", (F.col("container") + F.expr("(rank - first) div each")).alias("container"))
