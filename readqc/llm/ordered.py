"""Rows numbered in an order over the whole table, and running sums over such numbers, without one task that sees all rows.

A table is sorted by ranges and written with its place in each range; the ranges' sizes, a row a range, give the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readqc.llm.shared import written

#: Bits of monotonically_increasing_id that number the rows of a range.
BITS = 33
#: Ranges at most whose sizes are broadcast; blocks of a running sum at most.
RANGES, BLOCKS = 100_000, 65_536


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with `name`, the row's place (from 0) in that order. Rows that tie are numbered in any order, so a tie that matters must be broken by
    `order`. Rows of one leading key spread over ranges by what follows it in `order`."""
    spot, part, before = (f"{name}_{x}" for x in ("spot", "part", "before"))
    table = written(df.orderBy(*order).withColumn(spot, F.monotonically_increasing_id()), "ordered")
    of, at = F.shiftright(spot, BITS), F.col(spot).bitwiseAND(F.lit((1 << BITS) - 1))
    sizes = table.groupBy(of.alias(part)).agg(F.count("*").alias("n"))  # a row a range
    ahead = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(before))
    if table.rdd.getNumPartitions() <= RANGES:
        ahead = F.broadcast(ahead)
    return table.withColumn(part, of).join(ahead, part).withColumn(name, F.col(before) + at).drop(part, before, spot)


def block_width(n: int, least: int) -> int:
    """Rows of a block, so that n rows make BLOCKS blocks at most."""
    return max(least, -(-n // BLOCKS))


def running(df: DataFrame, at: str, width: int, sums: dict[str, str]) -> DataFrame:
    """df with running sums, of each column of `sums` under its new name, up to and including the row's number `at`. Sums run within blocks of `width`
    numbers; the sums of whole blocks, BLOCKS rows at most, are added."""
    blocked = df.withColumn("block", F.floor(F.col(at) / width))
    within = Window.partitionBy("block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    totals = blocked.groupBy("block").agg(*(F.sum(c).alias(f"{new}_all") for c, new in sums.items()))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("block", *(F.coalesce(F.sum(f"{new}_all").over(ahead), F.lit(0)).alias(f"{new}_before") for new in sums.values()))
    rows = blocked.withColumns({new: F.sum(c).over(within) for c, new in sums.items()})
    rows = rows.join(F.broadcast(totals), "block").withColumns({new: F.col(new) + F.col(f"{new}_before") for new in sums.values()})
    return rows.drop("block", *(f"{new}_before" for new in sums.values()))
