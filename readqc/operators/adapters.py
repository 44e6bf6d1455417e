"""Adapter content: the first place of each adapter in each read, as counts and running shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readqc.operators import fused
from readqc.operators.positions import grouped


#: Adapters up to which a search for each is faster than a pass in Python.
FEW = 8


def searched(reads: DataFrame, adapters: list[tuple[str, str]]) -> DataFrame:
    """(file_id, adapter_id, pos, n): reads by the first place (from 1) of an adapter, by one search for each adapter; the plain meaning of `hits`."""
    found = F.array(*(F.struct(F.lit(i).alias("adapter_id"), F.instr(F.upper("seq"), seq.upper()).alias("pos")) for i, (_, seq) in enumerate(adapters)))
    rows = reads.select("file_id", F.inline(F.filter(found, lambda x: x["pos"] > 0)))
    return rows.groupBy("file_id", "adapter_id", "pos").agg(F.count("*").alias("n"))


def hits(reads: DataFrame, adapters: list[tuple[str, str]]) -> DataFrame:
    """The same; more than FEW adapters by one pass over the bytes for all of them, which takes as long for sixty as for six."""
    if len(adapters) <= FEW:
        return searched(reads, adapters)
    return fused.part(fused.count(reads, None, [fused.ADAPTER], adapters), fused.ADAPTER)


def cumulative(counts: DataFrame, totals: DataFrame, adapters: list[tuple[str, str]], on: bool = False) -> DataFrame:
    """(file_id, group_id, tag, adapter_id, adapter, cumulative_pct): reads in which an adapter began up to a group of positions, in percent of
    all reads. totals: (file_id, n_reads, max_len)."""
    size = len(adapters[0][1])
    spark = counts.sparkSession
    names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(adapters)], "adapter_id int, adapter string")
    last = F.when(F.col("max_len") + 1 >= size, F.col("max_len") - size + 1).otherwise(F.col("max_len"))
    grid = totals.withColumn("pos", F.explode(F.sequence(F.lit(1), F.greatest(F.col("max_len"), F.lit(1))))).join(F.broadcast(names))  # a row for each position and adapter
    per_pos = grid.join(counts, ["file_id", "adapter_id", "pos"], "left").select("file_id", "n_reads", last.alias("last"), "adapter_id", "adapter", "pos", F.coalesce("n", F.lit(0)).alias("n"))
    rows = grouped(per_pos, on, totals.select("file_id", F.col("max_len").alias("longest"))).groupBy("file_id", "n_reads", "last", "adapter_id", "adapter", "group_id", "tag").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"))
    upto = F.sum("n").over(Window.partitionBy("file_id", "adapter_id").orderBy("group_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("upto", upto).where("lo <= last").select("file_id", "group_id", "tag", "adapter_id", "adapter", (100.0 * F.col("upto") / F.col("n_reads")).alias("cumulative_pct"))
