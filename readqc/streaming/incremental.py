"""Incremental QC: every metric is a sum, so counts of a stream of reads are those of all its batches.

State is bounded: cubes have a key for each position, base and quality, histograms one for each value; duplicate keys are
kept for a share of the key space that a hash chooses, the same in every batch and on every machine, so that counts of the keys
kept are whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from readqc.functions import expr
from readqc.operators import cube, per_read


def position_counts(reads: DataFrame) -> DataFrame:
    """The cube of a stream; write it with output mode update or complete."""
    return cube.counted(reads)


def length_counts(reads: DataFrame) -> DataFrame:
    return per_read.lengths(reads)


def key_counts(reads: DataFrame, one_in: int = 1) -> DataFrame:
    """Counts of 50-base prefixes for one in so many keys."""
    keys = expr.some(reads).select("file_id", expr.prefix(F.col("seq")).alias("seq"))
    kept = keys if one_in == 1 else keys.where(F.pmod(F.xxhash64("seq"), F.lit(one_in)) == 0)
    return kept.groupBy("file_id", "seq").agg(F.count("*").alias("n"))


def windowed_counts(reads: DataFrame, time: str, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Reads and bases by window of event time; windows close when the watermark passes them."""
    return (
        reads.withWatermark(time, late)
        .groupBy("file_id", F.window(time, size).alias("window"))
        .agg(F.count("*").alias("n_reads"), F.sum(F.length("seq").cast("long")).alias("total_bases"))
        .select("file_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_reads", "total_bases")
    )


def follow(counts: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Hands every state of the counts to `each`, for reports as the data come."""
    return counts.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).start()
