"""Per-tile quality: every tenth read, by tile and position, against the mean of all tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readqc.operators import fused
from readqc.operators.positions import grouped

EVERY = fused.TILES


def tile_quality(reads: DataFrame, offset: DataFrame | int = 33, every: int = EVERY) -> DataFrame:
    """(file_id, tile, pos, qsum, n) in Phred units. A sampled read whose header has no number there is an error."""
    counts = fused.count(reads.where("length(qual) > 0"), fused.settings(fused.profile(reads), every=1), [fused.TILE], tiles=every)
    return in_phred(fused.part(counts, fused.TILE), offset)


def in_phred(sums: DataFrame, offset: DataFrame | int) -> DataFrame:
    """Sums of quality characters as sums of qualities; offset is a number or a row a file."""
    if isinstance(offset, int):
        sums = sums.withColumn("offset", F.lit(offset))
    else:
        sums = sums.join(offset.select("file_id", "offset"), "file_id")
    return sums.select("file_id", "tile", "pos", (F.col("qsum") - F.col("offset") * F.col("n")).alias("qsum"), "n")


def centered(quality: DataFrame, on: bool = False, longest: DataFrame | None = None) -> DataFrame:
    """(file_id, tile, group_id, tag, centered_mean): a tile's mean less the plain mean of the tiles' means there."""
    rows = grouped(quality, on, longest).groupBy("file_id", "tile", "group_id", "tag").agg((F.sum("qsum") / F.sum("n")).alias("mean"))
    # in the order of tiles, so that the sum of doubles is the same on any machine
    tiles = Window.partitionBy("file_id", "group_id").orderBy("tile").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select("file_id", "tile", "group_id", "tag", (F.col("mean") - F.avg("mean").over(tiles)).alias("centered_mean"))
