"""Roll-ups of the cube by position or group of positions: bases, N, qualities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readqc.functions.expr import tag
from readqc.functions.stats import RANGES, SINGLES, base_groups

#: Which quantiles are reported: name, and the share of the total as (numerator, denominator).
QUANTILES = {"median": (1, 2), "lower_quartile": (1, 4), "upper_quartile": (3, 4), "p10": (1, 10), "p90": (9, 10)}


def groups(spark, longest: int, on: bool) -> DataFrame:
    """(group_id, lo, hi, tag) of positions 1 .. longest."""
    rows = [(i, a, b) for i, (a, b) in enumerate(base_groups(longest, on))]
    return spark.createDataFrame(rows, "group_id int, lo int, hi int").withColumn("tag", tag(F.col("lo"), F.col("hi")))


def grouped(counts: DataFrame, on: bool = False, longest: DataFrame | None = None) -> DataFrame:
    """counts (file_id, pos, ..) with group_id, tag, lo and hi: single positions, or each file's own groups by the closed rule of `stats.base_groups`. longest:
    (file_id, longest), the longest read of a file where that is not its largest position."""
    if not on:
        return counts.select("*", (F.col("pos") - 1).alias("group_id"), F.col("pos").cast("string").alias("tag"), F.col("pos").alias("lo"), F.col("pos").alias("hi"))
    known = longest if longest is not None else counts.groupBy("file_id").agg(F.max(F.when(F.col("n") > 0, F.col("pos"))).alias("longest"))  # of the same exchange
    known = known.select("file_id", F.col("longest").cast("int").alias("longest"), step_of(F.col("longest")).cast("int").alias("step"))
    single = (F.col("step") == 1) | (F.col("pos") < 10)
    lo = F.when(single, F.col("pos")).otherwise(F.expr("10 + (pos - 10) div step * step")).cast("int")
    hi = F.when(single, F.col("pos")).otherwise(F.least("longest", F.col("lo") + F.col("step") - 1)).cast("int")
    group = F.when(single, F.col("pos") - 1).otherwise(F.expr("9 + (pos - 10) div step")).cast("int")
    return counts.join(known, "file_id").withColumn("lo", lo).withColumn("hi", hi).withColumn("group_id", group).withColumn("tag", tag(F.col("lo"), F.col("hi"))).drop("longest", "step")


def step_of(longest: Column) -> Column:
    """How many positions a group behind the ninth position has, by the longest read; 1 up to SINGLES positions."""
    widths = F.array(*(F.lit(k * 10**e).cast("long") for e in range(16) for k in (2, 5, 10)))
    fits = F.array_min(F.filter(widths, lambda k: F.ceil((longest - 9) / k) <= RANGES))
    return F.when(longest > SINGLES, fits).otherwise(1)


def base_counts(cube: DataFrame, on: bool = False, longest: DataFrame | None = None) -> DataFrame:
    """(file_id, group_id, tag, a, c, g, t, n): counts of bases."""
    each = [F.coalesce(F.sum(F.when(F.col("base") == b, F.col("n"))), F.lit(0)).alias(b.lower()) for b in "ACGTN"]
    return grouped(cube.groupBy("file_id", "pos", "base").agg(F.sum("n").alias("n")), on, longest).groupBy("file_id", "group_id", "tag").agg(*each)


def base_content(cube: DataFrame, on: bool = False, longest: DataFrame | None = None) -> DataFrame:
    """Shares of A, C, G and T in percent, N left out; null where there are only N."""
    rows = base_counts(cube, on, longest)
    total = F.expr("nullif(a + c + g + t, 0)")
    return rows.select("file_id", "group_id", "tag", *((100.0 * F.col(b) / total).alias(f"{b}_pct") for b in "gatc"))


def n_content(cube: DataFrame, on: bool = False, longest: DataFrame | None = None) -> DataFrame:
    """(file_id, group_id, tag, n, n_pct): N in percent of all bases."""
    rows = base_counts(cube, on, longest)
    return rows.select("file_id", "group_id", "tag", "n", (100.0 * F.col("n") / F.expr("a + c + g + t + n")).alias("n_pct"))


def encoding(cube: DataFrame) -> DataFrame:
    """(file_id, lowest, encoding, offset) by the lowest quality character: under 33 unknown, under 64 Sanger, else Solexa. A character
    over 126 is an error."""
    seen = F.when(F.col("n") > 0, F.col("q"))  # asks for the counts as well, so that what else is made from the cube reads the same exchange
    low = cube.where("q IS NOT NULL").groupBy("file_id").agg(F.min(seen).alias("lowest"), F.max(seen).alias("highest"))
    name = F.when(F.col("highest") > 126, F.raise_error(F.lit("a quality character over 126"))).when(F.col("lowest") < 33, "unknown").when(F.col("lowest") < 64, "Sanger").otherwise("Solexa")
    return low.select("file_id", "lowest", name.alias("encoding"), F.when(F.col("lowest") < 64, 33).otherwise(64).alias("offset"))


def quality_counts(cube: DataFrame, on: bool = False, encodings: DataFrame | None = None, longest: DataFrame | None = None) -> DataFrame:
    """(file_id, group_id, tag, q, n): Phred qualities."""
    rows = grouped(cube.where("q IS NOT NULL").groupBy("file_id", "pos", "q").agg(F.sum("n").alias("n")), on, longest)
    enc = encodings if encodings is not None else encoding(cube)
    phred = rows.join(F.broadcast(enc.select("file_id", "offset")), "file_id").withColumn("q", F.col("q") - F.col("offset"))  # a row a file
    return phred.groupBy("file_id", "group_id", "tag", "q").agg(F.sum("n").alias("n"))


def quantiles(counts: DataFrame, keys: list[str], value: str = "q", n: str = "n") -> DataFrame:
    """Mean and quantiles of histograms: a quantile is the first value whose running count exceeds the share of the total, rounded
    down."""
    along = Window.partitionBy(*keys)
    rows = counts.withColumn("upto", F.sum(n).over(along.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum(n).over(along))
    picks = [F.min(F.when(F.col("upto") > F.expr(f"(total * {a}) div {b}"), F.col(value))).alias(name) for name, (a, b) in QUANTILES.items()]
    return rows.groupBy(*keys).agg((F.sum(F.col(value) * F.col(n)) / F.sum(n)).alias("mean"), *picks)


def quality_by_position(cube: DataFrame, on: bool = False, encodings: DataFrame | None = None, longest: DataFrame | None = None) -> DataFrame:
    """(file_id, group_id, tag, mean, median, lower_quartile, upper_quartile, p10, p90)."""
    return quantiles(quality_counts(cube, on, encodings, longest), ["file_id", "group_id", "tag"])
