"""Histograms of whole reads: no explode, one exchange of a few hundred rows each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readqc.functions import expr
from readqc.operators.cube import _flat


def lengths(reads: DataFrame) -> DataFrame:
    """(file_id, length, n), reads without bases included."""
    return reads.groupBy("file_id", F.length("seq").alias("length")).agg(F.count("*").alias("n"))


def dense_lengths(hist: DataFrame) -> DataFrame:
    """The same from the shortest to the longest length without gaps."""
    span = hist.groupBy("file_id").agg(F.min("length").alias("lo"), F.max("length").alias("hi"))
    grid = span.select("file_id", F.explode(F.sequence("lo", "hi")).alias("length"))
    return grid.join(hist, ["file_id", "length"], "left").select("file_id", "length", F.coalesce("n", F.lit(0)).alias("n"))


def length_summary(hist: DataFrame) -> DataFrame:
    """(file_id, n_reads, total_bases, min_len, max_len, mean_len, median_len)."""
    from readqc.operators.positions import quantiles

    total = hist.groupBy("file_id").agg(
        F.sum("n").alias("n_reads"), F.sum(F.col("length").cast("long") * F.col("n")).alias("total_bases"), F.min("length").alias("min_len"), F.max("length").alias("max_len")
    )
    middle = quantiles(hist, ["file_id"], "length").select("file_id", F.col("mean").alias("mean_len"), F.col("median").alias("median_len"))
    return total.join(F.broadcast(middle), "file_id")  # a row a file


def gc_by_length(reads: DataFrame) -> DataFrame:
    """(file_id, len_bin, gc_bin, n) of reads with bases."""
    length, gc = expr.gc_bin(F.col("seq"))
    return expr.some(reads).groupBy("file_id", length.alias("len_bin"), gc.alias("gc_bin")).agg(F.count("*").alias("n"))


def gc_combined(hist: DataFrame) -> DataFrame:
    """(file_id, gc, n) with gc 0 .. 100: each count spreads over the bins that its share of the scale overlaps."""
    width = F.lit(101.0) / (F.col("len_bin") + 1)
    rows = hist.withColumn("lo", F.col("gc_bin") * width).withColumn("hi", (F.col("gc_bin") + 1) * width).withColumn("width", width)
    first, last = F.floor("lo").cast("int"), (F.least(F.lit(101), F.ceil("hi")) - 1).cast("int")
    each = rows.withColumn("gc", F.explode(F.sequence(first, F.greatest(first, last))))
    share = F.when(first == last, F.col("width")).when(F.col("gc") == first, first + 1 - F.col("lo")).when(F.col("gc") == last, F.col("hi") - last).otherwise(1.0)
    # in a set order, so that the sum of doubles is the same on any machine; some thousand numbers a bin at most, one for each length and count
    held = F.sort_array(F.collect_list(F.struct("len_bin", "gc_bin", (F.col("n") / F.col("width") * share).alias("part"))))
    return each.groupBy("file_id", "gc").agg(F.aggregate(held, F.lit(0.0), lambda total, x: total + x["part"]).alias("n"))


def mean_quality(reads: DataFrame) -> DataFrame:
    """(file_id, q, n): the floor of the mean quality character of each read with qualities. Counted by the batch."""
    return qualities(reads).where("n > 0").select("file_id", "q", "n")


def qualities(reads: DataFrame) -> DataFrame:
    """(file_id, q, n, chars): for each character of how many reads with qualities it is the floor of the mean, and how often it stands in reads that have as many
    qualities as bases. By one scan, which does not read the bases where reads have their lengths as `bases`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}  # 2 x 256 counts a file
        for batch in batches:
            if not batch.num_rows:
                continue
            file_id = batch.column(0).to_numpy()
            data, at = _flat(batch.column(1))
            size = np.diff(at)
            sums = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
            mean = (sums[at[1:]] - sums[at[:-1]]) // np.maximum(size, 1)
            whole = size == pc.fill_null(batch.column(2), 0).to_numpy()
            for f in np.unique(file_id).tolist():
                own = file_id == f
                counts = total.setdefault(f, np.zeros((2, 256), np.int64))
                counts[0] += np.bincount(mean[own & (size > 0)], minlength=256)
                own &= whole
                counts[1] += np.bincount(data if own.all() else data[np.repeat(own, size)], minlength=256)
        for f, counts in total.items():
            q = np.flatnonzero(counts.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), f), pa.int32()), pa.array(q, pa.int32()), *map(pa.array, counts[:, q])], ["file_id", "q", "n", "chars"])

    length = F.col("bases") if "bases" in reads.columns else F.octet_length("seq")
    partial = reads.select("file_id", "qual", length.cast("long").alias("bases")).mapInArrow(run, "file_id int, q int, n long, chars long")
    return partial.groupBy("file_id", "q").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))


def quality_by_read(reads: DataFrame, encodings: DataFrame) -> DataFrame:
    """(file_id, quality, n) in Phred units."""
    return in_phred(mean_quality(reads), encodings)


def in_phred(hist: DataFrame, encodings: DataFrame) -> DataFrame:
    """The histogram of mean quality characters in Phred units."""
    return hist.join(F.broadcast(encodings.select("file_id", "offset")), "file_id").select("file_id", (F.col("q") - F.col("offset")).alias("quality"), "n")  # a row a file


def trimmed(hist: DataFrame, value: str) -> DataFrame:
    """A histogram from its first to its last value without gaps."""
    span = hist.groupBy("file_id").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    grid = span.select("file_id", F.explode(F.sequence("lo", "hi")).alias(value))
    return grid.join(hist, ["file_id", value], "left").select("file_id", value, F.coalesce("n", F.lit(0)).alias("n"))
