"""k-mer enrichment: 7-mers of every fiftieth read by place, against what their shares would give."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readqc.functions.expr import bases
from readqc.functions.stats import poisson_above
from readqc.operators import fused
from readqc.operators.duplicates import sampled

K, EVERY, LONGEST, TOP, LEAST_RATIO, MOST_P = fused.K, fused.KMERS, fused.KMER_BASES, 20, 5.0, 0.01


def counts(reads: DataFrame, every: int = EVERY) -> DataFrame:
    """(file_id, pos, kmer, n); N counts as G."""
    return fused.part(fused.count(reads, None, [fused.KMER], kmers=every), fused.KMER)


def exploded(reads: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """The same by a row for each k-mer, the plain meaning."""
    some = sampled(reads, every).where(F.length("seq") >= k)
    seq = F.translate(bases(F.substring("seq", 1, LONGEST)), "N", "G")
    each = some.select("file_id", seq.alias("s")).select("file_id", "s", F.explode(F.expr(f"sequence(1, length(s) - {k - 1})")).alias("pos"))
    return each.groupBy("file_id", "pos", F.substring(F.col("s"), F.col("pos"), F.lit(k)).alias("kmer")).agg(F.count("*").alias("n"))


def ratios(cells: DataFrame) -> DataFrame:
    """(file_id, kmer, n, obs_exp, pos): each k-mer's largest ratio of observed to expected and the first place of it. There are 16,384
    k-mers at 494 places at most, whatever the input."""
    by_kmer = cells.groupBy("file_id", "kmer").agg(F.sum("n").alias("of_kmer"))
    by_pos = cells.groupBy("file_id", "pos").agg(F.sum("n").alias("of_pos"))
    total = by_pos.groupBy("file_id").agg(F.sum("of_pos").alias("total"))
    rows = cells.join(by_kmer, ["file_id", "kmer"]).join(F.broadcast(by_pos.join(total, "file_id")), ["file_id", "pos"])  # a row a place
    rows = rows.withColumn("ratio", F.col("n") * F.col("total") / (F.col("of_kmer").cast("double") * F.col("of_pos")))
    first = Window.partitionBy("file_id", "kmer").orderBy(F.col("ratio").desc(), "pos")
    return rows.withColumn("k", F.row_number().over(first)).where("k = 1").select("file_id", "kmer", F.col("of_kmer").alias("n"), F.col("ratio").alias("obs_exp"), "pos")


def p_values(cells: DataFrame, kmers: DataFrame, k: int = K) -> DataFrame:
    """(file_id, kmer, pvalue): the least Poisson chance over places of more than the count there, times the number of k-mers, 1 at
    most. kmers limits what is worked out."""
    by_kmer = cells.groupBy("file_id", "kmer").agg(F.sum("n").alias("of_kmer"))
    by_pos = cells.groupBy("file_id", "pos").agg(F.sum("n").alias("of_pos"))
    total = by_pos.groupBy("file_id").agg(F.sum("of_pos").alias("total"))
    # absent cells count too: with no k-mer at a place the chance of more than 0 may be the least
    some = kmers.select("file_id", "kmer").join(by_kmer, ["file_id", "kmer"])
    rows = some.join(F.broadcast(by_pos.join(total, "file_id")), "file_id").join(cells, ["file_id", "kmer", "pos"], "left").select("file_id", "kmer", F.coalesce("n", F.lit(0)).alias("n"), (F.col("of_kmer") / F.col("total") * F.col("of_pos")).alias("mu"))

    @F.pandas_udf("double")
    def above(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for n, mu in batches:
            yield pd.Series(poisson_above(n.to_numpy(), mu.to_numpy()))

    return rows.withColumn("p", above("n", "mu")).groupBy("file_id", "kmer").agg(F.least(F.lit(1.0), float(4**k) * F.min("p")).alias("pvalue"))


def enriched(cells: DataFrame, top: int = TOP) -> DataFrame:
    """(file_id, rank, kmer, n, pvalue, obs_exp, pos) of k-mers with a ratio of 5 or more and a p-value of 0.01 or less, the largest ratios
    first."""
    some = ratios(cells).where(F.col("obs_exp") >= LEAST_RATIO)
    rows = some.join(p_values(cells, some), ["file_id", "kmer"]).where(F.col("pvalue") <= MOST_P)
    order = Window.partitionBy("file_id").orderBy(F.col("obs_exp").desc(), F.translate("kmer", "ACTG", "0123"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("file_id", "rank", "kmer", "n", "pvalue", "obs_exp", "pos")


def neg_log10(p: float) -> float:
    return -float(np.log10(p)) if p > 0 else float(np.finfo(float).max)
