"""Duplication: counts of 50-base prefixes, their levels, overrepresented keys and the contaminants that they look like."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readqc.functions import expr
from readqc.functions.stats import corrected_count
from readqc.shared import written

#: Lower ends of the bins of duplication levels, and their labels.
BINS = [(i, str(i)) for i in range(1, 10)] + [(10, ">10"), (50, ">50"), (100, ">100"), (500, ">500"), (1000, ">1k"), (5000, ">5k"), (10000, ">10k")]
#: Reads up to which all are counted; keys and reads that the original mode takes up.
FULL, SEED_KEYS, SEED_READS = 1_000_000, 100_000, 1_000_000
OVERREPRESENTED = 0.001
#: Seeds at most whose hashes, 12 bytes each, go to all executors.
PROBES = 2_000_000
#: Width of the stretches of indexes in which reads are numbered.
STRETCH = 65_536


def stride(n_reads: int) -> int:
    """Every how many reads one is counted."""
    return 1 if n_reads < FULL else 1 + n_reads // FULL


def sampled(reads: DataFrame, every: int, index: str = "read_idx") -> DataFrame:
    """Every so-manieth read by its index, whatever the partitioning."""
    return reads if every == 1 else reads.where(F.pmod(F.col(index), F.lit(every)) == 0)


def key_counts(reads: DataFrame, every: int = 1) -> DataFrame:
    """(file_id, seq, n) of the first 50 bases of reads. Partial counts come before the exchange, so one frequent key is one row a task."""
    some = expr.some(sampled(reads, every))
    return some.groupBy("file_id", expr.prefix(F.col("seq")).alias("seq")).agg(F.count("*").alias("n"))


def levels(counts: DataFrame) -> DataFrame:
    """(file_id, times_seen, n_keys): how many keys were seen how often; the histogram that library-complexity tools read."""
    return counts.groupBy("file_id", F.col("n").alias("times_seen")).agg(F.count("*").alias("n_keys"))


def binned(hist: DataFrame) -> DataFrame:
    """(file_id, bin_no, bin, mass_pct): reads by the level of their key, in percent, all bins present."""
    bins = hist.sparkSession.createDataFrame([(i, label) for i, (_, label) in enumerate(BINS)], "bin_no int, bin string")
    number = F.lit(-1)
    for i, (low, _) in enumerate(BINS):
        number = F.when(F.col("times_seen") >= low, i).otherwise(number)
    mass = hist.groupBy("file_id", number.alias("bin_no")).agg(F.sum(F.col("times_seen") * F.col("n_keys")).alias("mass"))
    total = mass.groupBy("file_id").agg(F.sum("mass").alias("total"))
    grid = total.join(F.broadcast(bins))  # sixteen rows for each file
    return grid.join(mass, ["file_id", "bin_no"], "left").select("file_id", "bin_no", "bin", (100.0 * F.coalesce("mass", F.lit(0)) / F.greatest("total", F.lit(1))).alias("mass_pct"))


def summary(hist: DataFrame) -> DataFrame:
    """(file_id, n_keys, n_counted, max_level, dedup_pct)."""
    return hist.groupBy("file_id").agg(
        F.sum("n_keys").alias("n_keys"), F.sum(F.col("times_seen") * F.col("n_keys")).alias("n_counted"), F.max("times_seen").alias("max_level"),
        (100.0 * F.sum("n_keys") / F.greatest(F.sum(F.col("times_seen") * F.col("n_keys")), F.lit(1))).alias("dedup_pct"),
    )


def _stretch():
    return F.floor(F.col("read_idx") / STRETCH)


def stretches(reads: DataFrame) -> DataFrame:
    """(file_id, stretch, here): how many reads with bases each stretch of indexes holds; written, as it is asked several things."""
    return written(expr.some(reads).groupBy("file_id", _stretch().alias("stretch")).agg(F.count("*").alias("here")), "stretches")


def first_reads(reads: DataFrame, sizes: DataFrame, limit: int) -> DataFrame:
    """(file_id, seq, at) of the first `limit` reads with bases a file by read_idx, which may have gaps; at counts them from 0. Rows are numbered within stretches
    of indexes, see `stretches`, so that no task holds all rows of a file. Bases of reads beyond the last stretch that any file needs are never asked for."""
    before = sizes.withColumn("before", F.sum("here").over(Window.partitionBy("file_id").orderBy("stretch")) - F.col("here")).where(F.col("before") < limit)
    # before: a row for each stretch that has any of the first reads
    within = F.row_number().over(Window.partitionBy("file_id", "stretch").orderBy("read_idx", "seq"))
    last = before.agg(F.max("stretch")).first()[0]
    some = expr.some(reads.where(F.col("read_idx") < ((-1 if last is None else last) + 1) * STRETCH)).select("file_id", "read_idx", expr.prefix(F.col("seq")).alias("seq"))
    rows = some.withColumn("stretch", _stretch()).join(F.broadcast(before.drop("here")), ["file_id", "stretch"])
    return rows.select("file_id", "seq", (F.col("before") + within - 1).alias("at")).where(F.col("at") < limit)


def seeds(reads: DataFrame, keys: int = SEED_KEYS, limit: int = SEED_READS) -> tuple[DataFrame, DataFrame]:
    """The keys of the original mode: those first seen among the first reads, until there are `keys` of them or `limit` reads; and for each
    file (file_id, count_at_limit), the reads that this took. No read is walked through in order: a key's first place is a
    minimum, and the cut-off the place of the keys-th smallest."""
    sizes = stretches(reads)
    first = first_reads(reads, sizes, limit).groupBy("file_id", "seq").agg(F.min("at").alias("at"))
    # of at most `limit` rows a file
    order = written(first.withColumn("k", F.row_number().over(Window.partitionBy("file_id").orderBy("at", "seq"))).where(F.col("k") <= keys), "order")
    last = order.groupBy("file_id").agg(F.max("at").alias("last"), F.count("*").alias("many"))
    total = sizes.groupBy("file_id").agg(F.sum("here").alias("n"))
    cut = total.join(last, "file_id").select("file_id", F.when(F.col("many") >= keys, F.col("last") + 1).otherwise(F.least(F.col("n"), F.lit(limit))).alias("count_at_limit"), F.col("n").alias("n_reads"))
    return order.select("file_id", "seq"), cut


def original_counts(reads: DataFrame, seeded: DataFrame) -> DataFrame:
    """Counts of the seeded keys over all reads. A read is dropped where it is read unless its key may be a seed, by the hashes of up to PROBES seeds, so what is
    exchanged are seeds and no other keys; with more seeds the keys of all reads are."""
    seeded = written(seeded, "seeds")
    # reads with bases have a key; said so, as a join's own condition that it is not null would make it once more
    keys = expr.some(reads).select("file_id", F.coalesce(expr.prefix(F.col("seq")), F.lit("")).alias("seq"))
    if seeded.count() <= PROBES:
        hashes = seeded.select("file_id", F.xxhash64("seq").alias("h"))
        keys = keys.withColumn("h", F.xxhash64("seq")).join(F.broadcast(hashes), ["file_id", "h"], "left_semi").drop("h")  # at most PROBES rows, which was counted
    counts = keys.groupBy("file_id", "seq").agg(F.count("*").alias("n"))
    return seeded.join(counts, ["file_id", "seq"], "left").select("file_id", "seq", F.coalesce("n", F.lit(0)).alias("n"))


def corrected(hist: DataFrame, cut: DataFrame) -> DataFrame:
    """levels() of the original mode, scaled up by what the seeding may have missed. A row for each level: few."""

    @F.pandas_udf("long")
    def fix(limit: pd.Series, n: pd.Series, level: pd.Series, seen: pd.Series) -> pd.Series:
        return pd.Series([int(corrected_count(*x)) for x in zip(limit.tolist(), n.tolist(), level.tolist(), seen.tolist(), strict=True)], dtype="int64")

    return hist.join(F.broadcast(cut), "file_id").select("file_id", "times_seen", fix("count_at_limit", "n_reads", "times_seen", "n_keys").alias("n_keys"))  # cut: a row a file


def overrepresented(counts: DataFrame, share: float = OVERREPRESENTED) -> DataFrame:
    """(file_id, rank, seq, n, pct) of keys with at least that share of the counted reads, most frequent first."""
    total = counts.groupBy("file_id").agg(F.sum("n").alias("total"))
    many = counts.join(F.broadcast(total), "file_id").where(F.col("n") >= share * F.col("total"))  # total: a row a file
    # a thousand rows a file at most, as each has a thousandth of the reads
    order = Window.partitionBy("file_id").orderBy(F.col("n").desc(), *(k.desc() for k in expr.key_rank(F.col("seq"))))
    return many.select("file_id", F.row_number().over(order).alias("rank"), "seq", "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))


def overlap(left, right):
    """The longest piece of left that right begins with, as a column."""
    most = F.least(F.length(left), F.length(right))
    sizes = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(sizes, F.lit(0), lambda best, k: F.when(F.contains(left, F.substring(right, F.lit(1), k)), F.greatest(best, k)).otherwise(best))


#: Bases of the pieces by which keys and contaminants meet: the longest first, and the next only for keys that met nothing.
PIECES = (8, 4)


def _meetings(keys: DataFrame, contaminants: DataFrame, k: int) -> DataFrame:
    """(file_id, rank, contam_id): pairs of which one holds the first k bases of the other, once each."""

    def pieces(seq):
        places = F.when(F.length(seq) >= k, F.sequence(F.lit(1), F.length(seq) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(seq, i, F.lit(k)))))

    own, other = keys.where(F.length("seq") >= k), contaminants.where(F.length("c") >= k)
    begins = own.select("file_id", "rank", pieces(F.col("seq")).alias("piece")).join(other.select("contam_id", F.substring("c", 1, k).alias("piece")), "piece")
    holds = own.select("file_id", "rank", F.substring("seq", 1, k).alias("piece")).join(other.select("contam_id", pieces(F.col("c")).alias("piece")), "piece")
    return begins.unionByName(holds).select("file_id", "rank", "contam_id").distinct()


def contaminant_match(over: DataFrame, contaminants: DataFrame) -> DataFrame:
    """over with source: the contaminant with the longest overlap in either direction, the first of equals, if that reaches half of the
    shorter sequence; else `No Hit`. An overlap of k bases and more is one in which a first piece of k bases is found, so keys and contaminants meet by pieces: a
    key that meets any by 8 bases has its best among these. One that meets none by 4 can only have a hit where it or a contaminant has under 8 bases; for such alone
    single bases are the pieces."""
    contaminants = contaminants.select("contam_id", F.col("name").alias("source"), F.upper("seq").alias("c"))
    least = 2 * PIECES[-1]
    left, met = written(over, "over"), []
    short = contaminants.where(F.length("c") < least).limit(1).count() > 0
    for k in (*PIECES, 1):
        keys = left if k > 1 or short else left.where(F.length("seq") < least)
        found = written(_meetings(keys.select("file_id", "rank", "seq"), contaminants, k), "met")
        met.append(found)
        left = left.join(found.select("file_id", "rank").distinct(), ["file_id", "rank"], "left_anti")
    pairs = functools.reduce(DataFrame.unionByName, met).join(over.select("file_id", "rank", "seq"), ["file_id", "rank"]).join(contaminants, "contam_id")
    scored = pairs.withColumn("score", F.greatest(overlap(F.col("seq"), F.col("c")), overlap(F.col("c"), F.col("seq"))))
    best = scored.groupBy("file_id", "rank").agg(F.min_by(F.struct("source", "c", "score"), F.struct(-F.col("score"), "contam_id")).alias("best"))
    hit = (F.col("best.score") > 0) & (F.col("best.score") >= F.expr("least(length(best.c), length(seq)) div 2"))
    return over.join(best, ["file_id", "rank"], "left").select("file_id", "rank", "seq", "n", "pct", F.when(hit, F.col("best.source")).otherwise("No Hit").alias("source"))
