"""Reads of any number of files of any format, in one DataFrame."""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readqc.shared import written
from readqc.sources import sniff
from readqc.sources.bam import BamSource
from readqc.sources.fastq import BlockSource, FastqSource, parsed
from readqc.sources.sam import read_sam


#: Splits whose running totals are broadcast (a row each, some tens of bytes); with more of them the totals are joined as any table.
SPLITS = 1_000_000


def with_index(rows: DataFrame) -> DataFrame:
    """read_idx, the number of reads with bases before a read in its file, out of its split and place there. A pass over the rows counts
    the splits; their running totals are a row a split, so that the reads themselves stay where they are."""
    size = F.col("bases") if "bases" in rows.columns else F.length("seq")
    sizes = rows.groupBy("file_id", "part").agg(F.count(F.when(size > 0, 1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = sizes.select("file_id", "part", before.alias("before"))
    if rows.rdd.getNumPartitions() <= SPLITS:
        totals = F.broadcast(totals)
    return rows.join(totals, ["file_id", "part"]).withColumn("read_idx", F.col("before") + F.col("local"))


def read_parts(spark: SparkSession, paths: list[str], split_bytes: int | None = None, mode: str = "FAILFAST", kinds: list[str] | None = None) -> DataFrame:
    """(file_id, file_name, part, local, name, seq, qual) over all files; file_id is the place in the list. kinds: the files' formats, where they are known."""
    if not paths:
        raise ValueError("no files")
    files = [(i, path, kind) for i, (path, kind) in enumerate(zip(paths, kinds or map(sniff.detect, paths), strict=True))]
    parts = []
    if mode == "FAILFAST" and (own := [f for f in files if f[2] == "fastq_gz"]):
        spark.dataSource.register(BlockSource)
        blocks = spark.read.format(BlockSource.name()).option("files", json.dumps(own)).load()
        dealt = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file_id", "part")
        parts.append(dealt.mapInArrow(parsed, FastqSource({}).schema()))
        files = [f for f in files if f[2] != "fastq_gz"]
    for source, kinds in ((FastqSource, ("fastq", "fastq_gz", "fastq_bgzf")), (BamSource, ("bam",))):
        if own := [f for f in files if f[2] in kinds]:
            spark.dataSource.register(source)
            reader = spark.read.format(source.name()).option("files", json.dumps(own)).option("mode", mode)
            parts.append((reader.option("splitBytes", split_bytes) if split_bytes else reader).load())
    if own := [(i, path) for i, path, kind in files if kind == "sam"]:
        parts.append(read_sam(spark, own))
    return functools.reduce(DataFrame.unionByName, parts)


def read_malformed(spark: SparkSession, paths: list[str], split_bytes: int | None = None) -> DataFrame:
    """(file_id, file_name, part, lines, text) of the places in FASTQ files that mode DROPMALFORMED leaves out: how many lines, and how they begin."""
    rows = read_parts(spark, paths, split_bytes, "MALFORMED")
    return rows.select("file_id", "file_name", "part", F.col("local").alias("lines"), F.col("name").alias("text"))


COMMON = ["file_id", "file_name", "read_idx", "name", "seq", "qual"]


def read_files(spark: SparkSession, paths: list[str], split_bytes: int | None = None, mode: str = "FAILFAST", index: bool = True) -> DataFrame:
    """The common schema over all files. Without index, read_idx is the place within a split, and no second pass is made."""
    rows = read_parts(spark, paths, split_bytes, mode)
    return (with_index(rows) if index else rows.withColumn("read_idx", F.col("local"))).select(*COMMON)


def staged_files(spark: SparkSession, paths: list[str], split_bytes: int | None = None, mode: str = "FAILFAST", kinds: list[str] | None = None) -> DataFrame:
    """The same and `bases`, each read's length, inflated and parsed once into a table of the shared folder: what further passes are best read from."""
    parts = read_parts(spark, paths, split_bytes, mode, kinds).withColumn("bases", F.length("seq"))
    return with_index(written(parts, "reads")).select(*COMMON, "bases")
