"""SAM by Spark's text reader: lines that are no header, split at tabs. Reads are numbered where they are read, by counts that a task carries on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readqc.functions import expr


def _address(path):
    """A file's address, with one slash where local addresses may have one or three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task, whose rows come in the order of their split, with `local`: how many reads with bases come before a read in its split."""
    before: dict[tuple[int, int], int] = {}
    names = ["file_id", "file_name", "part", "local", "name", "seq", "qual"]
    for batch in batches:
        columns = {c: batch.column(batch.schema.get_field_index(c)) for c in names if c != "local"}
        file_id, part = columns["file_id"].to_numpy(), columns["part"].to_numpy()
        some = pc.greater(pc.binary_length(columns["seq"]), 0).fill_null(False).to_numpy(zero_copy_only=False)
        local = np.zeros(batch.num_rows, np.int64)
        cut = np.flatnonzero((file_id[1:] != file_id[:-1]) | (part[1:] != part[:-1])) + 1  # a task may read several splits
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            if lo < hi:
                key = int(file_id[lo]), int(part[lo])
                upto = np.cumsum(some[lo:hi])
                local[lo:hi] = before.get(key, 0) + upto - some[lo:hi]
                before[key] = before.get(key, 0) + int(upto[-1])
        columns["local"] = pa.array(local)
        yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)


def read_sam(spark: SparkSession, files: list[tuple[int, str]]) -> DataFrame:
    """(file_id, file_name, part, local, name, seq, qual) of all (file_id, path) in one scan. `*` for bases is an empty read, for qualities a null.
    Records of any flag count; only the strand bit is looked at. A line of fewer than 11 fields, or with bases and qualities of different length,
    is an error."""
    conf = spark._jsc.hadoopConfiguration()
    whole = lambda p: (q := spark._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).makeQualified(q).toUri().toString()
    known = spark.createDataFrame([(i, p.rstrip("/").rpartition("/")[2], whole(p)) for i, p in files], "file_id int, file_name string, address string").withColumn("address", _address(F.col("address")))
    lines = spark.read.text([p for _, p in files]).select("value", _address(F.col("_metadata.file_path")).alias("address"), F.col("_metadata.file_block_start").alias("part"))
    lines = lines.join(F.broadcast(known), "address")  # a row a file
    fields = lines.where("value NOT LIKE '@%' AND value <> ''").select("file_id", "file_name", "part", F.split(F.rtrim("value"), "\t").alias("f"))
    short = F.raise_error(F.lit("a SAM line has fewer than 11 fields")).cast("array<string>")
    f = fields.select("file_id", "file_name", "part", F.when(F.size("f") >= 11, F.col("f")).otherwise(short).alias("f"))
    seq = F.when(F.col("f")[9] == "*", "").otherwise(F.col("f")[9])
    qual = F.when((F.col("f")[10] == "*") & (F.length(F.col("f")[9]) != 1), F.lit(None)).when(F.col("f")[9] == "*", "").otherwise(F.col("f")[10])
    rows = f.select("file_id", "file_name", "part", F.col("f")[0].alias("name"), F.col("f")[1].cast("int").alias("flag"), seq.alias("seq"), qual.alias("qual"))
    bad = F.raise_error(F.concat(F.lit("bases and qualities differ in length: "), F.col("name"))).cast("string")
    rows = rows.withColumn("qual", F.when(F.col("qual").isNotNull() & (F.length("qual") != F.length("seq")), bad).otherwise(F.col("qual")))
    turned = rows.select(
        "file_id", "file_name", "part", "name",
        expr.oriented(F.col("seq"), F.col("flag"), expr.reverse_complement(F.col("seq"))).alias("seq"), expr.oriented(F.col("qual"), F.col("flag"), F.reverse("qual")).alias("qual"),
    )
    return turned.mapInArrow(numbered, "file_id int, file_name string, part long, local long, name string, seq string, qual string")
