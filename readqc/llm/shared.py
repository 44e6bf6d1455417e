"""What the operators share: settings for Arrow batches, and the columns that they read."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readqc.shared import new_folder, written

__all__ = ["arrow", "few_tasks", "new_folder", "partitions", "release", "texts", "thinned", "written"]

#: Rows and bytes of an Arrow batch: the bytes bound it where texts are long.
BATCH_ROWS, BATCH_BYTES = 500, "8m"


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished work: it does so when the driver's memory is tidied, which a long job of small
    results may not do for hours while disks fill up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def arrow(spark: SparkSession) -> None:
    """Bounds an Arrow batch by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def few_tasks(docs: DataFrame) -> int:
    """By how many tasks at most small results of an exchange are written: some for each core, and as many more as the splits of the input, so that a task's share
    does not grow. Each file that a task writes starts processes of the executor on local file systems, each of which counts as one more of its size for a moment."""
    return max(4 * docs.sparkSession.sparkContext.defaultParallelism, partitions(docs) // 16)


def thinned(rows: DataFrame, limit: int) -> DataFrame:
    """Of rows to learn from each different one once, and `limit` of them at most in expectation, by a hash of all columns: a row
    that comes any number of times can't fill the bound."""
    rows = written(rows.distinct(), "different")
    share = min(1_000_000, 1_000_000 * limit // max(1, rows.count()))
    return written(rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(1_000_000)) < share), "thinned")


def partitions(df: DataFrame) -> int:
    """Partitions for an exchange: as many as the session asks for, and twice the splits of the input, which
    follow its bytes."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * df.rdd.getNumPartitions())


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that text operators read, whatever else the table has."""
    return docs.select(F.col(key).cast(T.LongType()).alias("doc_id"), F.col(text).cast(T.StringType()).alias("text"))
