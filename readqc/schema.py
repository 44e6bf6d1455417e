"""The schema that every source of reads shares."""

from __future__ import annotations

from pyspark.sql import types as T

READS = T.StructType(
    [
        T.StructField("file_id", T.IntegerType(), False),
        T.StructField("file_name", T.StringType(), False),
        T.StructField("read_idx", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("seq", T.StringType(), False),
        T.StructField("qual", T.StringType(), True),
    ]
)
