"""A corpus pipeline over the operators of readqc.llm: quality, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All
but the last keep the columns of documents and whole rows, and judge each row by its own text. Nulls, empty texts and repeated rows are
treated as the operators say; a row with a null doc_id is never a duplicate. Where the labels teach nothing (none, or of one kind only), the
first two stages keep every row. An empty table has an empty result.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readqc.llm import jaccard_join, packing, quality, toxicity
from readqc.llm.shared import new_folder, written

#: SQL cannot express the stages' learned and iterative steps; tests/llm hold them against brute force and labels.
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, quality.fit(docs, _labels(spark, sf_dir)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not call toxic."""
    return toxicity.clean(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the least doc_id. Rows are judged each by its own text, so two texts under one doc_id
    are two documents, and a repeated row stays once. Rows without words, and those with a null doc_id, all stay."""
    row = next(name for name in (f"row{i}" for i in itertools.count()) if name not in map(str.lower, docs.columns))
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    known = numbered.where("doc_id IS NOT NULL")
    groups = jaccard_join.join(known, key=row).where("n_shingles > 0").select(F.col("doc_id").alias(row), "component_id")
    first = groups.join(known.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(F.struct("doc_id", row)).alias("first"))
    others = groups.join(first.select(F.col(f"first.{row}").alias(row)), row, "left_anti").select(row)
    return numbered.join(others, row, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_quality), ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
