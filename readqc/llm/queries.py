"""The queries of this subpackage's operators over the tables of a folder, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readqc.llm.divergence import audit_sql
from readqc.llm.license_scan import scan_sql
from readqc.llm.prefix_trie import prefix_trie_sql
from readqc.llm.sharding import SHARDS, place_sql
from readqc.llm.sql import embedding_dedup_sql, jaccard_join_sql
from readqc.llm.topk import search_sql

SHARD_NAMES = [f"shard-{i:04d}" for i in range(SHARDS)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readqc.llm.kneser_ney import score_all

    return score_all(_table(spark, sf_dir, "documents"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readqc.llm.topk import search

    rows = _table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 100 = 0"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readqc.llm.toxicity import fit, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readqc.llm.jaccard_join import join

    return join(_table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readqc.llm.embedding_dedup import dedup

    return dedup(_table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readqc.llm.quality import fit, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readqc.llm.license_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from readqc.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from readqc.llm.byte_bpe import digests

    return digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readqc.llm.sharding import place

    return place(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARD_NAMES)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readqc.llm.prefix_trie import prefix_trie

    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readqc.llm.divergence import audit

    return audit(_table(spark, sf_dir, "documents"))


def op13_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readqc.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_kneser_ney, op2_exact_top_k, op3_toxicity, op4_ngram_jaccard_join, op5_embedding_dedup, op6_quality_classifier, op7_license_scan, op8_best_fit_packing, op9_byte_bpe, op10_sharding, op11_prefix_trie, op12_source_divergence, op13_pivotal_mixing)}

#: SQL of the operators that SQL can express; the others are tested against brute force in tests/llm.
SQL: dict[str, str] = {"op2_exact_top_k": search_sql(), "op4_ngram_jaccard_join": jaccard_join_sql(), "op5_embedding_dedup": embedding_dedup_sql(), "op7_license_scan": scan_sql(), "op10_sharding": place_sql(SHARD_NAMES), "op11_prefix_trie": prefix_trie_sql(), "op12_source_divergence": audit_sql()}
