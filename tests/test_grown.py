"""Queries over many reads: each read is made once, only what is asked for is made, and what tasks hold is bounded."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from readqc import derived
from readqc.operators import cube, duplicates, fused, per_read, positions
from readqc.plans.analysis import Analysis
from readqc.plans.queries import QUERIES
from readqc.config import RunMode
from tests.test_fused import files

TABLES = "/root/testdata/sf0.001"
BASES, QUALITIES = "ACGTACGTACGTACGN", "#(-279:<>?@ABCDE"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def conditions(text):
    return [line for line in text.splitlines() if re.search(r"\bFilter\b", line)]


@pytest.mark.parametrize(
    ("query", "without"),
    [
        ("base_content_long_125", QUALITIES), ("base_content_long_301", QUALITIES), ("base_content_grouped", QUALITIES), ("gc_hist_by_len_long_301", "regexp_replace"), ("qual_pos_quantiles", BASES), ("qual_pos_mean", BASES),
        ("kmer_counts", QUALITIES), ("contaminant_match", QUALITIES), ("orig_dups_few_seeds", QUALITIES), ("prefix50", QUALITIES), ("position_cube", "regexp_replace"),
    ],
)
def test_reads_are_made_once(spark, query, without):
    """No condition makes reads again, and the side that is not asked for is not made."""
    text = plan(QUERIES[query](spark, TABLES))
    assert not [c for c in conditions(text) if "md5" in c] and without not in text


def test_lengths_of_derived_reads(spark, tmp_path):
    """The column `bases` is the length, null where the read is null, also of quantities beyond those of the table."""
    assert derived.reads(spark, TABLES).where("NOT bases <=> length(seq)").count() == 0
    rows = [(o, p, 3, n, q) for o in (1, 2, 99, 997) for p in (5, None) for n in (1, 2, 3, 7, None) for q in (-60.0, -46.0, 0.0, 5.0, 33.0, 50.0, 55.0, 75.0, 130.0, None)]
    spark.createDataFrame([(None, *r[1:]) if i % 7 == 0 else r for i, r in enumerate(rows)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    odd = derived.reads(spark, str(tmp_path))
    assert odd.where("bases > 96").count() and odd.where("bases = 0").count() and odd.where("bases IS NULL").count()
    assert [r.asDict() for r in odd.where("NOT bases <=> length(seq)").collect()] == []


def odd_lines(spark, path):
    """A lineitem table of odd numbers: none, negative, and beyond those of the table."""
    rows = [(o, p, 3, n, q) for o in (1, 2, 99, 997, -4) for p in (5, -5, None) for n in (1, 2, 3, 7, None) for q in (-60.0, -46.0, -5.0, 0.0, 5.0, 33.0, 50.0, 55.0, 75.0, 130.0, None)]
    spark.createDataFrame([(None, *r[1:]) if i % 7 == 0 else r for i, r in enumerate(rows)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_reads_of_digits_are_those_of_the_contract(spark, tmp_path):
    """Reads that are cut as digits and translated afterwards are those of the SQL as Spark evaluates it, also of odd lines, and as DuckDB does, whose concat skips nulls."""
    import duckdb

    columns = ["read_idx", "name", "seq", "qual"]
    for folder in (TABLES, odd_lines(spark, tmp_path)):
        got = derived.reads(spark, folder).select(columns)
        if folder == TABLES:
            want = duckdb.sql(derived.duckdb_sql(f"'{folder}/lineitem.parquet'")).select(*columns).fetchall()
        else:
            want = spark.sql(derived.duckdb_sql("{lines}").replace("VARCHAR", "STRING"), lines=spark.read.parquet(f"{folder}/lineitem.parquet")).select(columns).collect()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want)))
        digits = derived.reads(spark, folder, digits=True)
        assert digits.where("seq RLIKE '[^0-9a-f]'").count() == 0
        assert rows(cube.of_bases(digits, derived.DIGITS)) == rows(cube.of_bases(derived.reads(spark, folder)))


@pytest.mark.parametrize("query", ["base_content", "n_content", "base_content_grouped", "base_content_long_125", "base_content_long_301"])
def test_reads_to_count_bases_of_are_not_translated(spark, query):
    """Letters are looked up where they are counted: Spark's translation of each letter took most of the time that reads took."""
    assert "translate(" not in plan(QUERIES[query](spark, TABLES))


def test_letters_that_stand_for_bases(spark):
    df = files(spark)
    there, back = "ACGTNacgtn", "0123456789"
    coded = df.withColumn("seq", F.translate("seq", there, back))
    assert rows(cube.of_bases(coded, (back, there))) == rows(cube.of_bases(df))
    assert {r.base for r in cube.of_bases(df, ("A", "C")).collect()} <= {"C", "N"}


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_sides_of_the_cube(spark):
    df = files(spark)
    whole = cube.exploded(df).persist()
    assert rows(cube.of_bases(df)) == rows(whole.groupBy("file_id", "pos", "base").sum("n").withColumnRenamed("sum(n)", "n"))
    assert rows(cube.of_qualities(df)) == rows(whole.where("q IS NOT NULL").groupBy("file_id", "pos", "q").sum("n").withColumnRenamed("sum(n)", "n"))
    assert rows(positions.encoding(cube.of_qualities(df))) == rows(positions.encoding(whole))
    both = per_read.qualities(df).persist()
    assert rows(both.where("chars > 0").selectExpr("file_id", "q", "chars AS n")) == rows(whole.where("q IS NOT NULL").groupBy("file_id", "q").sum("n").withColumnRenamed("sum(n)", "n"))


@pytest.mark.parametrize(("name", "column"), [("of_bases", "seq"), ("of_qualities", "qual")])
def test_sides_are_counted_by_pieces(spark, monkeypatch, name, column):
    """What is worked out of a batch at once is bounded, a longer read by itself, and the counts are the same."""
    df = files(spark, parts=1)
    tables, seen, sizes, keep, add = [], [], [], type(df).mapInArrow, cube._Counter.add
    monkeypatch.setattr(type(df), "mapInArrow", lambda own, f, schema: seen.append((own, f)) or keep(own, f, schema))
    want = rows(getattr(cube, name)(df))
    monkeypatch.setattr(cube._Counter, "add", lambda own, keys: sizes.append(len(keys)) or add(own, keys))
    monkeypatch.setattr(cube, "PIECE", 40, raising=False)
    ((own, run),) = seen
    for batch in run(iter(own.toArrow().to_batches())):
        tables += batch.to_pylist()
    assert rows(spark.createDataFrame(tables)) == want
    assert max(sizes) == df.selectExpr(f"max(length({column}))").first()[0] > 40 and len(sizes) > 100


@pytest.mark.parametrize("query", ["base_content_long_301", "base_content_grouped"])
def test_grouped_bases_come_from_one_kernel(spark, query):
    """The longest read comes from the exchange that the counts come from, in groups of either size."""
    df = QUERIES[query](spark, TABLES)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("MapInArrow") == 1, final


@pytest.mark.parametrize("query", ["qual_pos_quantiles", "qual_pos_mean", "base_content_long_125"])
def test_one_kernel_a_query(spark, query):
    """The encoding and the longest read come from the exchange that the counts come from."""
    df = QUERIES[query](spark, TABLES)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("MapInArrow") == 1, final


def test_lengths_and_kmers_need_few_reads(spark):
    """Of reads that are not taken for k-mers only the length is asked for."""
    df = files(spark)
    counts = fused.count(df, None, [fused.LENGTH, fused.KMER], kmers=3)
    assert rows(fused.part(counts, fused.LENGTH)) == rows(per_read.lengths(df))
    assert rows(fused.part(counts, fused.KMER)) == rows(fused.part(fused.count(df, None, [fused.KMER], kmers=3), fused.KMER))
    text = plan(Analysis(derived.reads(spark, TABLES), RunMode(enabled=frozenset(["kmer"])))._count(frozenset([fused.LENGTH, fused.KMER])))
    assert text.count(BASES) and not [c for c in conditions(text) if "md5" in c] and QUALITIES not in text


def test_places_of_kmers_are_bounded(monkeypatch):
    """What a task holds of k-mers follows the places, not the reads."""
    monkeypatch.setattr(fused, "MERGE", 10_000)
    r, own, every = np.random.default_rng(1), fused._Places(), []
    most = 20 * 4**fused.K
    for _ in range(60):
        every.append(r.integers(4**fused.K, most, 3_000))
        own.add(every[-1])
        assert own.dense.nbytes + sum(x.nbytes for x in own.waiting) <= 8 * most + 4 * 13_000
    keys, n = (np.concatenate(x) for x in zip(*own.items(), strict=True))
    want = np.unique(np.concatenate(every), return_counts=True)
    assert (keys == want[0]).all() and (n == want[1]).all()


def test_seeds_ask_for_the_first_reads_only(spark, monkeypatch):
    """Reads beyond the last stretch that holds a first read are dropped by their index before they are made."""
    seen = []
    keep = duplicates.written
    monkeypatch.setattr(duplicates, "written", lambda df, what: seen.append((what, plan(df))) or keep(df, what))
    monkeypatch.setattr(duplicates, "STRETCH", 512)
    seeded, cut = duplicates.seeds(derived.reads(spark, TABLES), 50, 300)
    assert [what for what, _ in seen] == ["stretches", "order"] and "md5" not in seen[0][1]
    assert any("l_orderkey" in c and " < " in c for c in conditions(seen[1][1])) and not [c for c in conditions(seen[1][1]) if "md5" in c]
    assert "md5" not in plan(cut) and seeded.count() == 50


def test_small_results_of_the_join_are_few_files(spark, monkeypatch):
    """Links and labels are written by a bounded number of tasks, however many partitions an exchange has; the result is the same."""
    from readqc.llm import components as c
    from readqc.llm import jaccard_join, shared

    seen, keep = [], c.written
    monkeypatch.setattr(c, "written", lambda df, what: seen.append(df) or keep(df, what))
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60, 3)], "u long, v long").repartition(40, "u")
    got = {r.id: r.component for r in c.components(links, 3).collect()}
    assert got == {i + k: i for i in range(0, 60, 3) for k in (0, 1)}
    assert seen and all("Repartition 3, false" in plan(df) for df in seen)
    assert jaccard_join.few_tasks is shared.few_tasks and shared.few_tasks(spark.range(9)) >= 4
