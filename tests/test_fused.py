"""The one-scan kernel and the finishing of files, against the operators module by module."""

import math
import random

import pytest

from readqc.config import MODULES, RunMode, grade
from readqc.operators import adapters, cube, duplicates, fused, kmers, per_read
from readqc.plans import finish
from readqc.plans.analysis import Analysis
from readqc.schema import READS
from readqc.sources.dims import DEFAULT_ADAPTERS
from tests.test_operators import random_reads


def files(spark, parts=4, n=260, long=0):
    """Two files of unlike lengths, with tiles, copies and adapters, and one without bases."""
    r = random.Random(8)
    rows = []
    for f, longest in ((0, 60), (1, 330)):
        for i, (s, q) in enumerate(random_reads(n, f)):
            s, q = s[:longest], q and q[:longest]
            if i % 9 == 0 and len(s) > 40:
                s = s[:20] + r.choice(DEFAULT_ADAPTERS)[1].lower() + s[32:]
            if i % 5 == 0:
                s, q = "ACGTN" * 11, "I" * 55
            rows.append((f, f"f{f}", i, f"A:1:F:1:{1101 + i % 3}:1:{i}" if f else f"A:1:{7 + i % 2}:x:{i}", s, q))
    rows += [(2, "f2", i, "r", "", "") for i in range(3)]
    rows += [(3, "f3", i, "A:1:2:3:4", "ACGT" * long, "IIH#" * long) for i in range(4) if long]
    return spark.createDataFrame(rows, READS).repartition(parts)


@pytest.mark.parametrize("piece", [40, 2_000_000])
def test_families_equal_the_operators(spark, monkeypatch, piece):
    monkeypatch.setattr(fused, "PIECE", piece)
    df = files(spark)
    whole = fused.count(df, None, fused.FAMILIES, DEFAULT_ADAPTERS).persist()
    rows = lambda x: sorted(map(str, (r.asDict().items() for r in x.select(*sorted(x.columns)).collect())))
    for family, want in {
        fused.CUBE: cube.exploded(df), fused.LENGTH: per_read.lengths(df), fused.GC: per_read.gc_by_length(df), fused.QUALITY: per_read.mean_quality(df), fused.KEY: duplicates.key_counts(df),
        fused.ADAPTER: adapters.searched(df, DEFAULT_ADAPTERS), fused.KMER: kmers.exploded(df),
    }.items():
        assert rows(fused.part(whole, family)) == rows(want), family
    assert whole.where(f"family = {fused.TILE}").count() == 0
    whole.unpersist()


def test_one_scan_and_one_exchange(spark):
    plan = fused.count(files(spark, 3), None, fused.FAMILIES, DEFAULT_ADAPTERS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan


def test_many_adapters_at_once(spark):
    r = random.Random(3)
    own = [(f"a{i}", "".join(r.choice("ACGT") for _ in range(r.choice([3, 6, 16])))) for i in range(40)] + [("n", "ACNT"), ("r", "GRT"), ("again", "AAAAAA"), ("twice", "AAAAAA"), ("x" * 30, "ACGT" * 8)]
    df = files(spark)
    got, want = ({(r.file_id, r.adapter_id, r.pos): r.n for r in f(df, own).collect()} for f in (adapters.hits, adapters.searched))
    assert got == want and len(want) > 100


def near(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and (math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


@pytest.mark.parametrize(("groups", "form"), [(False, {"original_duplicates": True}), (True, {"bisulfite": True})])
def test_a_finished_file_equals_its_modules(spark, monkeypatch, groups, form):
    monkeypatch.setattr(duplicates, "SEED_KEYS", 30)
    mode = RunMode(enabled=frozenset(MODULES), groups=groups, **form)
    a = Analysis(files(spark), mode)
    counts = a.file_rows().toArrow().to_batches()
    grades = {(r.file_id, r.module): r.grade for r in a.grades().collect()}
    for f in (0, 1, 2):
        own = [b.filter([x == f for x in b.column(0).to_pylist()]) for b in counts]
        results, _ = finish.finished(finish.of_batches(own, mode, DEFAULT_ADAPTERS))
        assert set(results) == set(MODULES)
        for module, rows in results.items():
            want = [{k: v for k, v in r.asDict().items() if k not in ("file_id",)} for r in a.result(module).where(f"file_id = {f}").collect()]
            key = lambda r: [str(r.get(c)) for c in ("tile", "group_id", "adapter_id", "quality", "gc", "length", "bin_no", "rank")]
            rows, want = sorted(rows, key=key), sorted(want, key=key)
            assert len(rows) == len(want), (f, module)
            for x, y in zip(rows, want, strict=True):
                assert set(x) == set(y) and all(near(x[c], y[c]) for c in x), (f, module, x, y)
        for module in set(MODULES) - {"basic_stats", "sequence_length"}:
            s = a.statistic(module).where(f"file_id = {f}").first()
            if s is None:
                assert grades[f, module] == "pass"
            elif module == "quality_base":
                both = [grade(v, *mode.graders[k]) for v, k in ((s["value"], "quality_base_median"), (s["lower"], "quality_base_lower"))]
                assert grades[f, module] == max(both, key=["pass", "warn", "fail"].index)
            else:
                assert grades[f, module] == grade(s["value"], *mode.graders[module]), (f, module)
    a.close()


def test_long_reads_are_counted_by_groups(spark):
    a = Analysis(files(spark, 2, 20, 50_000), RunMode(groups=True))
    known = fused.settings(a.files, True)
    assert {r.file_id: r.step for r in known.collect()}[3] == 5000
    rows = a.counts.where(f"file_id = 3 AND family = {fused.CUBE}").collect()
    assert len(rows) < 60 * 4 * 3 and sum(r.n for r in rows) == 4 * 200_000
    assert a.counts.where(f"file_id = 3 AND family = {fused.TILE}").count() <= 60
    got = {r.tag: r["mean"] for r in a.result("quality_base").where("file_id = 3").collect()}
    assert got["1"] == 40 and got["195010-200000"] == pytest.approx((40 + 40 + 39 + 2) / 4, abs=0.01) and len(got) == 49
    a.close()
