"""Queries do the whole job, on small tables and against plain Python."""

import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from readqc.config import MODULES, RunMode, grade
from readqc.functions.stats import corrected_count, gc_deviation
from readqc.operators import duplicates
from readqc.plans import queries
from readqc.schema import READS

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def original_levels(reads, keys, limit):
    """Levels of the original mode by walking through (index, seq) in order."""
    reads, seen, taken = sorted(reads), set(), 0
    for _, s in reads[:limit]:
        if len(seen) == keys:
            break
        seen.add(s)
        taken += 1
    hist = Counter(n for s, n in Counter(s for _, s in reads).items() if s in seen)
    return {level: int(corrected_count(taken, len(reads), level, n)) for level, n in hist.items()}


@pytest.mark.parametrize("stretch", [16, 65_536])
@pytest.mark.parametrize(("keys", "limit"), [(40, 1000), (1000, 150), (1000, 1000)])
def test_original_mode_takes_the_first_reads_by_number(spark, monkeypatch, keys, limit, stretch):
    monkeypatch.setattr(duplicates, "STRETCH", stretch)
    r = random.Random(4)
    reads = [(7 * i + r.randrange(7), "".join(r.choice("ACGT") for _ in range(3 if i % 3 else 6))) for i in range(400)]
    df = spark.createDataFrame([(0, "f", i, "r", s, "I" * len(s)) for i, s in reads], READS).repartition(3)
    seeded, cut = duplicates.seeds(df, keys, limit)
    got = duplicates.corrected(duplicates.levels(duplicates.original_counts(df, seeded)), cut)
    assert {x.times_seen: x.n_keys for x in got.collect()} == original_levels(reads, keys, limit)


@tables
def test_orig_dups_counts_every_key_under_the_limit(spark):
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
        want = dict(c.sql(f"SELECT times_seen, n_keys FROM ({queries.SQL['dup_levels']})").fetchall())
    assert {x.times_seen: x.n_keys for x in queries.QUERIES["orig_dups"](spark, SF).collect()} == want and sum(want.values()) > 1000


@tables
def test_module_grades_has_the_gc_grade(spark):
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
        want = dict(c.sql(f"SELECT module, grade FROM ({queries.SQL['module_grades']}) WHERE module <> 'gc_sequence'").fetchall())
        hist = np.zeros(101)
        for gc, n in c.sql(f"SELECT gc, n FROM ({queries.SQL['gc_hist_combined']})").fetchall():
            hist[gc] = n
    want["gc_sequence"] = grade(gc_deviation(hist), *RunMode().graders["gc_sequence"])
    got = {r.module: r.grade for r in queries.QUERIES["module_grades"](spark, SF).collect()}
    assert got == want and set(got) == set(MODULES) - {"kmer"}
