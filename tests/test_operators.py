import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readqc.config import MODULES, RunMode
from readqc.functions import expr
from readqc.operators import adapters, cube, duplicates, kmers, per_read, positions, tiles
from readqc.plans.analysis import Analysis
from readqc.schema import READS
from tests.model import counts

READ = st.tuples(st.text("ACGTNacgnR", max_size=300), st.booleans())


def frame(spark, reads, names=None, file_id=0, parts=3):
    rows = [(file_id, f"f{file_id}", i, names[i] if names else f"r{i}", s, q) for i, (s, q) in enumerate(reads)]
    return spark.createDataFrame(rows, READS).repartition(parts)


def random_reads(n, seed=0):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        k = r.choice([0, 1, 5, 49, 50, 51, 75, 100, 249, 250, 251, 300])
        s = "".join(r.choice("ACGTNacgtnR") for _ in range(k))
        out.append((s, None if r.random() < 0.1 else "".join(chr(r.randint(35, 73)) for _ in range(k))))
    return out


def check(spark, reads, parts):
    df = frame(spark, reads, parts=parts)
    want = counts(reads)
    for form in (cube.exploded, cube.counted):
        assert {(r.pos, r.base, r.q): r.n for r in form(df).collect()} == want["cube"]
    assert {r.length: r.n for r in per_read.lengths(df).collect()} == want["length"]
    assert {(r.len_bin, r.gc_bin): r.n for r in per_read.gc_by_length(df).collect()} == want["gc"]
    assert {r.q: r.n for r in per_read.mean_quality(df).collect()} == want["quality"]
    assert {r.seq: r.n for r in duplicates.key_counts(df).collect()} == want["prefix"]


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_counts_do_not_depend_on_partitions(spark, parts):
    check(spark, random_reads(300), parts)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(READ, max_size=12))
def test_counts_of_any_reads(spark, reads):
    check(spark, [(s, "I" * len(s) if q else None) for s, q in reads], 2)


def test_hand_worked_reads(spark):
    df = frame(spark, [("ACGTN", "IIII#"), ("ACGTA", "II5I!"), ("", ""), ("GGC", "III")], [f"A:1:F:1:{t}:1:{i}" for i, t in enumerate((1101, 1101, 1102, 1102))])
    a = Analysis(df)
    basic = a.result("basic_stats").first()
    assert (basic.n_reads, basic.total_bases, basic.min_len, basic.max_len, basic.mean_len, basic.median_len, basic.encoding) == (4, 13, 0, 5, 3.25, 5, "Sanger")
    quality = {r.tag: (round(r["mean"], 4), r.median, r.lower_quartile, r.upper_quartile, r.p10, r.p90) for r in a.result("quality_base").collect()}
    assert quality["3"] == (33.3333, 40, 20, 40, 20, 40) and quality["5"] == (1, 2, 0, 2, 0, 2)
    assert {r.quality: r.n for r in a.result("quality_sequence").collect() if r.n} == {28: 1, 32: 1, 40: 1}
    grades = {r["module"]: r["grade"] for r in a.grades().collect()}
    assert grades["sequence_length"] == "fail" and set(grades) == set(MODULES) - {"kmer"}
    a.close()


def test_no_reads_give_an_empty_analysis(spark):
    a = Analysis(frame(spark, [], parts=1))
    assert a.grades().count() == 0
    assert all(a.result(m).count() == 0 for m in MODULES)


def test_only_empty_reads(spark):
    a = Analysis(frame(spark, [("", ""), ("", "")], parts=1))
    grades = {r["module"]: r["grade"] for r in a.grades().collect()}
    assert grades["sequence_length"] == "fail" and grades["kmer" if "kmer" in grades else "basic_stats"] == "pass"


def test_groups_and_singletons_hold_the_same_bases(spark):
    c = cube.cube(frame(spark, random_reads(200)))
    one, many = positions.base_counts(c), positions.base_counts(c, on=True)
    total = lambda df: df.agg(*(F.sum(b) for b in "acgtn")).first()
    assert total(one) == total(many) and many.count() < one.count()


def test_gc_spread_keeps_the_total(spark):
    hist = per_read.gc_by_length(frame(spark, random_reads(400)))
    assert per_read.gc_combined(hist).agg(F.sum("n")).first()[0] == pytest.approx(hist.agg(F.sum("n")).first()[0])
    one = spark.createDataFrame([(0, 4, 2, 1)], "file_id int, len_bin int, gc_bin int, n long")
    got = {r.gc: r.n for r in per_read.gc_combined(one).collect()}
    assert len(got) == 21 and got[40] == pytest.approx(0.029703, abs=1e-6) and got[41] == pytest.approx(0.049505, abs=1e-6)


def test_duplicate_levels_and_bins(spark):
    keys = {"A" * 60: 1, "C" * 60: 9, "G" * 60: 10, "T" * 50 + "AC": 25, "T" * 50 + "GG": 25}
    df = frame(spark, [(s, "I" * len(s)) for s, n in keys.items() for _ in range(n)])
    hist = duplicates.levels(duplicates.key_counts(df))
    assert {r.times_seen: r.n_keys for r in hist.collect()} == {1: 1, 9: 1, 10: 1, 50: 1}
    bins = {r.bin: r.mass_pct for r in duplicates.binned(hist).collect()}
    assert len(bins) == 16 and bins[">50"] == pytest.approx(100 * 50 / 70) and bins["9"] == pytest.approx(100 * 9 / 70)
    assert [duplicates.stride(n) for n in (999_999, 1_000_000, 2_500_000)] == [1, 2, 3]


def test_original_mode_equals_the_default_on_few_reads(spark):
    df = frame(spark, [(s, q) for s, q in random_reads(200) if s])
    seeds, cut = duplicates.seeds(df)
    want = {r.times_seen: r.n_keys for r in duplicates.levels(duplicates.key_counts(df)).collect()}
    got = duplicates.corrected(duplicates.levels(duplicates.original_counts(df, seeds)), cut)
    assert {r.times_seen: r.n_keys for r in got.collect()} == want


def test_original_mode_stops_at_the_key_limit(spark):
    df = frame(spark, [("AAAA", "IIII"), ("CCCC", "IIII"), ("AAAA", "IIII"), ("GGGG", "IIII"), ("CCCC", "IIII")])
    seeds, cut = duplicates.seeds(df, keys=2)
    assert {r.seq for r in seeds.collect()} == {"AAAA", "CCCC"} and cut.first().count_at_limit == 2
    assert {r.seq: r.n for r in duplicates.original_counts(df, seeds).collect()} == {"AAAA": 2, "CCCC": 2}


def nested_loop(over, listed):
    """Every key with every contaminant: the longest piece of one that begins the other, the first of equals, from half of the shorter on."""
    def longest(a, b):
        return max((k for k in range(1, min(len(a), len(b)) + 1) if b[:k] in a), default=0)

    out = {}
    for seq in over:
        best = max(((max(longest(seq, c), longest(c, seq)), -i) for i, (_, c) in enumerate(listed)), default=(0, 0))
        score, i = best[0], -best[1]
        out[seq] = listed[i][0] if score and score >= min(len(seq), len(listed[i][1])) // 2 else "No Hit"
    return out


@pytest.mark.parametrize("shortest", [3, 9, 20])
def test_contaminants_by_pieces(spark, shortest):
    from readqc.sources import dims

    r = random.Random(shortest)
    word = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    listed = [(f"c{i}", word(r.randint(shortest, shortest + 12))) for i in range(40)] + [("same", "ACGTACGTACGTACGTACGT"), ("again", "ACGTACGTACGTACGTACGT")]
    keys = sorted({word(r.choice([4, 7, 12, 50])) for _ in range(60)} | {listed[i][1][: r.randint(3, 20)] + word(9) for i in range(40)} | {word(20) + listed[i][1] for i in range(40)} | {"ACGTACGTACGTACGTAAAA", "NNNN"})
    over = spark.createDataFrame([(0, i, s, 1, 1.0) for i, s in enumerate(keys)], "file_id int, rank int, seq string, n long, pct double")
    match = duplicates.contaminant_match(over, dims.contaminants(spark, listed))
    assert {x.seq: x.source for x in match.collect()} == nested_loop(keys, listed)
    assert "NestedLoop" not in match._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in match._jdf.queryExecution().executedPlan().toString()
    assert all(x.source == "No Hit" for x in duplicates.contaminant_match(over, dims.contaminants(spark, [])).collect())


@pytest.mark.parametrize("probes", [0, 1000])
def test_only_seeds_are_counted(spark, monkeypatch, probes):
    monkeypatch.setattr(duplicates, "PROBES", probes)
    df = frame(spark, [(s, "I" * len(s)) for s, n in {"A" * 60: 5, "C" * 60: 9, "G" * 9: 1}.items() for _ in range(n)])
    seeded = spark.createDataFrame([(0, "C" * 50), (0, "T"), (1, "A" * 50)], "file_id int, seq string")
    counts = duplicates.original_counts(df, seeded)
    assert {(r.file_id, r.seq): r.n for r in counts.collect()} == {(0, "C" * 50): 9, (0, "T"): 0, (1, "A" * 50): 0}
    assert ("LeftSemi" in counts._jdf.queryExecution().optimizedPlan().toString()) == bool(probes)


def test_overrepresented_order_among_equals(spark):
    df = frame(spark, [(s, "I" * len(s)) for s in ("ACGT", "TTTT", "GGGG", "ACGTA", "NACG")])
    assert [r.seq for r in duplicates.overrepresented(duplicates.key_counts(df)).orderBy("rank").collect()] == sorted(
        ["ACGT", "TTTT", "GGGG", "ACGTA", "NACG"], key=lambda s: (int("".join(str("GTCAN".index(c)) for c in s), 5), len(s)), reverse=True
    )


def test_contaminants(spark):
    from readqc.sources import dims

    over = spark.createDataFrame([(0, 1, "GGACGTACGTAC", 5, 1.0), (0, 2, "TTTTTTTT", 4, 1.0), (0, 3, "NNNN", 1, 0.5)], "file_id int, rank int, seq string, n long, pct double")
    contam = dims.contaminants(spark, [("first", "ACGTACGTACTT"), ("second", "ACGTACGTACGG")])
    assert {r.rank: r.source for r in duplicates.contaminant_match(over, contam).collect()} == {1: "first", 2: "No Hit", 3: "No Hit"}


def test_adapters_first_hit_and_running_share(spark):
    a = [("x", "AACCGG"), ("y", "TTTTTT")]
    df = frame(spark, [("CAACCGGAACCGG", "I" * 13), ("aaccgg", "I" * 6), ("ACGT", "IIII"), ("GTTTTTTT", "I" * 8)])
    hits = adapters.hits(df, a)
    assert {(r.adapter_id, r.pos): r.n for r in hits.collect()} == {(0, 1): 1, (0, 2): 1, (1, 2): 1}
    totals = per_read.length_summary(per_read.lengths(df)).select("file_id", "n_reads", "max_len")
    got = {(r.adapter, r.tag): r.cumulative_pct for r in adapters.cumulative(hits, totals, a).collect()}
    assert got[("x", "1")] == 25 and got[("x", "8")] == 50 and ("x", "9") not in got


def test_tiles(spark):
    names = [f"A:1:F:1:{0 if i % 20 else 7}:1:1" for i in range(40)]
    df = frame(spark, [("ACG", "III" if i % 20 else "###") for i in range(40)], names)
    got = {(r.tile, r.pos): (r.qsum, r.n) for r in tiles.tile_quality(df, every=1).collect()}
    assert got[(7, 1)] == (4, 2) and got[(0, 1)] == (38 * 40, 38)
    centred = {(r.tile, r.tag): r.centered_mean for r in tiles.centered(tiles.tile_quality(df, every=1)).collect()}
    assert centred[(7, "1")] == -19 and centred[(0, "1")] == 19
    none = frame(spark, [("ACG", "III")], ["plain"])
    assert tiles.tile_quality(none, every=1).count() == 0
    with pytest.raises(Exception, match="no tile in header"):
        tiles.tile_quality(frame(spark, [("ACG", "III"), ("ACG", "III")], ["a:b:5:c:d", "a:b:x:c:d"]), every=1).collect()


def test_tile_fields(spark):
    df = spark.createDataFrame([("A:1:F:1:1101:1:1",), ("A:1:1101:4:5",), ("x",)], "name string")
    got = df.select(expr.tile_id(F.col("name"), expr.tile_field(F.col("name"))).alias("t")).collect()
    assert [r.t for r in got] == [1101, 1101, None]


def test_kmers(spark):
    r = random.Random(2)
    reads = ["".join(r.choice("ACGT") for _ in range(40)) for _ in range(400)]
    reads = [s[:10] + "ACGTACGTT" + s[19:] if i % 4 == 0 else s for i, s in enumerate(reads)]
    df = frame(spark, [(s, "I" * 40) for s in reads])
    cells = kmers.counts(df, every=1)
    got = {(x.pos, x.kmer): x.n for x in cells.collect()}
    assert got[(11, "ACGTACG")] >= 100 and sum(got.values()) == 400 * 34
    top = {x.kmer: x for x in kmers.enriched(cells, top=10_000).collect()}
    assert {"ACGTACG", "CGTACGT", "GTACGTT"} <= set(top) and top["ACGTACG"].pos == 11 and top["ACGTACG"].pvalue < 1e-6
    assert all(x.pvalue <= 0.01 and x.obs_exp >= 5 for x in top.values()) and sorted(x.rank for x in top.values()) == list(range(1, len(top) + 1))


def test_encodings(spark):
    assert positions.encoding(cube.cube(frame(spark, [("ACG", "hhh")]))).first().encoding == "Solexa"
    assert positions.encoding(cube.cube(frame(spark, [("ACG", "II#")]))).first().encoding == "Sanger"


def test_files_stay_apart(spark):
    a, b = random_reads(50, 1), random_reads(60, 2)
    both = frame(spark, a, file_id=0).unionByName(frame(spark, b, file_id=1))
    got = {}
    for r in cube.cube(both).collect():
        got.setdefault(r.file_id, {})[(r.pos, r.base, r.q)] = r.n
    assert got == {0: counts(a)["cube"], 1: counts(b)["cube"]}


def test_disabled_modules_are_not_graded(spark):
    a = Analysis(frame(spark, random_reads(30)), RunMode(enabled=frozenset({"basic_stats", "sequence_length"})))
    assert [r["module"] for r in a.grades().orderBy("section_no").collect()] == ["basic_stats", "sequence_length"]
