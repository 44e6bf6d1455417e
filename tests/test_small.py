import math
from fractions import Fraction

import numpy as np
import pytest

from readqc import cli
from readqc.config import RunMode, grade, parse_limits
from readqc.functions import stats
from readqc.plans.engine import output_folders, stem
from readqc.sources import dims


@pytest.mark.parametrize(("n", "many", "tenth", "last"), [(75, 75, (10, 10), (75, 75)), (76, 43, (10, 11), (76, 76)), (100, 55, (10, 11), (100, 100)), (125, 67, (10, 11), (124, 125)), (150, 38, (10, 14), (150, 150)), (300, 68, (10, 14), (300, 300)), (301, 68, (10, 14), (300, 301)), (1000, 59, (10, 29), (990, 1000)), (10000, 59, (10, 209), (9810, 10000))])
def test_base_groups(n, many, tenth, last):
    g = stats.base_groups(n)
    assert (len(g), g[9], g[-1]) == (many, tenth, last)


def test_base_groups_of_every_length():
    steps = [b * 10**e for e in range(5) for b in (2, 5, 10)]
    for n in range(76, 20_001):
        g = stats.base_groups(n)
        wide = g[9:]
        step = next(s for s in steps if len(range(10, n + 1, s)) <= 66)
        assert g[:9] == [(i, i) for i in range(1, 10)] and wide == [(i, min(n, i + step - 1)) for i in range(10, n + 1, step)]
        assert len(wide) <= 66 and wide[-1][1] == n


def test_poisson_tail():
    for k, mu in ((0, 1.0), (3, 0.5), (10, 2.0), (2, 40.0), (50, 60.0), (0, 0.001), (5, 0.01), (120, 60.0), (400, 500.0)):
        m = Fraction(mu)
        want = float(math.exp(-mu) * float(sum(m**i / math.factorial(i) for i in range(k + 1, k + 400))))
        assert stats.poisson_above(np.array([k]), np.array([mu]))[0] == pytest.approx(want, rel=1e-6)
    assert stats.poisson_above(np.array([3]), np.array([0.0]))[0] == 1


def corrected_plainly(limit, n, level, seen):
    if limit == n or n - seen < limit:
        return float(seen)
    missed, least = 1.0, 1 - seen / (seen + 0.01)
    for i in range(limit):
        missed *= max(0, n - i - level) / (n - i)
        if missed < least:
            missed = 0.0
            break
    return seen / max(2.0**-52, 1 - missed)


def test_corrected_count():
    cases = {(100, 100, 1, 5): 5, (100, 200, 1, 40): 80, (100, 200, 2, 10): 13.311037, (100, 1000, 1, 60): 600}
    for args, want in cases.items():
        assert stats.corrected_count(*args) == pytest.approx(want, rel=1e-6)
    for limit, n in ((10, 1000), (300, 1000), (999, 1000), (5000, 5001)):
        for level in (1, 2, 3, 7, 50, 400, 990):
            for seen in (1, 5, 300):
                assert stats.corrected_count(limit, n, level, seen) == pytest.approx(corrected_plainly(limit, n, level, seen), rel=1e-9)


def test_theoretical_gc():
    hist = np.zeros(101)
    hist[40:61] = np.exp(-((np.arange(21) - 10) ** 2) / 8) * 1000
    assert stats.theoretical_gc(hist).sum() == pytest.approx(int(hist.sum()))
    assert stats.gc_deviation(hist) < 20
    assert stats.gc_deviation(np.zeros(101)) == 0


def test_smoothing_keeps_the_number_of_values():
    v = [float(i) for i in range(101)]
    s = stats.smoothed(v)
    assert len(s) == 101 and s[0] == 0 and s[1] == 0.5 and s[50] == 50 and s[-1] == 100


def test_grades():
    assert [grade(v, 1, 2) for v in (0.5, 1.5, 2, float("nan"))] == ["pass", "warn", "fail", "fail"]
    assert [grade(v, 2, 1) for v in (0.5, 1.5, 2, float("nan"))] == ["fail", "warn", "pass", "pass"]


def test_limits():
    mode = parse_limits(["# a comment", "kmer ignore 0", "tile ignore 1 # off", "n_content warn 5", "n_content error 20", "sequence error 25"])
    assert mode.on("kmer") and not mode.on("tile") and mode.graders["n_content"] == (0.05, 0.2) and mode.graders["sequence"] == (10, 25)
    for bad in ("tile ignore", "nothing warn 3", "tile warn x", "tile odd 1"):
        with pytest.raises(ValueError, match="line 1"):
            parse_limits([bad])


def test_run_mode():
    with pytest.raises(ValueError, match="preseq"):
        RunMode(preseq=True, original_duplicates=True)
    assert not RunMode().on("kmer") and RunMode().switched(kmer=True, tile=None).on("kmer")


def test_adapter_lists():
    assert dims.parse_pairs(["# x", "", "a  b\t\tACGTAC", "  c\tACGTAA  "]) == [("a b", "ACGTAC"), ("c", "ACGTAA")]
    for bad in ("no tab", "a\tb\tc"):
        with pytest.raises(ValueError, match="malformed"):
            dims.parse_pairs([bad])
    for sizes in ([5], [17], [6, 7]):
        with pytest.raises(ValueError, match="equally long"):
            dims.check_adapters([("x", "A" * n) for n in sizes])
    assert dims.check_adapters([("x", "A" * 16)])


def test_output_folders():
    assert [stem(x) for x in ("a/b.fq.gz", "c.bam", "d.txt")] == ["b", "c", "d.txt"]
    with pytest.raises(ValueError, match="share"):
        output_folders(["x/a.fq", "y/a.bam"], "out")


def test_options():
    args = cli.parser().parse_args(["-o", "x", "--no-tiles", "--kmers", "--no-dups", "a.fq"])
    mode = cli.mode_of(args)
    assert mode.on("kmer") and not mode.on("tile") and not mode.on("duplication") and not mode.on("overrepresented")
    assert cli.size_of("2M") == 2 << 20 and cli.size_of(None) is None
