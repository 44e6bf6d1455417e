"""The source divergence audit against a plain computation, and its odd rows."""

import random
import re
from collections import Counter, defaultdict

import pytest

from readqc.llm import divergence

ROWS = "doc_id long, text string, lang string, source string, term string, n int, p long, tile int"  # the last ones clash with names that the operator uses


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, *r, "t", 1, 2, 3) for i, r in enumerate(rows)], ROWS).repartition(parts)


def plain(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)] for t, _, _ in rows]
    docs, of_lang, of_group, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for w, (_, lang, source) in zip(words, rows, strict=True):
        docs[lang].update(set(w))
        of_lang[lang].update(w)
        of_group[lang, source].update(w)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, k in docs[lang].items() if k >= least]
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        q, p = share(of_lang[lang]), {s: share(of_group[lang, s]) for s in sources}
        for s in sources:
            best = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if of_group[lang, s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(best)}
            far = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(far)}
    return out


def corpus(seed, n=300):
    r = random.Random(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)] + ["Étude", "ЖУК", "ﬀ", "𝄞x", "naïve", "K"]
    rows = []
    for i in range(n):
        source = r.choice(["s1", "s1", "s1", "s2", "é", "", None, "z"])
        lean = sum(map(ord, source or "")) % 7
        text = " ".join(r.choice(vocabulary[lean * 10 : lean * 10 + 90] + vocabulary[-6:]) + r.choice(["", ",", "3", "\x00"]) for _ in range(r.randint(0, 40)))
        rows.append((text if i % 17 else None, r.choice(["en", "en", "de", "", None]), source))
    return rows + [("only here", "xx", "s1"), ("", "xx", "s2"), (None, "yy", None)]


@pytest.mark.parametrize("small", [False, True])
def test_audit(spark, monkeypatch, small):
    if small:  # many flushes, pieces, rounds, tiles and blocks of terms
        for name, value in {"ENTRIES": 50, "PIECE": 7, "TERMS": 16, "TILE": 2, "FASTER": 2}.items():
            monkeypatch.setattr(divergence, name, value)
    rows = corpus(4)
    got = [tuple(r) for r in divergence.audit(docs_of(spark, rows, 5), least=6, top=7).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain(rows, 6, 7)


def test_ties_at_the_last_place(spark):
    """Many terms of one difference: the first by their bytes are reported."""
    rows = [(" ".join(f"t{chr(97 + i)}" for i in range(20)), "en", "a")] * 8 + [("ta other", "en", "b")] * 4
    got = {tuple(r) for r in divergence.audit(docs_of(spark, rows), least=3, top=5).collect()}
    assert got == plain(rows, 3, 5)


def test_hot_source_and_repeated_rows(spark):
    r = random.Random(9)
    rows = [("hot words of one source", "en", "hot")] * 400 + [(" ".join(r.choice("abcdefgh") for _ in range(9)), "en", f"s{r.randrange(9)}") for _ in range(200)]
    assert {tuple(x) for x in divergence.audit(docs_of(spark, rows, 7), least=5, top=3).collect()} == plain(rows, 5, 3)


def test_empty_tables(spark):
    assert divergence.audit(docs_of(spark, [])).count() == 0
    got = divergence.audit(docs_of(spark, [(None, None, None), ("x", None, "b")])).collect()
    assert sorted(map(tuple, got)) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_exact_for_large_counts(spark):
    count, total, kept = 123_456_789_012_345, 999_999_999_999_999, 7_654_321
    df = spark.createDataFrame([(count, total, kept)], "c long, n long, v long")
    from pyspark.sql import functions as F

    got = df.select(divergence.probability(F.col("c"), F.col("n"), F.col("v")).alias("p")).first().p
    assert got == 1 + 10**9 * (count + 5) // (total + 5 * kept)
