"""Vectors whose squares leave the range of doubles, and notices among words of their own."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from readqc.llm import arrays, embedding_dedup, license_scan, vectors
from readqc.llm.sql import embedding_dedup_sql

DOUBLES = "vec_id long, embedding array<double>"


@pytest.mark.parametrize("block", [4096, 16, 5])
def test_norms_out_of_range_link_as_any_others(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    g = np.random.default_rng(1)
    base = g.normal(size=(40, 8))
    base[20:] = base[:20] + 0.05 * g.normal(size=(20, 8))
    scale = np.resize([1.0, 1e-170, 1e170, 1e-300, 1e300, 3e-310], 40)
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(base, scale, strict=True))] + [(100, [0.0] * 8), (101, [1e-170] * 8), (102, [1e170] * 8), (103, None)]
    unit = {i: np.array(v) / max(map(abs, v)) for i, v in rows if v and any(v)}
    unit = {i: v / np.sqrt(v @ v) for i, v in unit.items()}
    links = {i: {j for j in unit if j != i and unit[i] @ unit[j] >= 0.9} for i in unit}
    got = {r.vec_id: r.n_links for r in embedding_dedup.dedup(spark.createDataFrame(rows, DOUBLES).repartition(3)).collect()}
    assert got == {i: len(links.get(i, ())) for i, _ in rows} and sum(got.values()) >= 42
    with duckdb.connect() as c:
        c.register("embeddings", pa.table({"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float64()))}))
        assert {r[0]: r[1] for r in c.sql(f"SELECT vec_id, n_links FROM ({embedding_dedup_sql()})").fetchall()} == got


def test_unit_vectors_are_exact_for_powers_of_two():
    x = np.random.default_rng(3).normal(size=(9, 5))
    for power in (-1060, -500, 0, 400, 1000):
        assert np.allclose(vectors.unit_vectors(np.ldexp(x, power)), vectors.unit_vectors(x), rtol=1e-12 if power > -1030 else 1e-2)


MIT = "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
APACHE = "you may not use this file except in compliance with the license you may obtain a copy of the license at"


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.labels, r.score) for r in license_scan.scan(df).collect()}


def plain_share(words, notice):
    """The largest share that any start of a diagonal and any of the distances gives."""
    own = notice.split()
    pairs = list(zip(own, own[1:], strict=False))
    hits = [(i - j, i, j) for i, p in enumerate(zip(words, words[1:], strict=False)) for j, q in enumerate(pairs) if p == q]
    best = 0.0
    for start in {d for d, _, _ in hits}:
        for width in (0, *license_scan.WIDTHS):
            linked = start  # diagonals follow each other with no gap over NEAR
            for d in sorted({d for d, _, _ in hits}):
                linked = d if linked < d <= linked + license_scan.NEAR else linked
            near = [(i, j) for d, i, j in hits if start <= d <= min(linked, start + width)]
            covered, long = len({j for _, j in near}), max(i for i, _ in near) - min(i for i, _ in near) + 1
            if covered >= license_scan.COVER * len(pairs) and covered >= license_scan.DENSE * long:
                best = max(best, covered / len(pairs))
    return best


def test_words_before_a_notice_do_not_hide_it(spark):
    broken = APACHE.replace("compliance with", "compliance fully with")
    texts = [f"{'you may ' * n}{broken}{' you may' * m} and so on" for n in (0, 3, 30, 400) for m in (0, 30)]
    texts += [f"{'of the software ' * 50}{MIT.replace('shall be', 'shall now be')} {'of the software ' * 50}"]
    got = scanned(spark, texts)
    assert [x for x, _ in got.values()].count("apache") == 8 and got[8][0] == "mit"
    assert all(s > 0.9 for _, s in got.values())


def test_every_window_against_brute_force(spark):
    r = random.Random(2)
    words = sorted({*APACHE.split(), *MIT.split(), "and", "so"})
    texts = []
    for _ in range(60):
        w = (APACHE if r.random() < 0.5 else MIT).split()
        for _ in range(r.randint(0, 8)):
            w.insert(r.randrange(len(w)), r.choice(words)) if r.random() < 0.7 else w.pop(r.randrange(len(w)))
        texts.append(" ".join([r.choice(words) for _ in range(r.randint(0, 60))] + w + r.choices(words, k=r.randint(0, 60))))
    got = scanned(spark, texts)
    for i, t in enumerate(texts):
        share = max(plain_share(re.findall("[a-z0-9]+", t), n) for n in license_scan.NOTICES)
        assert got[i][1] == pytest.approx(share) and (got[i][0] != "") == (share > 0), i


def test_a_shelf_opens_little_when_all_buckets_are_asked_for_again(tmp_path):
    folder = f"file://{tmp_path}"
    for i in range(300):
        arrays.save(folder, f"a-{i}", np.array([i]))
    for most, again in ((300, 0), (200, 101), (1, 300)):
        shelf = arrays.Shelf(folder, most)
        for _ in range(3):
            before = shelf.opened
            assert [int(shelf[f"a-{i}"][0]) for i in range(300)] == list(range(300))
        assert shelf.opened - before == again and len(shelf.held) <= most
