"""The learned operators and the pipeline against plain computations on small tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from readqc.llm import quality, toxicity
from readqc.llm import textkernel as K
from tests.llm.test_edges import docs_of, jaccard_brute, prose


def corpus(seed, n=300):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = prose(r, r.randint(8, 60), 300).split()
        if i % 5 == 0:
            words.insert(r.randrange(len(words)), r.choice(["grublik", "Vorpant!", "snarkel", "snarkels"]))
        text = " ".join(words) + "." if i % 4 else "BUY!! NOW$$ " * (len(words) // 3)
        rows.append((i, text, int(i % 4 != 0), int(i % 5 == 0 and i % 4 != 0)))
    return rows


def tables(spark, rows, parts=3):
    docs = docs_of(spark, [t for _, t, _, _ in rows], [i for i, _, _, _ in rows], parts)
    return docs, spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int")


def test_quality_model_solves_the_whole_problem(spark):
    rows = corpus(1)
    docs, labels = tables(spark, rows)
    model = quality.fit(docs, labels)
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    own = [(t, q) for i, t, q, _ in rows if i not in held]
    x, y = quality.statistics(pa.array([t for t, _ in own])), np.array([q for _, q in own], float)
    assert model.mean == pytest.approx(x.mean(0)) and model.scale == pytest.approx(x.std(0) + 1e-6, abs=1e-6)
    f = model.features(x)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    ridge = quality.RIDGE * np.eye(f.shape[1])
    ridge[0, 0] = 0
    want = np.linalg.solve(f.T @ (f * weight[:, None]) + ridge, f.T @ (weight * y))
    assert f @ model.weights == pytest.approx(f @ want, abs=1e-6)
    # the calibration: of all bins the least over later ones of the largest mean over runs that end there
    at = np.clip(np.round((f @ want + 0.5) / 2 * (quality.BINS - 1)).astype(int), 0, quality.BINS - 1)
    n, s = np.bincount(at, minlength=quality.BINS).astype(float), np.bincount(at, y, quality.BINS)
    n, s = n[n > 0], s[n > 0]
    v = (s + y.mean()) / (n + 1)
    level = [max(min(float(np.average(v[a : b + 1], weights=n[a : b + 1])) for b in range(k, len(v))) for a in range(k + 1)) for k in range(len(v))]
    assert model.level == pytest.approx([max(level[: k + 1]) for k in range(len(level))], abs=1e-9)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    whole = np.interp(model.features(quality.statistics(pa.array([t for _, t, _, _ in rows]))) @ want, model.edges, model.level)
    assert [got[i].score for i, *_ in rows] == pytest.approx(whole.tolist(), abs=1e-6)
    assert {i for i in got if got[i].held_out} == held


def plain_features(text):
    """Words of letters in lower case and their beginnings, with how often each comes, and the number of words."""
    word, words = b"", []
    for c in (text or "").encode().lower() + b" ":
        if 97 <= c <= 122 or c >= 128:
            word += bytes([c])
        elif word:
            words.append(word)
            word = b""
    out = Counter(("", w) for w in words)
    for k in toxicity.BEGINNINGS:
        out.update((k, w[:k]) for w in words if len(w) > k)
    return out, len(words)


def test_toxicity_features_and_severity_by_definition(spark):
    rows = corpus(2, 400)
    docs, labels = tables(spark, rows)
    model = toxicity.fit(docs, labels)
    sets = {0: Counter(), 1: Counter()}
    sizes = Counter(t for *_, t in rows)
    for _, text, _, t in rows:
        sets[t].update(plain_features(text)[0].keys())
    support = max(toxicity.SUPPORT, toxicity.SUPPORT_SHARE * sizes[1])
    chosen = [f for f, n in sets[1].items() if n >= support and (n / sizes[1]) / ((sets[0][f] + 0.5) / sizes[0]) >= toxicity.ODDS]

    def hashed(f):
        k, w = f
        data = np.frombuffer(w, np.uint8)
        h = K.span_hash(data, np.array([0]), np.array([len(w)]))[0]
        return int(h ^ np.uint64(k)) if k else int(h)

    of = {f: hashed(f) for f in chosen}
    assert sorted(of.values()) == [int(h) for h in model.known] and 0 < len(chosen) <= toxicity.FEATURES
    weight = dict(zip((int(h) for h in model.known), model.weights[:-1].tolist(), strict=True))
    long = "calm words only " * 100_000 + "snarkel"
    more = docs.unionByName(docs_of(spark, [None, "", long], [9000, 9001, 9002]))
    got = {r.doc_id: r for r in toxicity.score(more, model).collect()}
    for i, text in [*((i, t) for i, t, *_ in rows), (9000, None), (9001, ""), (9002, long)]:
        counts, words = plain_features(text)
        marked = sum(n for f, n in counts.items() if f in of)
        z = sum(weight[of[f]] * math.log1p(n) for f, n in counts.items() if f in of) + model.weights[-1] * min(100 * marked / max(words, 1), 20)
        above = [1 / (1 + math.exp(min(50, max(-50, t - z)))) for t in model.thresholds]
        assert got[i].severity == pytest.approx(sum(above), abs=1e-9) and got[i].toxic == int(above[0] > 0.5)
    assert sum(got[i].toxic != t for i, _, _, t in rows) <= 4


def test_repeated_rows_score_alike_and_each(spark):
    rows = corpus(3, 120)
    docs, labels = tables(spark, rows)
    twice = docs.unionByName(docs)
    for scored in (quality.score(twice, quality.fit(docs, labels)), toxicity.score(twice, toxicity.fit(docs, labels))):
        got = Counter(tuple(r) for r in scored.collect())
        assert set(got.values()) == {2} and len(got) == 120


def test_pipeline_by_its_operators_and_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows = corpus(4, 200)
    rows += [(1000 + i, t + " more words", q, x) for i, (_, t, q, x) in enumerate(rows[:40])] + [(500, None, 1, 0), (501, "", 1, 0), rows[3], rows[3]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t, _, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows[:200]], "doc_id long, quality int, toxic int")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    known = spark.read.parquet(f"{sf}/labels.parquet")
    first = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in quality.score(first, quality.fit(first, known)).collect() if r.score >= 0.7}
    kept = [(i, t) for i, t, *_ in rows if i in good]
    second = docs_of(spark, [t for _, t in kept], [i for i, _ in kept])
    toxic = {r.doc_id for r in toxicity.score(second, toxicity.fit(second, known)).collect() if r.toxic}
    kept = [(i, t) for i, t in kept if i not in toxic]
    want = {i for i, _, c in jaccard_brute(kept) if i == c}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == want and 50 < len(want) < len(kept)
    assert sum(r.piece == 0 for r in got) == len(want) + sum(n - 1 for n in Counter(i for i, t in kept if not (t or "").split()).values())


def test_pipeline_of_an_empty_table_and_without_labels(spark, tmp_path):
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("none", []), ("some", [(1, "a b c", "en", "s", 5), (2, None, "en", "s", 0), (None, "a b c", "en", "s", 5)])):
        sf = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, kind).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        assert corpus_pipeline.run(spark, sf).count() == len(rows)
