"""The operators of readqc.llm against brute force, round trips and labels, with nulls, ties, empty tables and odd columns."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readqc.llm import byte_bpe, components, embedding_dedup, jaccard_join, kneser_ney, license_scan, packing, quality, sharding, toxicity
from readqc.llm import textkernel as K
from readqc.llm import topk

SCHEMA = "doc_id long, text string, node long, n long, row string"  # the last three clash with names that operators use
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, ids=None, parts=3):
    rows = [(i, t, 7, -1, "x") for i, t in zip(ids if ids is not None else range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def word_list(text):
    return WORD.findall((text or "").encode().lower())


def prose(r, n, vocabulary=400):
    return " ".join(f"w{int(vocabulary * r.random() ** 2)}" for _ in range(n))


def odd_texts(r):
    long = prose(r, 3000)
    return [None, "", " \t\n", "one", "Two Words", long, long, long[:-200], "É é ß 日本語 text", "a\x0bb\x1cc", *[prose(r, r.randint(1, 60)) for _ in range(40)]]


# kernels


def test_words_and_hashes():
    r = random.Random(0)
    texts = odd_texts(r)
    w = K.words(pa.array(texts))
    for i, t in enumerate(texts):
        a, b = w.bounds[i], w.bounds[i + 1]
        assert [bytes(w.data[s:e]) for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)] == word_list(t)
    by_word = defaultdict(set)
    for s, e, h in zip(w.starts, w.ends, w.hashes, strict=True):
        by_word[bytes(w.data[s:e])].add(int(h))
    assert all(len(v) == 1 for v in by_word.values()) and len({next(iter(v)) for v in by_word.values()}) == len(by_word)
    x = np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64)
    assert (K.unmix(K.mix(x)) == x).all() and (K.unpack_sorted(K.pack_sorted(np.sort(x))) == np.sort(x)).all()


def test_chunks_hold_every_row():
    batch = pa.record_batch([pa.array(range(50)), pa.array([None if i % 7 == 0 else "x" * i for i in range(50)])], names=["doc_id", "text"])
    for size in (1, 30, 10_000):
        assert [x for t in K.chunks(iter([batch.slice(0, 20), batch.slice(20)]), "text", size) for x in t["doc_id"].to_pylist()] == list(range(50))


# 1


def kneser_ney_brute(texts, train, order):
    """Counts and formulas by dictionaries: the number of training tokens, per text its figures, and the sums over all words after some contexts."""
    tokens = [[*word_list(t), None] for t in texts]
    c, pairs, triples = Counter(), Counter(), Counter()
    for i in train:
        long = [None, *tokens[i]]
        c.update(tokens[i])
        pairs.update(zip(long, long[1:], strict=False))
        triples.update(zip(long, long[1:], long[2:], strict=False))
    if order == 2:
        lower = pairs
    else:
        lower = Counter((v, w) for _, v, w in triples) | Counter({x: k for x, k in pairs.items() if x[0] is None})
    one = Counter(w for _, w in pairs)

    def discounted(counts):
        n = Counter(counts.values())
        d = kneser_ney.discounts(np.array([n[k] for k in (1, 2, 3, 4)]))
        whole, free = Counter(), Counter()
        for key, k in counts.items():
            whole[key[:-1]] += k
            free[key[:-1]] += d[min(k, 3)]
        return lambda key: (max(counts[key] - d[min(counts[key], 3)], 0) / whole[key[:-1]], free[key[:-1]] / whole[key[:-1]]) if whole[key[:-1]] else (0, 1)

    p1, p2, p3 = discounted(Counter({(w,): k for w, k in one.items()})), discounted(lower), discounted(triples)

    def p(u, v, w):
        kept, free = p1((w,))
        out = kept + free / (len(c) + 1)
        kept, free = p2((v, w))
        out = kept + free * out
        if order == 3 and v is not None:
            kept, free = p3((u, v, w))
            out = kept + free * out
        return out

    n = sum(c.values())
    rows = []
    for x in tokens:
        before = [None, None, *x]
        rows.append((len(x), sum(w in c for w in x), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in x), sum(math.log10(p(u, v, w)) for u, v, w in zip(before, before[1:], x, strict=False))))
    contexts = [(None, None), (b"never seen", b"never seen"), *list(pairs)[:5], *(x for x, _ in pairs.most_common(5))]
    return n, rows, [sum(p(u, v, w) for w in [*c, b"never seen"]) for u, v in contexts if v is not None or u is None]


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney(spark, order):
    r = random.Random(3)
    texts = [*odd_texts(r), *[prose(r, 40, 60) for _ in range(60)]]
    texts += texts[-20:]
    got = {x.doc_id: x for x in kneser_ney.score_all(docs_of(spark, texts), order).collect()}
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 10]
    n, want, whole = kneser_ney_brute(texts, train, order)
    assert whole == pytest.approx([1] * len(whole))
    for i, (many, known, base, score) in enumerate(want):
        x = got[i]
        assert (x.n_tokens, x.n_known, x.train_tokens, x.held_out) == (many, known, n, i not in train)
        assert x.base_score == pytest.approx(base) and x.score == pytest.approx(score)


def test_discounts():
    d = kneser_ney.discounts(np.array([1000, 400, 220, 150]))
    y = 1000 / 1800
    assert d.tolist() == pytest.approx([0, 1 - 2 * y * 0.4, 2 - 3 * y * 0.55, 3 - 4 * y * 150 / 220])
    many_copies = kneser_ney.discounts(np.array([1000, 400, 20, 10]))
    assert many_copies.tolist() == pytest.approx([0, y, y, y])
    for n in ([0, 0, 0, 0], [5, 0, 0, 0], [5, 1, 0, 0], [100, 50, 40, 30], [9, 900, 1, 1]):
        d = kneser_ney.discounts(np.array(n))
        kept = 1 - d[1:] / [1, 2, 3]
        assert (kept >= 0).all() and (np.diff(kept) >= -1e-12).all()


@pytest.mark.parametrize(("left", "right", "top"), [(1, 1, 1), (5, 3, 5), (16, 1, 16), (20, 16, 1), (20, 20, 2), (23, 23, 6), (27, 23, 6), (40, 24, 16)])
def test_keys_can_be_undone_and_found(tmp_path, left, right, top):
    r = np.random.default_rng(left)
    kind = kneser_ney.Keys(left, right, top)
    a, b = (r.integers(0, 1 << bits, 3000) for bits in (left, right))
    assert all((x == y).all() for x, y in zip(kind.split(kind.join(a, b)), (a, b), strict=True))
    keys = np.unique(kind.join(a, b))
    assert len(keys) == len(set(zip(a.tolist(), b.tolist(), strict=True)))
    model = kneser_ney.Model(f"file://{tmp_path}", top)
    model.keys = lambda name: kind
    parts = kind.edges(keys)
    many = np.arange(len(keys)) % 3 > 0
    model.sizes = {name: np.zeros(1 << top, np.int64) for name in ("words", "pairs", "pairs-once")}
    for bucket in np.flatnonzero(np.diff(parts)).tolist():
        part = slice(parts[bucket], parts[bucket + 1])
        for name, mine in (("pairs", many[part]), ("pairs-once", ~many[part])):
            kneser_ney._save_keys(model.folder, f"{name}-{bucket}", kind.within(keys[part])[mine], kind.low)
            model.sizes[name][bucket] = mine.sum()
        kneser_ney.arrays.save(model.folder, f"pairs-counts-{bucket}", np.full(int(many[part].sum()), 7))
    m = kneser_ney.Mapped(model)
    number, count = m._counted(keys, "pairs")
    assert sorted(number.tolist()) == list(range(len(keys))) and (count == np.where(many, 7, 1)).all()
    assert (number[many] < many.sum()).all()
    for bucket in np.flatnonzero(np.diff(parts)).tolist():
        part = slice(parts[bucket], parts[bucket + 1])
        assert (m.stored("pairs", bucket) == keys[part][many[part]]).all()
    others = np.setdiff1d(r.integers(0, 1 << min(63, left + right), 500).astype(np.uint64), keys)
    assert (m._counted(others, "pairs")[0] == -1).all()


def test_kneser_ney_with_nothing_to_learn(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    rows = kneser_ney.score_all(docs_of(spark, ["a b", None, "c"], held)).collect()
    assert len(rows) == 3 and all(x.held_out and x.n_known == 0 and x.train_tokens == 0 and math.isfinite(x.score) for x in rows)
    assert kneser_ney.score_all(docs_of(spark, [])).count() == 0
    odd = kneser_ney.score_all(docs_of(spark, ["a b", "a b"], [None, 1])).collect()
    assert sorted((x.doc_id is None, x.held_out) for x in odd) == [(False, False), (True, False)]


# 2 and 5


VEC = "vec_id long, embedding array<float>, label int, x string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], VEC).repartition(3)


def cloud(seed, n, size=8):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, size))
    x[n // 2 :] = x[: n - n // 2] + 0.15 * g.normal(size=(n - n // 2, size))
    x[5] = x[6] = x[7]
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


ODD = [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [1.0] * 7), (1004, [None] + [1.0] * 7), (1005, [float("nan")] + [1.0] * 7), (None, [1.0] * 8)]


def test_top_k_is_exact(spark):
    rows = cloud(1, 700)
    df = vectors_of(spark, [*rows, *ODD])
    got = defaultdict(list)
    for x in topk.search(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    ok = [*rows, (1002, [0.0] * 8)]
    whole = {i: np.floor(1024 * np.array(v, np.float64)).astype(np.int64) for i, v in ok}
    for q in (i for i in whole if i % 100 == 0):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:10]
        assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(got) == {i for i in whole if i % 100 == 0}


def test_top_k_small_and_empty(spark):
    few = vectors_of(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])])
    assert [(x.rank, x.vec_id) for x in topk.search(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    none = few.where("vec_id > 9")
    assert topk.search(none, none).count() == 0 and topk.search(few, none).count() == 0


def test_ball_tree_holds_every_row_once():
    x = np.random.default_rng(0).normal(size=(1000, 5))
    x[:600] = x[0]
    order, nodes = topk.ball_tree(x, 50)
    assert sorted(order) == list(range(1000)) and sum(b - a for a, b, left, _ in nodes.tolist() if left < 0) == 1000


def union(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("block", [16, 64, 5000])
def test_embedding_dedup_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = cloud(2, 300)
    x = np.array([v for _, v in rows])
    x /= np.sqrt((x**2).sum(1))[:, None]
    links = [(a, b) for a, b in itertools.combinations(range(300), 2) if x[a] @ x[b] >= 0.9]
    degree = Counter(i for p in links for i in p)
    comp = union(300, links)
    got = {r.vec_id: r for r in embedding_dedup.dedup(vectors_of(spark, [*rows, *ODD])).collect()}
    assert len(links) > 100 and len(got) == 307
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (degree[i], comp[i], comp[i] == i) for i in range(300))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(1000, 1006)) and got[None].component_id is None


def test_embedding_dedup_empty(spark):
    assert embedding_dedup.dedup(vectors_of(spark, [])).count() == 0
    assert embedding_dedup.dedup(vectors_of(spark, [(3, None)])).first().kept


def test_cover_tree_covers():
    x = np.random.default_rng(3).normal(size=(400, 6))
    x[100:200] = x[0] + 0.05 * x[100:200]
    x /= np.sqrt((x**2).sum(1))[:, None]
    order, levels = embedding_dedup.cover_tree(x)
    assert sorted(order) == list(range(400))
    y = x[order]
    for depth, (centre, radius, bounds) in enumerate(levels):
        for c, r, a, b in zip(centre, radius, bounds[:-1], bounds[1:], strict=True):
            far = np.sqrt(((y[a:b] - y[c]) ** 2).sum(1)).max()
            assert far <= r + 1e-6 and (not depth or far <= embedding_dedup.RADII[depth - 1] + 1e-6)


# 3 and 6


def test_ordinal_regression_orders_grades():
    r = np.random.default_rng(0)
    count = r.integers(0, 4, 600)
    doc, feature = np.arange(600)[count > 0], np.zeros((count > 0).sum(), int)
    w, theta = toxicity.fit_ordinal(doc, feature, np.log1p(count[count > 0]), np.zeros(600), count, 1)
    assert w[0] > 0 and (np.diff(theta) > 0).all()
    model = toxicity.Model(np.zeros(1, np.uint64), np.array([w[0], 0.0]), theta)
    assert model.weights[0] == w[0]


def toxic_corpus(n=400):
    r = random.Random(5)
    texts, toxic = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = [f"w{int(200 * r.random() ** 2)}x" for _ in range(r.randint(5, 40))]
        if bad:
            for _ in range(r.randint(1, 4)):
                words.insert(r.randint(0, len(words)), r.choice(["grublik", "Vorpant!", "snarkel"]))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, toxic


def test_toxicity(spark):
    texts, toxic = toxic_corpus()
    docs = docs_of(spark, [*texts, None, "", "snarkels all over"], [*range(len(texts)), None, 9001, 9002])
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic) if i % 2 == 0] + [(None, 1, 1), (3, 1, None), (77, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    wrong = [i for i, t in enumerate(toxic) if got[i].toxic != t]
    assert len(wrong) <= 4 and got[9001].toxic == 0 and got[None].toxic == 0 and got[9002].toxic == 1
    assert np.mean([got[i].severity for i, t in enumerate(toxic) if t]) > 1 > np.mean([got[i].severity for i, t in enumerate(toxic) if not t])
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.toxic == 0 for r in got.values())


def test_classifiers_without_labels(spark):
    docs = docs_of(spark, ["a b", None, ""], [1, 2, None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.toxic for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0}
    assert {r.score for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    empty = docs.where("doc_id > 5")
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0 and quality.score(empty, quality.fit(empty, none)).count() == 0


def test_quality_learns_and_holds_out(spark):
    r = random.Random(8)
    texts, label = [], []
    for i in range(600):
        good = i % 4 != 0
        words = [f"{'abcdefgh'[int(8 * r.random())]}{int(300 * r.random())}" for _ in range(r.randint(20, 80))]
        texts.append(" ".join(words) + "." if good else " ".join([r.choice(words[:3]).upper() + "!!"] * len(words)))
        label.append(int(good))
    docs = docs_of(spark, [*texts, None, ""], [*range(600), None, 601])
    labels = spark.createDataFrame([(i, y, 0) for i, y in enumerate(label)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {x.doc_id: x for x in quality.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in range(600) if got[i].held_out} == set(held) and not got[None].held_out
    assert sum(got[i].predicted == label[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got.values()) and got[601].score == got[None].score
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(x.predicted for x in got.values())
    # labels of held-out rows are never looked at
    turned = spark.createDataFrame([(i, 1 - y if i in held else y, 0) for i, y in enumerate(label)], "doc_id long, quality int, toxic int")
    assert {x.doc_id: x.score for x in quality.score(docs, quality.fit(docs, turned)).collect()} == {k: x.score for k, x in got.items()}


def test_isotonic():
    assert quality.isotonic(np.array([1.0, 3, 2, 4]), np.ones(4)).tolist() == [1, 2.5, 2.5, 4]
    assert quality.isotonic(np.zeros(0), np.zeros(0)).tolist() == []


# 4


def shingles(text, k=5):
    w = word_list(text)
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def jaccard_brute(texts, percent=75):
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return [len(s) for s in sets], union(len(sets), links)


def near_texts(seed, n, copies):
    r = random.Random(seed)
    shared = prose(r, 60, 5000)
    base = [prose(r, r.randint(3, 120), 5000) + (" " + shared if r.random() < 0.4 else "") for _ in range(n)]
    out = [*odd_texts(r), *base]
    for _ in range(copies):
        w = r.choice(base[:8]).split()
        for _ in range(r.randint(0, 1 + len(w) // 25)):
            w[r.randrange(len(w))] = f"edit{r.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("seed", "slots"), [(1, None), (2, 64)])
def test_jaccard_join(spark, seed, slots):
    texts = near_texts(seed, 60, 160)
    sizes, comp = jaccard_brute(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs_of(spark, texts), slots=slots).collect()}
    assert got == {i: (n, c) for i, (n, c) in enumerate(zip(sizes, comp, strict=True))}
    assert len(set(comp)) < len(comp) - 60


def test_jaccard_join_null_and_repeated_ids(spark):
    text = "a b c d e f g h"
    rows = jaccard_join.join(docs_of(spark, [text, text, text, None, text + " i"], [None, 4, 4, 9, 2])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in rows) == [(False, 2, 5, 2), (False, 4, 4, 2), (False, 4, 4, 2), (False, 9, 0, 9), (True, 0, 4, 0)]
    assert jaccard_join.join(docs_of(spark, [])).count() == 0


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)] + [(350, 350)]
    want = union(400, links)
    got = {x.id: x.component for x in components.components(spark.createDataFrame(links, "u long, v long").repartition(3)).collect()}
    assert got == {i: want[i] for i in {x for p in links for x in p}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 7


def test_license_scan(spark):
    texts = [None, "", "...", "Released under the MIT License.", "x MIT  license, mit-license y", "the gnu General Public License v3", "this work is licensed under the very GNU general public license version 3",
             "Licensed under the Apache License, Version 2.0. " * 3, "MİT license", "mit licenses", "apacheK license", "all rights reserved"]
    got = {r.doc_id: r for r in license_scan.scan(docs_of(spark, texts)).collect()}
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) for t in texts]
    for i, w in enumerate(words):
        at = {label: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for p, label in license_scan.BASE.items()}
        every = sorted(x for v in at.values() for x in v)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(k for k, v in at.items() if v)))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[6].labels == "gpl" and got[11].labels == "all-rights-reserved" and got[0].labels == "" and got[4].n_base == 2
    assert license_scan.scan(docs_of(spark, [])).count() == 0
    odd = license_scan.scan(docs_of(spark, ["mit license"] * 3, [None, 1, 1])).collect()
    assert len(odd) == 3 and all(r.n_base == 1 for r in odd)


# 8 and 9


def test_word_ids_are_those_of_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [t for t in odd_texts(random.Random(6))] + ["it's 12.5, o'clock. A.,B", "a\x01b \x01 c", "x y İ ΑΣ", "<|endoftext|> ok", "é É."]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = [list(x) for _, ids, at in packing.document_ids(iter([batch]), path, 0) for x in np.split(ids, at[1:-1])]
    assert got == [[*packing._tokenizer(path).encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    r = random.Random(7)
    texts = [*odd_texts(r), *[prose(r, r.randint(1, 400)) for _ in range(80)]]
    rows = packing.pack(docs_of(spark, texts), path, capacity=256).collect()
    ids = [[*packing._tokenizer(path).encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    want = {(i, k): (s, len(x[s : s + 256]), zlib.crc32(np.array(x[s : s + 256], "<u4").tobytes())) for i, x in enumerate(ids) for k, s in enumerate(range(0, len(x), 256))}
    assert {(x.doc_id, x.piece): (x.start, x.length, x.ids_crc32) for x in rows} == want and len(rows) == len(want)
    by = defaultdict(list)
    for x in rows:
        by[x.sequence_id].append((x.offset, x.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 256
    assert len(by) <= math.ceil(sum(map(len, ids)) / 256) * 1.02 + 1


def test_packing_repeated_and_empty(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(docs_of(spark, ["a b", "a b", None], [1, 1, None]), path).collect()
    assert len(rows) == 3 and len({(x.sequence_id, x.offset) for x in rows}) == 3
    assert packing.pack(docs_of(spark, []), path).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_piece_once(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 2048])
    hist = {r.randint(1, capacity): r.randint(1, 500) for _ in range(r.randint(1, 60))}
    total = sum(x * n for x, n in hist.items())
    for groups, large in itertools.product((1, 4, 24), (2, 4, 8)):
        plan = packing.plan_of(hist, capacity, groups, large)
        ranks, used = defaultdict(list), defaultdict(list)
        for length, rank, n, first, offset in plan.runs:
            ranks[length] += range(rank, rank + n)
            for i in range(n):
                used[first + i].append((offset, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in hist.items()}
        assert sorted(used) == list(range(plan.sequences))
        for parts in used.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= capacity
        assert plan.sequences >= math.ceil(total / capacity)


def tiktoken_encoding(path):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    r = random.Random(9)
    pieces = ["'s", "'t", "'re", "'ll", "'", "''", " ", "  ", "\n", "\t", "a", "re", "S", "é", "日本", "1", "٣", "!", "..", "don't", "\x85", "😀", "ſ", "\x1f"]
    texts = [*odd_texts(r), *["".join(r.choice(pieces) for _ in range(r.randint(0, 50))) for _ in range(300)], "a" * 5000, " " * 3000, "'s"]
    encoding = tiktoken_encoding(path)
    docs = docs_of(spark, texts)
    got = {x.doc_id: x for x in byte_bpe.digests(docs, path).collect()}
    for i, t in enumerate(texts):
        ids = encoding.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want
    back = {x.doc_id: bytes(x.data).decode() for x in byte_bpe.decode(byte_bpe.encode(docs, path), path).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert byte_bpe.digests(docs_of(spark, []), path).count() == 0


def test_merges_that_make_a_lower_rank(tmp_path):
    path = tmp_path / "odd.tiktoken"
    tokens = [bytes([i]) for i in range(256)] + [b"abcd", b"cd", b"ab", b"bcd", b"abab", b"xyz"]
    path.write_bytes(b"".join(base64.b64encode(t) + b" " + str(i).encode() + b"\n" for i, t in enumerate(tokens)))
    book = byte_bpe.Ranks(str(path))
    for word in (b"abcd", b"ababab", b"aabcdcd", b"cdcd", b"a", b"xyz", b"xyzz"):
        ids, _ = book.replay(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
        assert ids.tolist() == book.one(word) == list(tiktoken_encoding(str(path))._encode_single_piece(word.decode()))


# 10


def test_lookup_table():
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 101)
    count = Counter(table.tolist())
    assert set(count) == set(range(7)) and max(count.values()) - min(count.values()) <= 1
    less = sharding.lookup_table(names[:-1], 101)
    assert sum(a != b for a, b in zip(table, less, strict=True) if a != 6) < 40
    assert set(sharding.lookup_table(["one"], 5).tolist()) == {0}
    for bad in (([], 5), (["a", "a"], 5), (["a"], 4), ([str(i) for i in range(5)], 5)):
        with pytest.raises(ValueError, match="prime|names"):
            sharding.lookup_table(*bad)


def test_sharding(spark):
    names = [f"s{i}" for i in range(5)]
    docs = docs_of(spark, ["x"] * 2003, [*range(2000), 7, 7, None]).withColumnRenamed("row", "slot")
    rows = sharding.place(docs, "doc_id", names, 101).collect()
    table = sharding.lookup_table(names, 101)
    for x in rows:
        key = "" if x.doc_id is None else str(x.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101
        assert (x.slot, x.shard) == (slot, names[table[slot]])
    assert len(rows) == 2003 and max(Counter(x.shard for x in rows).values()) < 500
    assert sharding.place(docs.where("doc_id < 0"), "doc_id", names, 101).count() == 0


# pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    texts, toxic = toxic_corpus(200)
    junk = ["BAD!! " * 40, "LINE##\n" * 30, "$$ %% ## " * 30]
    texts += [texts[1], texts[1], texts[2] + " more", *junk * 14, None]
    ids = [*range(len(texts) - 1), None]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(i, 1, t) for i, t in enumerate(toxic)] + [(i, 0, 0) for i in range(203, 245)]
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    step = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, step, sf)
        assert after.columns == docs.columns
        after.write.parquet(f"{sf}/{name}")
        step = spark.read.parquet(f"{sf}/{name}")
        kept[name] = {r.doc_id for r in step.select("doc_id").collect()}
    assert not kept["quality"] & set(range(203, 245)) and len(kept["quality"] & set(range(200))) > 190
    assert sum(i in kept["toxicity"] for i in range(200) if toxic[i]) <= 2 and all(i in kept["toxicity"] for i in range(1, 200, 5) if i in kept["quality"])
    assert len({1, 200, 201} & kept["near_duplicates"]) == 1
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept["near_duplicates"]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


@pytest.mark.parametrize("name", ["op2_exact_top_k", "op4_ngram_jaccard_join", "op5_embedding_dedup", "op7_license_scan", "op10_sharding"])
def test_sql(spark, name):
    import os

    import duckdb

    from readqc.llm import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    rows = queries.QUERIES[name](spark, sf)
    columns = sorted(rows.columns)
    with duckdb.connect() as c:
        for t in ("documents", "embeddings"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = c.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in rows.select(*columns).collect())
