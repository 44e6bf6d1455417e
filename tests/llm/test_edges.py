"""Repeated rows, ties, very long texts and clashing names against brute force."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from readqc.llm import arrays, byte_bpe, components, embedding_dedup, fixed, jaccard_join, license_scan, quality, shared, sharding, textkernel, topk, toxicity, vectors, wordtable

VEC = "vec_id long, embedding array<float>, row string, block int, x int"  # the last three clash with names that operators use


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "r", 1, 2) for i, v in rows], VEC).repartition(parts)


def cloud(seed, n, size=8, spread=0.15):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, size))
    x[n // 2 :] = x[: n - n // 2] + spread * g.normal(size=(n - n // 2, size))
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


def top_k_brute(rows, asked, k=10):
    """rows and asked: (id, vector); a candidate's score is its best with any vector of the query's id."""
    whole = [(i, np.array([math.floor(1024 * c) for c in v], object)) for i, v in rows]
    of = defaultdict(list)
    for i, v in asked:
        of[i].append(np.array([math.floor(1024 * c) for c in v], object))
    out = {}
    for q, own in of.items():
        best = sorted((-max(int(e @ v) for e in own), i) for i, v in whole if i != q)[:k]
        out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_top_k_with_repeated_rows(spark, monkeypatch, small):
    if small:  # many shards and blocks, so that the kth score travels
        monkeypatch.setattr(topk, "SHARD", 40)
        monkeypatch.setattr(topk, "BLOCK", 8)
        monkeypatch.setattr(topk, "BALLS", 3)
        monkeypatch.setattr(vectors, "DIRECT", 4)
        monkeypatch.setattr(vectors, "TOPS", 2)
    rows = cloud(3, 150) * 2 + [(0, [9.0] * 8), (7, [0.0] * 8)]
    df = table(spark, rows)
    asked = df.where("vec_id % 10 = 0")
    got = defaultdict(list)
    for r in topk.search(df, asked).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert got == top_k_brute(rows, [(i, v) for i, v in rows if i % 10 == 0])
    assert all(len(v) == 10 for v in got.values())


def dedup_brute(rows, cosine=0.9):
    x = np.array([v for _, v in rows], float)
    x /= np.sqrt((x**2).sum(1))[:, None]
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            least = min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))], key=lambda k: (rows[k][0], k))
            if least != comp[i]:
                comp[i], changed = least, True
    return sorted((i, int(near[k].sum()), rows[comp[k]][0], rows[comp[k]][0] == i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("block", [16, 64, 5000])
def test_embedding_dedup_with_repeated_rows(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "EDGES", 50)
    monkeypatch.setattr(embedding_dedup, "OUTLINES", 3)
    rows = cloud(4, 120) * 2 + [(3, [5.0] + [0.0] * 7)] + [(500, [1.0] * 8)] * 40
    got = sorted(tuple(r) for r in embedding_dedup.dedup(table(spark, rows)).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == dedup_brute(rows)


def test_two_rows_of_one_id_link(spark):
    rows = embedding_dedup.dedup(table(spark, [(4, [1.0, 2.0]), (4, [1.0, 2.0]), (9, [-1.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rows) == [(4, 1, 4, True), (4, 1, 4, True), (9, 0, 9, True)]


def test_nearest_by_groups_of_pivots():
    g = np.random.default_rng(1)
    pivots, x = g.normal(size=(50, 6)), g.normal(size=(500, 6))
    half = (pivots**2).sum(1) / 2
    owner = vectors.nearest(pivots, pivots[:5], half[:5], 5, np.arange(5))
    got = vectors.nearest(x, pivots, half, 5, owner)
    first = np.argmax(x @ pivots[:5].T - half[:5], axis=1)
    assert (owner[got] == first).all() and (owner[:5] == np.arange(5)).all()
    assert (vectors.nearest(x, pivots, half, 50, np.arange(50)) == np.argmin(((x[:, None] - pivots[None]) ** 2).sum(2), axis=1)).all()


@pytest.mark.parametrize("rows", [[], [(1, 1, 0), (3, 1, 0)], [(7, 1, 0), (15, 0, 0)]])  # none; of one class; of two classes, held out (crc32 % 4 == 2)
def test_quality_stage_keeps_all_where_nothing_was_learned(spark, rows):
    docs = spark.createDataFrame([(i, None if i == 5 else "a clean text. " * i) for i in range(20)] + [(None, "x")], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
    kept = quality.accepted(docs, model)
    assert model.weights is None and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))


def test_vectors_of_every_size_meet_their_own(spark):
    rows = [(i, [1.0, float(i), 0.0]) for i in range(6)] + [(10, [1.0, 2.0]), (11, [1.0, 2.0]), (12, [-2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.dedup(df).collect()}
    assert len(got) == 9 and (got[10], got[11], got[12]) == ((1, 10, True), (1, 10, False), (0, 12, True)) and got[5][0] > 0
    best = topk.search(df, df.where("vec_id IN (0, 10)")).orderBy("query_id", "rank").collect()
    assert [(r.vec_id, r.score) for r in best if r.query_id == 10] == [(11, 5 << 20), (12, 0)]
    assert [r.vec_id for r in best if r.query_id == 0] == [1, 2, 3, 4, 5]


def test_top_k_keeps_large_components_and_exact_scores(spark):
    big = float(2**21)  # 2**31 when scaled
    rows = [(0, [big, 3.0]), (1, [big, 1.0]), (2, [big, 1.0 + 2**-10]), (3, [-big, 0.0]), (4, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    e = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    got = topk.search(df, df).collect()
    for q in e:
        best = sorted((-sum(a * b for a, b in zip(e[q], e[i], strict=True)), i) for i in e if i != q)
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.search(spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>"), df.limit(1).selectExpr("vec_id", "array(1D) AS embedding")).collect()


def test_rounded_kth_score_drops_no_better_row():
    q, x = np.array([[2.0**30, 1.0]]), np.array([[2.0**30, float(i)] for i in range(40)])
    best = topk.Best(q, np.array([-1]), 3)
    for a in (0, 20):
        order, nodes = topk.ball_tree(x[a : a + 20], 4)
        best.search(x[a : a + 20][order], np.arange(a, a + 20)[order], np.arange(a, a + 20)[order], nodes)
    assert best.found[0][1].tolist() == [39, 38, 37] and best.found[0][0].tolist() == [2**60 + i for i in (39, 38, 37)]


DOC = "doc_id long, text string, row int, h long, place string, slot int"  # all but the first two clash with names that operators use


def docs_of(spark, texts, ids=None, parts=3):
    rows = [(i, t, 7, 8, "p", 777) for i, t in zip(range(len(texts)) if ids is None else ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOC).repartition(parts)


def test_license_spans_are_verified(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this very software"
    warranty = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    cases = {
        "all rights all rights all rights": "",  # a place counts once, so nothing stands for "reserved"
        "rights reserved all rights": "",
        "all rights all rights reserved": "all-rights-reserved",
        "all rights reserved " * 3: "all-rights-reserved",
        ("word " * 150_000) + mit + (" word" * 150_000): "mit",
        warranty: "mit",
        "software software " + "the software " * 40: "",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "bsd",
    }
    got = {r.doc_id: r for r in license_scan.scan(docs_of(spark, list(cases))).collect()}
    assert [got[i].labels for i in range(len(cases))] == list(cases.values())
    assert got[4].n_words == 300_017 and all((r.score > 0) == bool(r.labels) for r in got.values())
    own = license_scan.scan(docs_of(spark, ["free as in beer", "x"]), notices={"as in beer": "beer"}).collect()
    assert sorted((r.doc_id, r.labels) for r in own) == [(0, "beer"), (1, "")]
    with pytest.raises(ValueError, match="sentences"):
        license_scan.scan(docs_of(spark, ["x"]), notices={"x " * 70: "long"})


def filled(names, slots):
    """The table by the plain rule: whole permutations, and turns in which each takes the next that is free."""
    number = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:14], 16)
    prefers = [[(number(f"start {n}") % slots + k * (number(f"step {n}") % (slots - 1) + 1)) % slots for k in range(slots)] for n in names]
    held, nexts = {}, [iter(p) for p in prefers]
    while len(held) < slots:
        for i, own in enumerate(nexts):
            if len(held) < slots:
                held[next(s for s in own if s not in held)] = i
    return [held[s] for s in range(slots)]


@pytest.mark.parametrize(("shards", "slots"), [(5, 101), (12, 1009), (512, sharding.SLOTS)])
def test_lookup_table_by_the_plain_rule(shards, slots):
    names = [f"shard-{i:04d}" for i in range(shards)]
    if slots < 2000:
        assert sharding.lookup_table(names, slots).tolist() == filled(names, slots)
    else:
        table = sharding.lookup_table(names, slots)
        counts = np.bincount(table)
        assert len(counts) == shards and counts.max() - counts.min() <= 1
        # shard 0 has the first turn: its start is its own
        assert table[int(hashlib.md5(f"start {names[0]}".encode()).hexdigest()[:14], 16) % slots] == 0


def test_sharding_with_odd_names(spark):
    names = [f"s{i}" for i in range(5)]
    rows = [(i % 40, 1, "x", 2, 3, 4, 5) for i in range(80)] + [(None, 1, "x", 2, 3, 4, 5)]
    df = spark.createDataFrame(rows, ["key.with `marks`", "at", "name", "slot_", "Slot", "whole", "shard_"])
    got = sharding.place(df, "key.with `marks`", names, 101)
    assert got.columns == ["key.with `marks`", "at", "name", "slot_", "whole", "shard_", "slot", "shard"]
    table = filled(names, 101)
    for r in got.collect():
        slot = int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], 16) % 101
        assert tuple(r)[1:] == (1, "x", 2, 4, 5, slot, names[table[slot]])
    assert got.count() == 81


def prose(r, n, vocabulary=3000):
    return " ".join(f"w{int(vocabulary * r.random() ** 2)}" for _ in range(n))


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard_brute(rows):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp = [low if c == high else c for c in comp]
    least = {c: min(rows[i][0] for i in range(len(rows)) if comp[i] == c) for c in set(comp)}
    return sorted((rows[i][0], len(sets[i]), least[comp[i]]) for i in range(len(rows)))


@pytest.mark.parametrize("hot", [1, 3, 12])
def test_jaccard_join_deals_common_shingles_over_parts(spark, hot):
    r = random.Random(hot)
    passage, base = prose(r, 40), prose(r, 60)
    rows = [(i, prose(r, r.randint(5, 40)) + " " + passage) for i in range(40)]
    for i in range(100, 180):  # a group of near copies, all different
        w = base.split()
        w[r.randrange(len(w))] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, base) for i in range(200, 230)] + rows[:10] + [(7, "other words for the id of another text"), (300, ""), (301, None)]
    got = sorted(tuple(x) for x in jaccard_join.join(docs_of(spark, [t for _, t in rows], [i for i, _ in rows]), hot=hot).select("doc_id", "n_shingles", "component_id").collect())
    assert got == jaccard_brute(rows)


@pytest.mark.parametrize("kept", [8, 14])
def test_jaccard_join_where_postings_take_shingles_for_one(spark, monkeypatch, kept):
    monkeypatch.setattr(jaccard_join, "POSTED_BITS", kept)
    r = random.Random(kept)
    rows = [(i, prose(r, r.randint(1, 50))) for i in range(50)]
    rows += [(100 + i, " ".join(w if r.random() < 0.98 else f"edit{i}" for w in t.split())) for i, t in rows[:30]] + rows[:3]
    got = sorted(tuple(x) for x in jaccard_join.join(docs_of(spark, [t for _, t in rows], [i for i, _ in rows]), hot=2).select("doc_id", "n_shingles", "component_id").collect())
    assert got == jaccard_brute(rows) and any(a != c for a, _, c in got)


def test_components_stop_when_all_links_go_to_roots(spark, monkeypatch):
    made = []
    monkeypatch.setattr(components, "written", lambda df, what: made.append(what) or shared.written(df, what))
    for links, rounds in ([(9, 1), (8, 1), (1, 7), (7, 1), (5, 2), (3, 3)], 0), ([(1, 2), (2, 3)], 1), ([(i, i + 1) for i in range(9)], None):
        made.clear()
        got = {x.id: x.component for x in components.components(spark.createDataFrame(links, "u long, v long").repartition(2)).collect()}
        least = {i: i for p in links for i in p}
        for _ in least:
            for u, v in links:
                least[u] = least[v] = min(least[u], least[v])
        assert got == least and (rounds is None or len(made) == 1 + rounds)


def test_pipeline_stage_of_near_duplicates_looks_at_rows(spark):
    import corpus_pipeline

    r = random.Random(2)
    a, b = prose(r, 50), prose(r, 50)
    rows = [(3, a), (5, a + " more"), (5, b), (8, b), (8, b), (9, ""), (9, ""), (None, a), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 99) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())) == sorted([(False, 3, a), (False, 5, b), (False, 9, ""), (False, 9, ""), (True, 0, a), (False, 4, "")])


def test_pipeline_stage_of_near_duplicates_follows_pairs_without_a_round(spark, monkeypatch):
    import corpus_pipeline

    asked, made = [], []
    monkeypatch.setattr(jaccard_join, "components", lambda links: asked.append(1) or components.components(links))
    monkeypatch.setattr(components, "written", lambda df, what: made.append(what) or shared.written(df, what))
    r = random.Random(6)
    texts = [prose(r, 60) for _ in range(20)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([*texts, *(t + " more" for t in texts)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == list(range(20))
    assert len(made) == len(asked) > 0  # links that go to roots at once are written once and not again


def test_pipeline_stage_of_near_duplicates_holds_no_sets_in_memory(spark, monkeypatch):
    import corpus_pipeline

    plans = []

    def seen(df, what):
        if what == "found":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        return shared.written(df, what)

    monkeypatch.setattr(jaccard_join, "written", seen)
    r = random.Random(8)
    texts = [prose(r, 60) for _ in range(20)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([*texts, *(t + " more" for t in texts)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == list(range(20))
    worked = [x for x in plans if "MapInArrow" in x]
    assert worked and not any("InMemoryTableScan" in x for x in plans)
    # both joins read one exchange, so the sets are worked out once
    assert all(x.count("MapInArrow") == x.count("ReusedExchange") == 1 for x in worked)


@pytest.mark.parametrize("stage", ["quality", "toxicity"])
def test_pipeline_stages_look_at_pieces_of_a_batch(spark, monkeypatch, stage):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    made, asked = [], []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, kind: made.append(f) or self)

    class Model:
        weights = np.ones(1)

        def score(self, sizes):
            return (sizes % 2).astype(float)

        def severity(self, column):
            sizes = lengths(column)
            return sizes, ((sizes + 1) % 2).astype(float)

    def lengths(column):
        asked.append([len(t or "") for t in column.to_pylist()])
        return np.array(asked[-1])

    monkeypatch.setattr(quality, "statistics", lengths)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: type("Shared", (), {"value": value}))
    quality.accepted(docs, Model()) if stage == "quality" else toxicity.clean(docs, Model())
    sizes = [700_001, 700_000, 0, 700_003, 700_005, 3_000_000, 5, 3_000_001, 700_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array(["x" * n if n else None for n in sizes]), pa.array(["en"] * len(sizes))], docs.columns)
    got = [row for out in made[0](iter([batch, batch.slice(0, 0)])) for row in out.to_pylist()]
    assert got == [row for row in batch.to_pylist() if len(row["text"] or "") % 2]
    # a piece ends with the row that passes its size, whatever a batch holds
    assert sum(asked, []) == sizes and all(sum(x[:-1]) < 2 << 20 for x in asked)


def test_sums_hold_one_array_of_the_whole_length(spark, monkeypatch):
    length, most = 1 << 22, []
    docs = spark.createDataFrame([(1,)], "x long").repartition(1)

    def run(self, f, kind):
        tracemalloc.start()
        rows = [r for out in f(iter([])) for r in out.to_pylist()]
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        held.extend(rows)
        raise StopIteration

    held: list[dict] = []
    monkeypatch.setattr(type(docs), "mapInArrow", run)
    with pytest.raises(StopIteration):
        fixed.summed(docs, lambda batches, out: out.__setitem__(slice(None), 1000), length, np.uint8)
    assert b"".join(r["data"] for r in held) == b"\xff" * length
    # the counts (four bytes), what goes out and its copies for this test, but no second array of four bytes
    assert most[0] < 7.5 * length


def test_words_of_one_hash_are_told_apart():
    words = [b"one", b"two", b"three", b"a rather long word", b"a rather long wort", b"", b"one", b"two"]
    ends = np.cumsum([len(w) for w in words])
    data, starts = np.frombuffer(b"".join(words), np.uint8), np.append(0, ends[:-1])
    ids = lambda d, o: (d.astype(np.uint32), o)
    for hashed in (textkernel.span_hash, lambda d, s, e: np.zeros(len(s), np.uint64), lambda d, s, e: (e - s).astype(np.uint64)):
        table = wordtable.WordTable(ids, hashed=hashed)
        for part in (slice(0, 4), slice(0, 8), slice(3, 8)):
            numbers = table.add(data, starts[part], ends[part])
            table.encode_new()
            assert [bytes(table.ids_of(numbers[i : i + 1]).astype(np.uint8)) for i in range(len(numbers))] == words[part]
        assert len(table.starts) == len(set(words))


def test_vocabulary_misses_are_worked_out(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    words = byte_bpe.vocabulary(docs_of(spark, ["some words", None, "more words"]), path)
    find = byte_bpe.Lookup(words)
    for text in ([b" words", b"unseen", b"some", b"\xe6\x97\xa5"], [b"x"], []):
        cut = np.concatenate([[0], np.cumsum([len(w) for w in text])]).astype(np.int64)
        got, at = find(np.frombuffer(b"".join(text), np.uint8), cut)
        assert [got[a:b].tolist() for a, b in zip(at, at[1:])] == [find.book.one(w) for w in text]


def test_arrays_open_when_asked_for(tmp_path):
    folder = f"file://{tmp_path}"
    for i in range(6):
        arrays.save(folder, f"a-{i}", np.arange(i, dtype=np.uint16))
        arrays.save(folder, f"a-{i}", np.arange(i, dtype=np.uint16))
    shelf = arrays.Shelf(folder, 2)
    assert [shelf[f"a-{i}"].tolist() for i in (0, 5, 3, 5, 0)] == [[], list(range(5)), [0, 1, 2], list(range(5)), []] and len(shelf.held) == 2
    with pytest.raises(FileNotFoundError):
        shelf["b"]
    assert sorted(x.name for x in tmp_path.iterdir()) == [f"a-{i}" for i in range(6)]
