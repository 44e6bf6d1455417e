"""The prefix trie against plain recursion, in blocks of several sizes, and odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from readqc.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string, i int, d string, c long, len int, pos int"  # the last ones clash with names that the operator uses


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "d", 2, 3, 4) for r in rows], ROWS).repartition(parts)


def plain(rows, family=20, heads=4):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn, role or "", text or ""))
    key = lambda x: (x[0] is not None, x[0] or 0, hashlib.md5(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest())
    own = {c: [t[1:] for t in sorted(own[c], key=key)] for c in own}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        seqs[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in seqs.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = defaultdict(int)
    saved, leaves = defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, own_members in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(own_members) - 1) * words
            leaves[p[:d]] += not children[p]
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


def got(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def corpus(seed, n=120, longest=9, texts=3):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-60, 4 * n), n):
        start = r.choice([0, 0, 5])
        for t in range(r.randint(1, longest)):
            rows.append((c, start + t, r.choice(["user", "user", None]), r.choice(["hello there", "", None, "one\ttwo  three", "ähm"][:texts])))
    return rows


@pytest.mark.parametrize(("block", "chunk", "stretch"), [(4096, 1024, 1024), (3, 2, 2), (7, 1, 3)])
def test_trie(spark, monkeypatch, block, chunk, stretch):
    for name, value in {"BLOCK": block, "CHUNK": chunk, "STRETCH": stretch}.items():
        monkeypatch.setattr(prefix_trie, name, value)
    rows = corpus(block, texts=2 if block == 7 else 5)
    assert got(prefix_trie.prefix_trie(table(spark, rows))) == plain(rows)


def test_copies_of_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(6)] + [(c, t, "user", f"turn {min(t, c % 5)} {c % 3}") for c in range(300, 400) for t in range(7)]
    assert got(prefix_trie.prefix_trie(table(spark, rows, 7))) == plain(rows)


def test_ties_and_nulls(spark):
    rows = [(1, 0, "a", "x"), (1, 0, "a", "y"), (1, 0, "a", "x"), (1, None, None, None), (2, None, "", ""), (None, 0, "a", "x"), (40, 3, "r", "only"), (21, 1, "u", "v w"), (21, 2, "u", "v w"), (25, 1, "u", None)]
    assert got(prefix_trie.prefix_trie(table(spark, rows))) == plain(rows)


def test_turnless_conversations_and_empty_tables(spark):
    alone = [c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:3]
    rows = [(c, 0, "u", "gone") for c in alone]  # their first turns are to be another's, which is not there
    assert got(prefix_trie.prefix_trie(table(spark, rows))) == plain(rows)
    assert len(plain(rows)) == 1
    assert prefix_trie.prefix_trie(table(spark, [])).count() == 0


def test_one_long_conversation(spark, monkeypatch):
    for name, value in {"BLOCK": 5, "CHUNK": 16, "STRETCH": 8}.items():
        monkeypatch.setattr(prefix_trie, name, value)
    rows = [(20, t, "u", f"t{t}") for t in range(150)] + [(40, t, "u", f"t{t}") for t in range(60)] + [(60, t, "u", f"t{t if t != 70 else 0}") for t in range(100)] + [(80, 0, "u", "t0")]
    assert got(prefix_trie.prefix_trie(table(spark, rows))) == plain(rows)


def test_nearest_smaller_and_minima():
    g = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 100):
        a = g.integers(-1, 5, n)
        left, right = prefix_trie.nearest_smaller(a)
        for j in range(n):
            assert left[j] == max((k for k in range(j) if a[k] < a[j]), default=-1)
            assert right[j] == min((k for k in range(j + 1, n) if a[k] < a[j]), default=n)
        lo, hi = np.array([(i, j) for i in range(n) for j in range(i + 1, n + 1)]).T
        assert prefix_trie.Minima(a).of(lo, hi).tolist() == [int(a[i:j].min()) for i, j in zip(lo, hi, strict=True)]
