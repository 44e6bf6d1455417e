"""Rows to learn from are bounded where doc_ids repeat, components are named by their least document, tokenizers are looked at."""

import json
import random

import pytest

from readqc.llm import jaccard_join, packing, quality, toxicity
from readqc.llm.shared import thinned

WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "ra", "se", "to") for b in ("dal", "fen", "gor", "hik", "jum", "pas", "ril", "vex")]


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n))


def copies(spark, r: random.Random, times: int):
    """40 labelled doc_ids of prose, every fourth with marked words; one doc_id stands there so many times over."""
    rows = [(i, prose(r, 40) + (" vilescum grubnard" * 3 if i % 4 == 0 else "")) for i in range(40)]
    docs = spark.createDataFrame(rows + [rows[1]] * times, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int, quality int")
    return rows, docs, labels


def test_thinned_keeps_different_rows_once(spark):
    rows = spark.createDataFrame([(str(i), i % 2) for i in range(300)] * 3, "text string, y int")
    assert sorted(r.text for r in thinned(rows, 1000).collect()) == sorted(map(str, range(300)))
    some = thinned(rows, 100).collect()
    assert 60 < len(some) < 140 and len({r.text for r in some}) == len(some)
    assert sorted(r.text for r in thinned(rows.repartition(5), 100).collect()) == sorted(r.text for r in some)
    assert thinned(rows.limit(0), 10).count() == 0


def test_toxicity_learns_from_no_more_rows_than_the_limit(spark, monkeypatch):
    rows, docs, labels = copies(spark, random.Random(1), 500)
    seen = []
    fit_ordinal = toxicity.fit_ordinal
    monkeypatch.setattr(toxicity, "fit_ordinal", lambda doc, feature, x, share, grade, size: seen.append(len(grade)) or fit_ordinal(doc, feature, x, share, grade, size))
    for limit, most in ((60, 40), (10_000, 540)):
        model = toxicity.fit(docs, labels, limit)
        got = {r.doc_id: r.toxic for r in toxicity.score(docs, model).collect()}
        assert seen.pop() == most and got == {i: int(i % 4 == 0) for i, _ in rows}


def test_quality_learns_from_no_more_rows_than_the_limit(spark, monkeypatch):
    _, docs, labels = copies(spark, random.Random(2), 500)
    learned = docs.join(labels, "doc_id").where(~quality.held_out()).count()
    seen = []
    sums = quality._sums

    def watched(rows, parts, *kind):
        out = sums(rows, parts, *kind)
        seen.append(int(out["n"][0]) if "xx" in out else None)
        return out

    monkeypatch.setattr(quality, "_sums", watched)
    for limit in (60, 10_000):
        seen.clear()
        quality.fit(docs, labels, limit)
        sizes = [n for n in seen if n is not None]
        assert sizes[0] == learned and (sizes[-1] <= 40 if limit == 60 else len(sizes) == 1)


def test_components_are_named_by_their_least_document(spark):
    r = random.Random(4)
    a, b, c = (prose(r, 60) for _ in range(3))
    # chains, so that a component's least document is met late; doc_id 7 holds two texts that don't link
    rows = [(90, a), (50, a + " more"), (70, a + " more still"), (7, b), (7, c), (9, c + " end"), (-3, c + " end now"), (8, b + " end"), (None, a), (60, None)]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted((x.doc_id, x.n_shingles, x.component_id) for x in got.collect() if x.doc_id is not None)
    assert found == sorted([(90, 56, 50), (50, 57, 50), (70, 58, 50), (7, 56, 7), (7, 56, -3), (9, 57, -3), (-3, 58, -3), (8, 57, 7), (60, 0, 60)])
    # no task gathers a component's members for its name
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "component" in plan and not any("Aggregate [component" in x for x in plan.splitlines())


def test_a_tokenizer_that_joins_words_is_refused(tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    packing._tokenizer(path)
    with open(path) as f:
        made = json.load(f)
    made["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    (tmp_path / "joins.json").write_text(json.dumps(made))
    with pytest.raises(ValueError, match="apart"):
        packing._tokenizer(str(tmp_path / "joins.json"))
