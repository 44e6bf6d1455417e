"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade <= j) = sigmoid(theta_j - w x): one weight a feature for all thresholds. Features are the words of a
text, A-Z in lower case, and their beginnings of four and five bytes, so that unseen inflections count. Those
are kept that labelled toxic texts hold far more often than others: first by sums in slots of fixed
number, then exactly. Labels say only toxic or not; the grades of the toxic texts are equal parts by
their share of marked words. A row's output is the expected grade, and `toxic` where a grade above 0 is
likelier than not.

Nulls: a null text is an empty text with a score; a null doc_id stays null and is not learned from. Repeated rows give a row
each. Without labels of both kinds every text has severity 0. An empty table gives no rows. Ties: features that equally many toxic texts
hold are chosen by hash; a probability of just a half is not toxic. Texts of any length are judged whole, one beyond PIECE bytes by itself. Other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readqc.llm import textkernel as K
from readqc.llm.fixed import summed
from readqc.llm.shared import arrow, texts, thinned, written

#: Grades above 0; features kept; toxic documents and odds that a feature needs; slots of the first sums.
GRADES, FEATURES, SUPPORT, ODDS, SLOTS = 3, 600, 4, 50.0, 1 << 20
#: The share of toxic documents that a feature needs where that is more than SUPPORT of them.
SUPPORT_SHARE = 0.004
#: Training takes this many labelled rows of the input at most, in expectation (chosen by a hash of doc_id, and where documents repeat their doc_id
#: so often that there are still more rows, of different rows by a hash of text and label); the other texts are scored only.
TRAIN_ROWS = 50_000
BEGINNINGS = (4, 5)
PIECE = 2 << 20
U = np.uint64
_INSIDE = np.zeros(256, bool)
_INSIDE[97:123] = True
_INSIDE[128:] = True


def features(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the features of all texts, the document of each, and the number of words of each document."""
    text = K.flat(column)
    low = K.LOWER[text.data]
    starts, ends, bounds = K.word_spans(text, _INSIDE[low])
    doc = np.repeat(np.arange(text.docs), np.diff(bounds))
    hashes, docs = [K.span_hash(low, starts, ends)], [doc]
    for k in BEGINNINGS:
        long = ends - starts > k
        hashes.append(K.span_hash(low, starts[long], starts[long] + k) ^ U(k))
        docs.append(doc[long])
    return np.concatenate(hashes), np.concatenate(docs), np.diff(bounds)


def _once(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (document, feature) once."""
    order = np.lexsort((hashes, docs))
    h, d = hashes[order], docs[order]
    first = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))[: len(h)]
    return h[first], d[first]


@dataclass
class Model:
    """known: sorted hashes of the features; weights: theirs, then that of the share of marked words; thresholds: ascending.
    None of them grows with the corpus."""

    known: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def found(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents, features and counts of what is known, and each document's share of marked words in hundredths."""
        hashes, docs, words = features(column)
        if not len(self.known):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0), np.zeros(len(words))
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        hit = np.flatnonzero(self.known[at] == hashes)
        pair, count = np.unique(docs[hit] * len(self.known) + at[hit], return_counts=True)
        doc, feature = np.divmod(pair, len(self.known))
        marked = np.bincount(docs[hit], minlength=len(words))
        return doc, feature, np.log1p(count), np.minimum(100.0 * marked / np.maximum(words, 1), 20)

    def severity(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the probability of a grade above 0."""
        doc, feature, x, share = self.found(column)
        z = np.bincount(doc, self.weights[feature] * x, minlength=len(share)) + self.weights[-1] * share
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -50, 50)))
        return above.sum(1), above[:, 0]


def fit_ordinal(doc: np.ndarray, feature: np.ndarray, x: np.ndarray, share: np.ndarray, grade: np.ndarray, size: int, ridge: float = 0.02, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient steps with moments on the mean log loss; thresholds keep their order as a start and
    positive gaps."""
    n = len(grade)
    top = int(grade.max())
    w = np.zeros(size + 1)
    free = np.zeros(top)  # first threshold, then logs of the gaps
    free[0] = 1.0
    m, v = np.zeros(size + 1 + top), np.zeros(size + 1 + top)
    for t in range(1, steps + 1):
        theta = free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])
        z = np.bincount(doc, w[feature] * x, minlength=n) + w[-1] * share
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = 1 / (1 + np.exp(-np.clip(edge[grade + 1] - z, -40, 40))), 1 / (1 + np.exp(-np.clip(edge[grade] - z, -40, 40)))
        p = np.maximum(hi - lo, 1e-12)
        ghi, glo = hi * (1 - hi) / p / n, lo * (1 - lo) / p / n
        gz = ghi - glo  # of the loss by z
        gt = np.zeros(top)
        np.add.at(gt, grade[grade < top], -ghi[grade < top])
        np.add.at(gt, grade[grade > 0] - 1, glo[grade > 0])
        gf = np.concatenate([[gt.sum()], np.exp(free[1:]) * np.cumsum(gt[::-1])[::-1][1:]])
        gw = np.append(np.bincount(feature, gz[doc] * x, minlength=size), gz @ share) + ridge / max(1, n) * w
        g = np.concatenate([gw, gf])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, free = w - move[: size + 1], free - move[size + 1 :]
    return w, free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, y) of the rows of labelled doc_ids, of which there are `limit` at most in expectation, by a hash of doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    if (n := known.count()) > limit:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * limit / n))
    return texts(docs).join(F.broadcast(known), "doc_id")  # `limit` doc_ids and labels


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Model:
    """Learns from the labelled rows of docs, `limit` at most in expectation."""
    arrow(docs.sparkSession)

    def sizes_of(rows):
        return {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}

    rows = written(training_rows(docs, labels, limit).select("text", "y"), "toxic")
    empty = Model(np.zeros(0, U), np.zeros(1), np.full(GRADES, 50.0))
    sizes = sizes_of(rows)
    if sum(sizes.values()) > 1.1 * limit:  # more than the chance of a hash explains
        rows = thinned(rows, limit)
        sizes = sizes_of(rows)
    if len(sizes) < 2:
        return empty

    support = max(SUPPORT, SUPPORT_SHARE * sizes[1])

    def count(batches, out):
        for piece in K.chunks(batches, "text", PIECE):
            hashes, doc = _once(*features(piece["text"])[:2])
            toxic = piece["y"].to_numpy()[doc] == 1
            np.add.at(out, (hashes >> U(40)).astype(np.int64) % SLOTS + SLOTS * toxic, np.uint32(1))

    totals = summed(rows, count, 2 * SLOTS).reshape(2, SLOTS).astype(float)
    # a slot holds what shares it, so the bound on others is loose here
    likely = (totals[1] >= support) & (totals[1] / sizes[1] * 4 >= totals[0] / sizes[0])
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(likely))

    def exact(batches: Iterator[pa.RecordBatch]):
        ok = np.unpackbits(shared.value)[:SLOTS].astype(bool)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for piece in K.chunks(batches, "text", PIECE):
            hashes, doc = _once(*features(piece["text"])[:2])
            keep = ok[(hashes >> U(40)).astype(np.int64) % SLOTS]
            held.append((hashes[keep], piece["y"].to_numpy()[doc[keep]]))
        if held:
            unique, back = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            toxic = np.bincount(back, np.concatenate([y for _, y in held]), len(unique)).astype(np.int64)
            both = np.bincount(back, minlength=len(unique))
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(toxic), pa.array(both - toxic)], ["h", "toxic", "other"])

    rate = (F.col("toxic") / sizes[1]) / ((F.col("other") + 0.5) / sizes[0])
    best = rows.select("text", "y").mapInArrow(exact, "h long, toxic long, other long").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where((F.col("toxic") >= support) & (rate >= ODDS))
    chosen = best.orderBy(F.col("toxic").desc(), "h").limit(FEATURES).collect()
    if not chosen:
        return empty
    known = np.sort(np.array([r["h"] for r in chosen], np.int64).view(U))
    model = Model(known, np.zeros(len(known) + 1), np.zeros(GRADES))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def sparse(batches):
        for piece in K.chunks(batches, "text", PIECE):
            doc, feature, x, share = sent.value.found(piece["text"])
            ends = np.searchsorted(doc, np.arange(len(share) + 1))
            lists = lambda a: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(a))
            yield pa.RecordBatch.from_arrays([piece["y"].combine_chunks(), lists(feature.astype(np.int32)), lists(x), pa.array(share)], ["y", "feature", "x", "share"])

    # rows without a known feature are all alike: one row for each label, with their number
    data = rows.select("text", "y").mapInArrow(sparse, "y int, feature array<int>, x array<double>, share double").where("size(feature) > 0").collect()
    bare = {0: sizes[0] - sum(r["y"] == 0 for r in data), 1: sizes[1] - sum(r["y"] == 1 for r in data)}
    y = np.array([r["y"] for r in data] + [0] * bare[0] + [1] * bare[1])
    share = np.array([r["share"] for r in data] + [0.0] * (bare[0] + bare[1]))
    lengths = [len(r["feature"]) for r in data]
    doc = np.repeat(np.arange(len(data)), lengths)
    feature = np.array([f for r in data for f in r["feature"]], np.int64)
    x = np.array([v for r in data for v in r["x"]], float)
    cuts = np.quantile(share[y == 1], np.arange(1, GRADES) / GRADES)
    grade = np.where(y == 1, 1 + np.searchsorted(cuts, share, side="right"), 0)
    if grade.max() < GRADES:  # too few toxic rows for all grades
        grade = np.minimum(y, 1)
    model.weights, model.thresholds = fit_ordinal(doc, feature, x, share, grade, len(known))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id, severity (expected grade), p_toxic and toxic (1 where p_toxic is over a half)."""
    arrow(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for piece in K.chunks(batches, "text", PIECE):
            severity, p = shared.value.severity(piece["text"])
            yield pa.RecordBatch.from_arrays([piece["doc_id"].combine_chunks(), pa.array(severity), pa.array(p), pa.array((p > 0.5).astype(np.int32))], ["doc_id", "severity", "p_toxic", "toxic"])

    return texts(docs).mapInArrow(run, "doc_id long, severity double, p_toxic double, toxic int")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that are not toxic."""
    arrow(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        yield from K.kept(batches, "text", PIECE, lambda text: shared.value.severity(text)[1] <= 0.5)

    return docs.mapInArrow(run, docs.schema)
