"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of a text (lengths, shares of kinds of characters, repetition of words and lines) are taken from
the whole text in vector passes over the batch. Random Fourier features stand for a Gaussian kernel over
them; their normal equations are sums, taken by partition and added up by an exchange, so training has a
size that the number of features sets. The ridge scores of the training rows, put into fixed bins, give an
isotonic (pool adjacent violators) map to the share of label 1.

Nulls: a null text is an empty text and has a score; a null doc_id stays null, is not learned from and counts as not
held out. Repeated rows give a row each. Without training labels every score is the neutral 0.5. An empty table gives no rows. Ties: equal
statistics give equal scores, and a score of just ACCEPT is accepted. Texts of any length are judged whole, one beyond PIECE bytes by itself. Other
columns of the input are ignored; labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readqc.llm import textkernel as K
from readqc.llm.shared import arrow, texts, thinned, written

#: Random features; width of the kernel in standard deviations; ridge; bins of calibration; threshold of `predicted`; seed.
FEATURES, WIDTH, RIDGE, BINS, ACCEPT, SEED = 384, 5.0, 1.0, 200, 0.7, 7
#: Training takes this many labelled rows of the input at most, in expectation (chosen by a hash of doc_id, and where documents repeat their doc_id
#: so often that there are still more rows, of different rows by a hash of statistics and label); other rows are scored only.
TRAIN_ROWS = 200_000
PIECE = 2 << 20

_KIND = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 stop or comma, 7 other mark, 8 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[0x20, 0x09]], _KIND[[0x0A, 0x0D]] = 4, 5
for _c in b".,":
    _KIND[_c] = 6
for _c in b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~":
    _KIND[_c] = 7
_KIND[128:] = 8
NAMES = (
    "log_bytes", "log_words", "log_lines", "lower", "upper", "digit", "blank", "line_end", "stop", "mark", "wide", "word_mean", "word_sd", "word_long",
    "words_per_line", "distinct", "top_word", "repeat_next", "pairs_distinct", "grams_distinct", "lines_distinct", "marked_words", "upper_words", "digit_words", "words_per_stop", "one_letter",
)


def _segment(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(h: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in each document and the count of its most frequent one."""
    if not len(h):
        return np.zeros(docs), np.zeros(docs)
    own = h ^ K.mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(own, kind="stable")
    own, doc = own[order], doc[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    size = np.diff(np.append(first, len(own)))
    top = np.zeros(docs)
    np.maximum.at(top, doc[first], size)
    return np.bincount(doc[first], minlength=docs).astype(float), top


def statistics(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A row of statistics for each text, finite for every text."""
    text = K.flat(column)
    n = text.docs
    size = np.diff(text.offsets).astype(float)
    kind = _KIND[text.data]
    share = [_segment(kind == k, text.offsets) for k in range(9)]
    low = K.LOWER[text.data]
    starts, ends, bounds = K.word_spans(text, ~K.SPACE[low])
    words = np.diff(bounds).astype(float)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    h = K.span_hash(low, starts, ends)
    length = (ends - starts).astype(float)
    line_starts, line_ends, line_bounds = K.word_spans(text, text.data != 0x0A)
    lines = np.diff(line_bounds).astype(float)
    line_distinct, _ = _distinct(K.span_hash(low, line_starts, line_ends), np.repeat(np.arange(n), np.diff(line_bounds)), n)
    distinct, top = _distinct(h, doc, n)
    same = doc[1:] == doc[:-1]
    pair_distinct, _ = _distinct(K.gram_hashes(h, 2)[same], doc[1:][same], n)
    far = doc[4:] == doc[:-4]
    gram_distinct, _ = _distinct(K.gram_hashes(h, 5)[far], doc[4:][far], n)
    repeat = np.bincount(doc[1:][same & (h[1:] == h[:-1])], minlength=n).astype(float)
    mean = _segment(length, bounds) / np.maximum(words, 1)
    square = _segment(length**2, bounds) / np.maximum(words, 1)
    last, head = kind[ends - 1] if len(ends) else kind[:0], kind[starts] if len(starts) else kind[:0]
    second = kind[np.minimum(starts + 1, np.maximum(ends - 1, 0))] if len(starts) else kind[:0]
    w, b = np.maximum(words, 1), np.maximum(size, 1)
    stops = share[6]
    out = np.array([
        np.log1p(size), np.log1p(words), np.log1p(lines), share[1] / b, share[2] / b, share[3] / b, share[4] / b, share[5] / b, stops / b, share[7] / b, share[8] / b,
        np.minimum(mean, 50), np.sqrt(np.maximum(np.minimum(square, 2500) - np.minimum(mean, 50) ** 2, 0)), _segment(length > 14, bounds) / w,
        np.log1p(words / np.maximum(lines, 1)), distinct / w, top / w, repeat / w, pair_distinct / np.maximum(words - 1, 1), gram_distinct / np.maximum(words - 4, 1),
        line_distinct / np.maximum(lines, 1), _segment(last == 7, bounds) / w, _segment((head == 2) & (second == 2), bounds) / w, _segment(head == 3, bounds) / w, np.log1p(words / np.maximum(stops, 1)), _segment(length == 1, bounds) / w,
    ])
    return out.T


@dataclass
class Model:
    """mean, scale: of the statistics; frequency, phase: of the random features; weights: of the ridge; edges, level: of the
    calibration. None of them grows with the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None = None
    edges: np.ndarray | None = None
    level: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(x), 1)), z, np.sqrt(2 / len(self.phase)) * np.cos(z @ self.frequency + self.phase)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.interp(self.raw(x), self.edges, self.level)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence nearest to value under weight: pool adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def _sums(rows: DataFrame, parts, kind: str = "name string, data binary") -> dict[str, np.ndarray]:
    """Adds up, over all partitions, the arrays that parts(stats, labels) names. Each array is summed by an exchange of its own."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
                for k, v in parts(x, b.column(1).to_numpy().astype(float)).items():
                    total[k] = total[k] + v if k in total else v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["name", "data"])

    def add(key, batches):
        total = None
        for b in batches:
            for x in b.column(1):
                v = np.frombuffer(x.as_buffer(), np.float64)
                total = v.copy() if total is None else total + v
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total.tobytes()], pa.binary())], ["name", "data"])

    def add_all(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return add(key, batches)

    return {r["name"]: np.frombuffer(bytes(r["data"]), np.float64) for r in rows.mapInArrow(run, kind).groupBy("name").applyInArrow(add_all, kind).collect()}


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, y) of the rows to learn from: not held out, quality 0 or 1, of `limit` doc_ids at most in expectation."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    if (n := known.count()) > limit:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * limit / n))
    return texts(docs).join(F.broadcast(known), "doc_id")  # `limit` doc_ids and labels


def _with_statistics(rows: DataFrame) -> DataFrame:
    def run(batches):
        for piece in K.chunks(batches, "text", PIECE):
            x = statistics(piece["text"])
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64())), piece["y"].combine_chunks()], ["x", "y"])

    return rows.select("text", "y").mapInArrow(run, "x array<double>, y int")


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Model:
    """Learns from the labelled rows of docs, `limit` at most in expectation."""
    arrow(docs.sparkSession)
    rows = written(_with_statistics(training_rows(docs, labels, limit)), "statistics")
    d = len(NAMES)
    random = np.random.default_rng(SEED)
    model = Model(np.zeros(d), np.ones(d), random.normal(0, 1 / WIDTH, (d, FEATURES)), random.uniform(0, 2 * np.pi, FEATURES))

    def moments(x, y):
        return {"n": np.array([len(y), y.sum()]), "x": x.sum(0), "xx": (x**2).sum(0)}

    first = _sums(rows, moments)
    if first and first["n"][0] > 1.1 * limit:  # more than the chance of a hash explains
        rows = thinned(rows, limit)
        first = _sums(rows, moments)
    if not first or not 0 < first["n"][1] < first["n"][0]:
        return model
    n = first["n"][0]
    model.mean = first["x"] / n
    model.scale = np.sqrt(np.maximum(first["xx"] / n - model.mean**2, 0)) + 1e-6
    balance = np.array([0.5 / (1 - first["n"][1] / n), 0.5 / (first["n"][1] / n)])

    def normal(x, y):
        f = model.features(x)
        fw = f * balance[y.astype(int)][:, None]
        # in blocks of rows, so that the adding up is spread too
        return {f"a{i}": (fw[:, i : i + 32].T @ f).reshape(-1) for i in range(0, f.shape[1], 32)} | {"b": fw.T @ y}

    eq = _sums(rows, normal)
    m = 1 + d + FEATURES
    a = np.vstack([eq[f"a{i}"].reshape(-1, m) for i in range(0, m, 32)])
    ridge = RIDGE * np.eye(m)
    ridge[0, 0] = 0
    model.weights = np.linalg.solve(a + ridge, eq["b"])
    edges = np.linspace(-0.5, 1.5, BINS)

    def bins(x, y):
        at = np.clip(np.round((model.raw(x) + 0.5) / 2 * (BINS - 1)).astype(int), 0, BINS - 1)
        return {"n": np.bincount(at, minlength=BINS).astype(float), "y": np.bincount(at, y, BINS)}

    got = _sums(rows, bins)
    full = got["n"] > 0
    model.edges = edges[full]
    # two rows at even chances are added to each bin, so that a few rows do not make it certain
    prior = first["n"][1] / n
    model.level = isotonic((got["y"][full] + prior) / (got["n"][full] + 1), got["n"][full])
    return model


def score(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """Per row of docs: doc_id, held_out, score and predicted (1 if score >= accept)."""
    arrow(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for piece in K.chunks(batches, "text", PIECE):
            s = shared.value.score(statistics(piece["text"]))
            yield pa.RecordBatch.from_arrays([piece["doc_id"].combine_chunks(), pa.array(s)], ["doc_id", "score"])

    scored = texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= accept).cast(T.IntegerType()).alias("predicted"))


def accepted(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least `accept`; every row if the model has learned nothing, as its 0.5 says nothing of a text."""
    if model.weights is None:
        return docs
    arrow(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        yield from K.kept(batches, "text", PIECE, lambda text: shared.value.score(statistics(text)) >= accept)

    return docs.mapInArrow(run, docs.schema)
