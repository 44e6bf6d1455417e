"""Interpolated modified Kneser-Ney model of word pairs or triples, counted in Spark, stored as sorted hash arrays.

Counting: tasks add up what a stretch of text holds and send it, packed, to buckets of the key range, as many as the input
asks for; a bucket merges what it gets into sorted arrays of keys and counts, written to the shared folder. As buckets are ranges of
keys, the arrays follow each other, and a place in them is a number: words first, then pairs. Keys of words are 64-bit
hashes. A pair is the numbers of its words, a triple the number of its first pair and of its last word, each mixed by a bijection of just the
bits that these numbers need, so that no two share a key and keys are short. What occurs once, the greater part, has a key and no count.
Scoring: workers map the arrays into memory and look up the sorted keys of a stretch of text.

p(w|uv) = max(c(uvw) - D(c(uvw)), 0) / c(uv) + g(uv) p(w|v), where g(uv) is the mass that the discounts D1, D2, D3+ free after uv. p(w|v) is the
same over the numbers of different words before vw, and p(w) over those before w, with the freed mass spread evenly over the V words and
one unknown word. Texts start after an end and close with one; as no word comes before that end, pairs that start with it keep their counts, and
the first word of a text is judged by pairs. A model of order 2 stops at p(w|v), over counts of pairs.

Nulls: a null text is an empty text (its end alone); a null doc_id stays null, is not learned from and counts as not held out. Repeated rows count and
score each. Without training rows the model is uniform; an empty table gives no rows. There are no ties: equal texts score alike. Texts of any length count
and score whole, one beyond PIECE bytes by itself. Other columns of the input are ignored. More than 2 ** 32 distinct words, or triples whose
numbers need over 64 bits, are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readqc.llm import arrays
from readqc.llm import textkernel as K
from readqc.llm.shared import arrow, new_folder, partitions, release, texts

U = np.uint64
END = U(0x8C7F0AACF7B6A1E3)  #: stands for the end of a text among word hashes
#: Tokens whose counts a task adds up before it sends them; bytes of text scored at once; the base rule's addition.
STRETCH, PIECE, ADD = 3_000_000, 6 << 20, 0.1
#: Keys that begin alike in an array, about.
PLACES = 16
#: Bits of the number of buckets at most.
TOP = 16
#: Words that the model looks back over, and one.
ORDER = 3


def tokens(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts with an end after each, and the bounds of texts."""
    w = K.words(column)
    return np.insert(w.hashes, w.bounds[1:], END), w.bounds + np.arange(len(w.bounds))


def bits_of(n: int) -> int:
    """Bits of the numbers under n; 1 at least."""
    return max(1, (n - 1).bit_length())


@dataclass
class Keys:
    """Keys of a kind: their bits, of which the topmost are the bucket. Keys of two numbers have left and right bits."""

    left: int
    right: int
    top: int

    @property
    def low(self) -> int:
        """Bits of a key within its bucket."""
        return self.left + self.right - self.top

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U(self.low)).astype(np.int64)

    def within(self, keys: np.ndarray) -> np.ndarray:
        return keys & U((1 << self.low) - 1)

    def edges(self, keys: np.ndarray) -> np.ndarray:
        """Where the buckets begin in sorted keys."""
        return np.searchsorted(self.bucket(keys), np.arange((1 << self.top) + 1))

    def _round(self, i: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if i % 2:
            return left, right ^ K.mix(left + U(i)) >> U(64 - self.right)
        return left ^ K.mix(right + U(i)) >> U(64 - self.left), right

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Keys of pairs of numbers: each half is mixed by the other in turn, which can be undone."""
        left, right = left.astype(U), right.astype(U)
        for i in (0, 1, 2):
            left, right = self._round(i, left, right)
        return left << U(self.right) | right

    def split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = keys >> U(self.right), keys & U((1 << self.right) - 1)
        for i in (2, 1, 0):
            left, right = self._round(i, left, right)
        return left.astype(np.int64), right.astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


SENT = "bucket long, keys binary, counts binary"


def _sent(found: list[tuple[np.ndarray, np.ndarray]], kind: Keys) -> Iterator[pa.RecordBatch]:
    keys, counts = _summed(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]))
    edges = kind.edges(keys)
    for b in np.flatnonzero(np.diff(edges)).tolist():
        part = slice(edges[b], edges[b + 1])
        row = [pa.array([b], pa.int64()), pa.array([K.pack_sorted(kind.within(keys[part]))], pa.binary()), pa.array([K.planes(counts[part].astype(np.uint32))], pa.binary())]
        yield pa.RecordBatch.from_arrays(row, ["bucket", "keys", "counts"])


def _counting(pieces: Iterator[pa.Table], keys_of: Callable[[pa.ChunkedArray], np.ndarray], kind: Keys) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for piece in pieces:
        held.append(np.unique(keys_of(piece["text"]), return_counts=True))
        n += len(held[-1][0])
        if n >= STRETCH:
            yield from _sent(held, kind)
            held, n = [], 0
    if held:
        yield from _sent(held, kind)


def _merge(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts, added up on the way, so that memory follows what is distinct."""
    keys, counts, held, whole = [], [], 0, 0
    for b in batches:
        for k, c in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
            keys.append(K.unpack_sorted(k))
            counts.append(K.unplanes(c, np.uint32).astype(np.int64))
            held += len(keys[-1])
            if held > STRETCH + whole:
                keys, counts = ([x] for x in _summed(np.concatenate(keys), np.concatenate(counts)))
                held, whole = 0, len(keys[0])
    return _summed(np.concatenate(keys), np.concatenate(counts))


def _save_keys(folder: str, name: str, keys: np.ndarray, low: int) -> None:
    """A bucket's sorted keys of so many bits. What is kept is their last 32 bits, and where the keys begin of each value of the bits above, or of more bits, so
    that some PLACES keys begin alike. Where the bits above have more values than there are keys, whole keys are kept."""
    piece = max(0, low - 32, min(low, bits_of(len(keys)) - bits_of(PLACES)))
    if low > 32 and 1 << piece > len(keys):
        arrays.save(folder, name, keys)
    else:
        arrays.save(folder, name, keys.astype(np.uint32))
        arrays.save(folder, f"{name}-begin", arrays.smallest(np.searchsorted(keys >> U(low - piece), np.arange((1 << piece) + 1, dtype=U))))


def discounts(n: np.ndarray) -> np.ndarray:
    """D for counts 0, 1, 2 and from 3 on, by the numbers n of things counted 1, 2, 3 and 4 times. Where many texts occur twice, the formulas of the three
    discounts ask for nearly all of a count of 2 and for less of a 1. Where a higher count would so keep a smaller share than a lower one, all three are
    the one discount of the unmodified method, n1 / (n1 + 2 n2)."""
    n = n.astype(float)
    if not n[0] or not n[1]:
        return np.array([0, 0.5, 0.75, 0.75])
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
    one, two, three = np.clip(d, 0.01, [1, 2, 3])
    if two > 2 * one or three > 1.5 * two:
        return np.array([0, y, y, y])
    return np.array([0, one, two, three])


def _none() -> np.ndarray:
    return np.zeros(0, np.int64)


@dataclass
class Model:
    """What a worker needs to map the arrays: their folder, how many words, pairs and triples each bucket holds, and some numbers. The arrays grow
    with the corpus and stay in the shared folder; this has five numbers for each bucket."""

    folder: str
    top: int
    order: int = ORDER
    sizes: dict[str, np.ndarray] = field(default_factory=dict)  #: of each kind of array by bucket
    stage: int = 0  #: how many kinds of arrays are there
    total: int = 0
    d: dict[str, np.ndarray] = field(default_factory=lambda: {name: np.zeros(4) for name in ("words", "pairs", "triples")})
    free_word: float = 1.0

    @property
    def buckets(self) -> int:
        return 1 << self.top

    def count(self, *names: str) -> int:
        return sum(int(self.sizes.get(name, _none()).sum()) for name in names)

    @property
    def kinds(self) -> int:
        return self.count("words")

    @property
    def pair_kinds(self) -> int:
        return self.count("pairs", "pairs-once")

    def start(self, name: str) -> np.ndarray:
        """The number of each bucket's first word or pair; the pairs that occur once come after the others."""
        first = self.count("pairs") if name == "pairs-once" else 0
        return first + np.concatenate([[0], np.cumsum(self.sizes[name])]).astype(np.int64)

    def keys(self, name: str) -> Keys:
        if name == "words":
            return Keys(32, 32, self.top)
        word = bits_of(self.kinds)
        out = Keys(max(self.top, word if name == "pairs" else bits_of(self.pair_kinds)), word, self.top)
        if out.left + out.right > 64:
            raise ValueError(f"keys of {name} need more than 64 bits; take a lower order")
        return out


class Mapped:
    """The arrays of a model in a worker, mapped when they are first asked for."""

    def __init__(self, model: Model):
        self.m, self.shelf = model, arrays.Shelf(model.folder)
        self.end = int(self.numbers(np.array([END]))[0][0])

    def _find(self, keys: np.ndarray, name: str, kind: Keys) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
        """For sorted keys: bucket, their slice, places in the bucket's array, and whether they are there."""
        edges = kind.edges(keys)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            if self.m.sizes[name][b]:
                part, table = slice(edges[b], edges[b + 1]), self.shelf[f"{name}-{b}"]
                asked = kind.within(keys[part])
                own = asked.astype(table.dtype)
                if table.dtype == np.uint32:
                    at, ends = _search(table, own, *self._pieces(name, b, asked, kind))
                else:
                    at, ends = np.searchsorted(table, own), len(table)
                there = at < ends
                at = np.minimum(at, len(table) - 1)
                yield b, part, at, there & (table[at] == own)

    def _pieces(self, name: str, b: int, asked: np.ndarray, kind: Keys) -> tuple[np.ndarray, np.ndarray]:
        """Where the keys begin and end that begin like those asked for."""
        begin = self.shelf[f"{name}-{b}-begin"]
        piece = (asked >> U(kind.low - bits_of(len(begin)) + 1)).astype(np.int64) if len(begin) > 2 else np.zeros(len(asked), np.int64)
        return begin[piece].astype(np.int64), begin[piece + 1].astype(np.int64)

    def _counted(self, keys: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts of sorted keys."""
        number, count, kind = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64), self.m.keys(name)
        for part_name in (name,) if name == "words" else (name, f"{name}-once"):
            start = self.m.start(part_name)
            left = np.flatnonzero(number < 0)
            for b, part, at, there in self._find(keys[left], part_name, kind):
                mine, at = left[part][there], at[there]
                number[mine] = start[b] + at
                count[mine] = 1 if part_name.endswith("-once") else self.shelf[f"{name}-counts-{b}"][at]
        return number, count

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts of sorted word hashes."""
        return self._counted(hashes, "words")

    def of_number(self, number: np.ndarray, name: str, wanted: dict[str, float]) -> list[np.ndarray]:
        """What the arrays say of numbers, in any order; the values given for numbers that no array holds (-1, pairs that occur once)."""
        start = self.m.start(name)
        order = np.argsort(number, kind="stable")
        edges = np.searchsorted(number[order], start)
        out = [np.full(len(number), other, np.float64) for other in wanted.values()]
        for b in np.flatnonzero(np.diff(edges)).tolist():
            part = order[edges[b] : edges[b + 1]]
            at = number[part] - start[b]
            for values, kind in zip(out, wanted, strict=True):
                values[part] = self.shelf[f"{kind}-{b}"][at]
        return out

    def tokens(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of all texts (-1: unknown), the numbers before them, their counts, and the bounds of texts."""
        h, bounds = tokens(column)
        unique, back = np.unique(h, return_inverse=True)
        known, count = self.numbers(unique)
        number = known[back]
        return number, _before(number, bounds, self.end), count[back], bounds

    def pairs(self, before: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts of pairs of word numbers."""
        return self._joined("pairs", before, number)

    def triples(self, pair: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Counts of triples: a pair's and a word's number, -1 where there is none."""
        return self._joined("triples", pair, number)[1]

    def _joined(self, name: str, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number, count = np.full(len(left), -1, np.int64), np.zeros(len(left), np.int64)
        known = np.flatnonzero((left >= 0) & (right >= 0))
        keys, back = np.unique(self.m.keys(name).join(left[known], right[known]), return_inverse=True)
        n, c = self._counted(keys, name)
        number[known], count[known] = n[back], c[back]
        return number, count

    def stored(self, name: str, b: int, at: np.ndarray | None = None) -> np.ndarray:
        """The keys of a bucket in order, or those at sorted places."""
        if not self.m.sizes[name][b]:
            return np.zeros(0, U)
        kind, table = self.m.keys(name.removesuffix("-once")), self.shelf[f"{name}-{b}"]
        at = np.arange(len(table)) if at is None else at
        out = table[at].astype(U)
        if table.dtype == np.uint32:
            begin = self.shelf[f"{name}-{b}-begin"]
            rest = kind.low - bits_of(len(begin)) + 1 if len(begin) > 2 else kind.low
            out = out & U((1 << rest) - 1) | (np.searchsorted(begin, at.astype(begin.dtype), "right") - 1).astype(U) << U(rest)
        return out | U(b << kind.low)

    def last_words(self, pair: np.ndarray) -> np.ndarray:
        """The second words of sorted pair numbers."""
        out, kind = np.zeros(len(pair), np.int64), self.m.keys("pairs")
        for name in ("pairs", "pairs-once"):
            start = self.m.start(name)
            edges = np.searchsorted(pair, start)
            for b in np.flatnonzero(np.diff(edges)).tolist():
                part = slice(edges[b], edges[b + 1])
                out[part] = kind.split(self.stored(name, b, pair[part] - start[b]))[1]
        return out


def _search(table: np.ndarray, asked: np.ndarray, lo: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each number asked for, its place among the sorted numbers of the table from lo up to an end, and that end."""
    hi = ends
    for _ in range(int((hi - lo).max(initial=0)).bit_length()):
        mid = (lo + hi) >> 1
        less = (table[np.minimum(mid, len(table) - 1)] < asked) & (lo < hi)
        lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
    return lo, ends


def _before(number: np.ndarray, bounds: np.ndarray, first: int) -> np.ndarray:
    """The number before each token; `first` before the first of a text."""
    out = np.empty_like(number)
    out[1:] = number[:-1]
    out[bounds[:-1]] = first
    return out


#: One mapped model for a Python worker.
_mapped: dict[str, Mapped] = {}


def mapped(model: Model) -> Mapped:
    name = f"{model.folder} {model.stage}"
    if name not in _mapped:
        _mapped.clear()
        _mapped[name] = Mapped(model)
    return _mapped[name]


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 10 == 0, F.lit(False))


TOLD = "to long, numbers binary, before binary, after binary, weight binary"


def _tell(start: np.ndarray, of_before: np.ndarray, of_after: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    """To each bucket of numbers: how often a number is in of_before; how often in of_after, with a count of 1, 2 or more, and the sum of these counts."""
    number, back = np.unique(np.concatenate([of_before, of_after]), return_inverse=True)
    mine = back[len(of_before) :]
    before = np.bincount(back[: len(of_before)], minlength=len(number)).astype(np.uint32)
    after = np.bincount(mine * 3 + np.minimum(count, 3) - 1, minlength=3 * len(number)).astype(np.uint32)
    weight = np.bincount(mine, count, len(number)).astype(U)
    edges = np.searchsorted(number, start)
    for to in np.flatnonzero(np.diff(edges)).tolist():
        part = slice(edges[to], edges[to + 1])
        row = [K.pack_sorted((number[part] - start[to]).astype(U)), K.planes(before[part]), K.planes(after[3 * edges[to] : 3 * edges[to + 1]]), K.planes(weight[part])]
        yield pa.RecordBatch.from_arrays([pa.array([to], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], ["to", "numbers", "before", "after", "weight"])


def _told(batches: Iterator[pa.RecordBatch], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    before, after, weight = np.zeros(n, np.int64), np.zeros((n, 3), np.int64), np.zeros(n, np.int64)
    for batch in batches:
        for at, x, y, z in zip(*(batch.column(c).to_pylist() for c in ("numbers", "before", "after", "weight")), strict=True):
            if at is not None:
                at = K.unpack_sorted(at).astype(np.int64)
                before[at] += K.unplanes(x, np.uint32)
                after[at] += K.unplanes(y, np.uint32).reshape(-1, 3)
                weight[at] += K.unplanes(z, U).astype(np.int64)
    return before, after, weight


def _ones(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4, and how many are more."""
    return [*(int((counts == k).sum()) for k in (1, 2, 3, 4)), int((counts > 4).sum())]


STATS = "bucket long, many long, once long, total long, ones array<long>"


def _stats(b: int, many: int, once: int, total: int, ones: list[int]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((b, many, once, total, ones), kinds, strict=True)], ["bucket", "many", "once", "total", "ones"])


def _count(docs: DataFrame, model: Model, name: str, keys_of: Callable[[Mapped, pa.ChunkedArray], np.ndarray]) -> None:
    """Counts keys of the texts and writes them under the name; the sizes go into the model."""
    spark, kind, folder = docs.sparkSession, model.keys(name), model.folder
    sent = spark.sparkContext.broadcast(model)

    def count(batches):
        m = mapped(sent.value) if name != "words" else None
        yield from _counting(K.chunks(batches, "text", PIECE), lambda column: keys_of(m, column), kind)

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = key[0].as_py()
        keys, counts = _merge(batches)
        many = counts > 1 if name != "words" else np.ones(len(keys), bool)
        _save_keys(folder, f"{name}-{b}", keys[many], kind.low)
        _save_keys(folder, f"{name}-once-{b}", keys[~many], kind.low)
        arrays.save(folder, f"{name}-counts-{b}", arrays.smallest(counts[many]))
        yield _stats(b, int(many.sum()), int((~many).sum()), int(counts.sum()), _ones(counts))

    rows = docs.mapInArrow(count, SENT).groupBy("bucket").applyInArrow(merge, STATS).collect()  # a row a bucket
    model.sizes[name], model.sizes[f"{name}-once"] = (np.zeros(model.buckets, np.int64) for _ in range(2))
    for r in rows:
        model.sizes[name][r["bucket"]], model.sizes[f"{name}-once"][r["bucket"]] = r["many"], r["once"]
    if name == "words":
        model.total = sum(r["total"] for r in rows)
    model.d[name] = discounts(np.sum([r["ones"] for r in rows], axis=0)) if rows else np.zeros(4)
    model.stage += 1
    release(spark)


def _tell_all(spark: SparkSession, model: Model, told: str, tell: Callable[[Mapped, int], Iterator[pa.RecordBatch]], hear: Callable[[Mapped, int, tuple], list[int]]) -> np.ndarray:
    """Each bucket tells the buckets of the words or pairs that it holds what it knows of them; these hear it and write it. Gives the sum of what they say."""
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        m = mapped(sent.value)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), *(pa.array([None], pa.binary()) for _ in range(4))], ["to", "numbers", "before", "after", "weight"])
                yield from tell(m, b)

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, b = mapped(sent.value), key[0].as_py()
        yield _stats(b, 0, 0, 0, hear(m, b, _told(batches, int(m.m.sizes[told][b]))))

    rows = spark.range(0, model.buckets, 1, model.buckets).mapInArrow(run, TOLD).groupBy("to").applyInArrow(merge, STATS).collect()  # a row a bucket
    model.stage += 1
    return np.sum([r["ones"] for r in rows], axis=0)


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Counts the texts of docs (doc_id, text) and gives a model of the order, 2 or 3."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    arrow(spark)
    docs = docs.select("text")
    model = Model(new_folder(spark, "kneser-ney"), min(TOP, bits_of(partitions(docs))), order)
    _count(docs, model, "words", lambda m, column: tokens(column)[0])
    if model.kinds >= 1 << 32:
        raise ValueError("more than 2 ** 32 distinct words")

    def pair_keys(m: Mapped, column: pa.ChunkedArray) -> np.ndarray:
        number, before, _, _ = m.tokens(column)
        return m.m.keys("pairs").join(before, number)

    _count(docs, model, "pairs", pair_keys)
    if order == 3:

        def triple_keys(m: Mapped, column: pa.ChunkedArray) -> np.ndarray:
            number, before, _, bounds = m.tokens(column)
            context = _before(m.pairs(before, number)[0], bounds, -1)
            there = context >= 0
            return m.m.keys("triples").join(context[there], number[there])

        _count(docs, model, "triples", triple_keys)

        def tell_pairs(m: Mapped, b: int) -> Iterator[pa.RecordBatch]:
            many, once = m.stored("triples", b), m.stored("triples-once", b)
            if len(many) + len(once):
                counts = m.shelf[f"triples-counts-{b}"] if len(many) else _none()
                pair, word = m.m.keys("triples").split(np.concatenate([many, once]))
                count = np.concatenate([counts.astype(np.int64), np.ones(len(once), np.int64)])
                unique, back = np.unique(pair, return_inverse=True)
                after, repeated = m.pairs(m.last_words(unique)[back], word)[0], m.m.count("pairs")  # of pairs that occur once all is known
                yield from _tell(m.m.start("pairs"), after[after < repeated], pair[pair < repeated], count[pair < repeated])

        def hear_pairs(m: Mapped, b: int, told: tuple) -> list[int]:
            if not m.m.sizes["pairs"][b]:
                return _ones(np.ones(m.m.sizes["pairs-once"][b]))
            before, after, _ = told
            counts = m.shelf[f"pairs-counts-{b}"]
            before = np.where(m.m.keys("pairs").split(m.stored("pairs", b))[0] == m.end, counts, before)
            arrays.save(m.m.folder, f"pairs-before-{b}", arrays.smallest(before))
            arrays.save(m.m.folder, f"pairs-free-{b}", ((after @ m.m.d["triples"][1:]) / counts).astype(np.float32))
            return (np.array(_ones(before)) + _ones(np.ones(m.m.sizes["pairs-once"][b]))).tolist()

        model.d["pairs"] = discounts(_tell_all(spark, model, "pairs", tell_pairs, hear_pairs))

    def tell_words(m: Mapped, b: int) -> Iterator[pa.RecordBatch]:
        many, once = m.stored("pairs", b), m.stored("pairs-once", b)
        if len(many) + len(once):
            counts = m.shelf[f"pairs-{'counts' if order == 2 else 'before'}-{b}"] if len(many) else _none()
            left, right = m.m.keys("pairs").split(np.concatenate([many, once]))
            yield from _tell(m.m.start("words"), right, left, np.concatenate([counts.astype(np.int64), np.ones(len(once), np.int64)]))

    def hear_words(m: Mapped, b: int, told: tuple) -> list[int]:
        before, after, weight = told
        arrays.save(m.m.folder, f"words-free-{b}", (after @ m.m.d["pairs"][1:]) / np.maximum(weight, 1))
        arrays.save(m.m.folder, f"words-before-{b}", arrays.smallest(before))
        arrays.save(m.m.folder, f"words-weight-{b}", arrays.smallest(weight))
        return _ones(before)

    ones = _tell_all(spark, model, "words", tell_words, hear_words)
    model.d["words"] = discounts(ones)
    if model.kinds:
        model.free_word = float(model.d["words"][1:] @ [ones[0], ones[1], ones[2:].sum()] / model.pair_kinds)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities), and
    perplexity by the model."""
    arrow(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def run(batches):
        m = mapped(sent.value)
        model = m.m

        def kept(count: np.ndarray, name: str) -> np.ndarray:
            return np.maximum(count - model.d[name][np.minimum(count, 3).astype(np.int64)], 0)

        for piece in K.chunks(batches, "text", PIECE):
            number, before, count, bounds = m.tokens(piece["text"])
            words, back = np.unique(number, return_inverse=True)
            free, weight, kinds = m.of_number(words, "words", {"words-free": 1, "words-weight": 1, "words-before": 0})
            low = (kept(kinds, "words") / max(1, model.pair_kinds) + model.free_word / (model.kinds + 1))[back]
            at = np.searchsorted(words, before)  # an end before a text is a word of the piece, as each text has its end
            pair, c = m.pairs(before, number)
            many = c
            if model.order == 3:
                pair_free, kinds = m.of_number(pair, "pairs", {"pairs-free": model.d["triples"][1], "pairs-before": 1})
                many = np.where(pair >= 0, kinds, 0)
            p = kept(many, "pairs") / np.maximum(weight[at], 1) + free[at] * low
            if model.order == 3:
                context, seen, left = (_before(x, bounds, other) for x, other in ((pair, -1), (c, 0), (pair_free, 1.0)))
                there = context >= 0
                p = np.where(there, kept(m.triples(context, number), "triples") / np.maximum(seen, 1) + left * p, p)
            base = np.log10((count + ADD) / (model.total + ADD * (model.kinds + 1)))
            rows = [np.diff(bounds), *(np.add.reduceat(x, bounds[:-1]) for x in ((count > 0).astype(np.int64), base, np.log10(p)))]
            yield pa.RecordBatch.from_arrays([piece["doc_id"].combine_chunks(), *map(pa.array, rows)], names)

    scored = texts(docs).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def score_all(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores every row of docs by a model of those that are not held out."""
    own = texts(docs)
    return score(docs, train(own.where("doc_id IS NOT NULL").where(~held_out()), order))
