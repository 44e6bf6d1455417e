"""Best-fit packing of tokenised documents by linear grouping.

One pass encodes the texts and writes a row per piece with its length; from then on only the histogram
of lengths (at most `capacity` numbers, whatever the corpus) decides. Large lengths are cut into groups
of equal cardinality and rounded up to the largest of their group; the few sizes that remain make a
cutting-stock programme, solved by column generation; its patterns are filled with the actual lengths,
and what is left goes, longest first, to the sequence with the smallest gap that holds it. The plan is a
bounded table of runs: the pieces of one length with ranks lo .. lo + n - 1 go to n consecutive sequences
at one offset. A piece's rank comes from counts by input partition, so that no sort and no group
meets in one task.

Nulls: a null text is an empty text, one piece that holds the closing id alone; a null key stays null.
Repeated rows are packed each. An empty table gives no rows. Ties: pieces of one length take their places by their rank, so which of them goes where is
up to the order of the rows read. Texts of any length are encoded whole, one beyond PIECE bytes by itself. Other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readqc.llm import textkernel as K
from readqc.llm.shared import arrow, texts, written
from readqc.llm.wordtable import WordTable

#: Tokens of a sequence; numbers of groups that are tried; a length over capacity / LARGE is large. With a
#: high LARGE more lengths are rounded up, with a low one more are left to fill gaps exactly.
CAPACITY, GROUPS, LARGE = 2048, (12, 24, 48, 96), (2, 4, 8)
#: Bytes of text whose new words are encoded together, and of which positions are held at once; words of a table.
STRETCH, PIECE, KNOWN = 12 << 20, 2 << 20, 400_000


#: Words that a tokenizer must encode alike alone and among others.
PROBE = ("the", "Word", "of", "a1b2", "it's", "--", "\u00e9t\u00e9", "(x)", "the", "\u4e2d\u6587", "3.14", ".")


@functools.cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark core is one thread
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    for gap in (" ", "\n", " \t"):
        apart = [i for word in PROBE for i in t.encode(word, add_special_tokens=False).ids]
        if t.encode(gap.join(PROBE), add_special_tokens=False).ids != apart:
            raise ValueError(f"{path} doesn't encode words apart from each other")
    return t


def word_encoder(path: str):
    """For WordTable: ids of words by the tokenizer file. Its rules never join text over white space and
    ignore case, so words may be encoded one by one and once each."""

    split = "\x01"  # a word of its own between words; words that hold it are encoded alone

    def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, at = data.tobytes(), offsets.tolist()
        token = _tokenizer(path)
        (mark,) = token.encode(split, add_special_tokens=False).ids
        every = [flat[a:b].decode() for a, b in zip(at, at[1:], strict=False)]
        plain = [split not in x for x in every]
        joined = [x if ok else "" for x, ok in zip(every, plain, strict=True)]
        ids: list[int] = []
        for i in range(0, len(joined), 25_600):
            lines = [f" {split} ".join(joined[j : j + 128]) for j in range(i, min(i + 25_600, len(joined)), 128)]
            for e in token.encode_batch_fast(lines, add_special_tokens=False):
                ids += e.ids
                ids.append(mark)
        out = np.array(ids, np.uint32)
        cut = np.flatnonzero(out == mark)
        lengths, out = np.diff(cut, prepend=-1) - 1, np.delete(out, cut)
        for i in np.flatnonzero(~np.array(plain, bool)).tolist():
            own = token.encode(every[i], add_special_tokens=False).ids
            out = np.insert(out, int(lengths[:i].sum()), np.array(own, np.uint32))
            lengths[i] = len(own)
        return out, np.concatenate([[0], np.cumsum(lengths)])

    return encode


def without_stops(w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents' bounds of the words, where a full stop or comma after a letter is a word of its own, as it
    is to the tokenizer: so one form of a word is encoded, not three."""
    if not len(w.starts):
        return w.starts, w.ends, w.bounds
    last, before = w.data[w.ends - 1], w.data[np.maximum(w.ends - 2, 0)]
    stop = ((last == ord(".")) | (last == ord(","))) & (before >= ord("a")) & (before <= ord("z")) & (w.ends - w.starts > 1)
    many = 1 + stop
    upto = np.cumsum(many)
    starts, ends = np.repeat(w.starts, many), np.repeat(w.ends, many)
    ends[upto[stop] - 2] -= 1
    starts[upto[stop] - 1] = ends[upto[stop] - 1] - 1
    return starts, ends, np.concatenate([[0], upto])[w.bounds]


#: One table for each file lives as long as the Python worker, so that tasks after the first find most words in it.
_tables: dict[str, WordTable] = {}


def document_ids(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, flat ids, offsets) for stretches of a partition; each document closes with `end`."""
    if path not in _tables or _tables[path].full:
        _tables[path] = WordTable(word_encoder(path), KNOWN)
    table = _tables[path]
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    size = 0

    def emit():
        table.encode_new()
        for keys, numbers, bounds in held:
            inner = np.concatenate([[0], np.cumsum(table.counts(numbers))])[bounds]
            ids = np.insert(table.ids_of(numbers), inner[1:], np.uint32(end))
            yield keys, ids, inner + np.arange(len(inner))

    for piece in K.chunks(batches, "text", PIECE):
        w = K.words(piece["text"])
        starts, ends, bounds = without_stops(w)
        held.append((piece["doc_id"].combine_chunks(), table.add(w.data, starts, ends), bounds))
        size += len(w.data)
        if size >= STRETCH:
            yield from emit()
            held, size = [], 0
            if table.full:
                table = _tables[path] = WordTable(word_encoder(path), KNOWN)
    yield from emit()


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, and part (input partition) and turn (rank among the
    pieces of its length in that partition)."""
    arrow(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for keys, ids, offsets in document_ids(batches, path, end):
            size = np.diff(offsets)
            n = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, size[doc] - start)
            data = memoryview(ids.astype("<u4")).cast("B")
            at = (offsets[doc] + start) * 4
            crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            turn = np.empty(len(doc), np.int64)
            turn[order] = np.arange(len(doc)) - np.searchsorted(length[order], length[order])
            turn += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(turn, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "turn"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, turn long")


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Patterns (how many of each size a sequence holds) and how often each is used: the linear programme of
    cutting stock, by column generation with a knapsack over whole tokens."""
    m = len(sizes)
    d = np.array(demand, float)
    columns = [np.where(np.arange(m) == i, capacity // s, 0).astype(float) for i, s in enumerate(sizes)]
    basis = np.array(columns).T
    use = np.linalg.solve(basis, d)
    for _ in range(40 * m):
        price = np.linalg.solve(basis.T, np.ones(m))
        worth = np.zeros(capacity + 1)
        took = np.zeros((m, capacity + 1), np.int16)
        for i, (s, y) in enumerate(zip(sizes, price, strict=True)):
            if y <= 1e-12:
                continue
            best, count = worth.copy(), np.zeros(capacity + 1, np.int16)
            for k in range(1, capacity // s + 1):
                with_k = worth[: capacity + 1 - k * s] + k * y
                better = with_k > best[k * s :] + 1e-12
                best[k * s :][better] = with_k[better]
                count[k * s :][better] = k
            worth, took[i] = best, count
        if worth[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(m), capacity
        for i in range(m - 1, -1, -1):
            column[i] = took[i, room]
            room -= int(column[i]) * sizes[i]
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        leaves = int(np.argmin(ratio))
        basis[:, leaves] = column
        use = np.maximum(np.linalg.solve(basis, d), 0)
    return [(basis[:, i].astype(int), float(use[i])) for i in range(m)]


@dataclass
class Plan:
    """Runs: pieces of `length` with ranks rank .. rank + n - 1 go to sequences first .. first + n - 1 at offset."""

    capacity: int
    rest: dict[int, int]
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    gaps: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # gap -> ranges of sequences
    order: list[int] = field(default_factory=list)  # gaps, ascending
    used: dict[int, int] = field(default_factory=dict)

    def put(self, length: int, n: int, first: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.runs.append((length, rank, n, first, offset))
        self.used[length] = rank + n
        self.rest[length] -= n

    def open(self, first: int, n: int, gap: int) -> None:
        if n and gap:
            if gap not in self.gaps:
                bisect.insort(self.order, gap)
            self.gaps.setdefault(gap, []).append((first, n))

    def fill(self, first: int, n: int, gap: int, length: int, k: int) -> None:
        """k pieces of length to each of n sequences with that gap."""
        for i in range(k):
            self.put(length, n, first, self.capacity - gap + i * length)
        self.open(first, n, gap - k * length)

    def best_fit(self, length: int) -> None:
        while left := self.rest[length]:
            i = bisect.bisect_left(self.order, length)
            if i == len(self.order):
                k = self.capacity // length
                whole, more = divmod(left, k)
                first, self.sequences = self.sequences, self.sequences + whole + (more > 0)
                if whole:
                    self.fill(first, whole, self.capacity, length, k)
                if more:
                    self.fill(first + whole, 1, self.capacity, length, more)
                continue
            gap = self.order[i]
            first, n = self.gaps[gap].pop()
            if not self.gaps[gap]:
                del self.gaps[gap]
                self.order.pop(i)
            k = gap // length
            whole = min(n, left // k)
            if whole:
                self.fill(first, whole, gap, length, k)
            more = left - whole * k
            if whole < n and 0 < more < k:
                self.fill(first + whole, 1, gap, length, more)
                whole += 1
            self.open(first + whole, n - whole, gap)


def _grouped(lengths: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Lengths, largest first, in groups of equal cardinality: [length, count] each."""
    total = sum(lengths.values())
    size = -(-total // groups)
    out: list[list[list[int]]] = [[]]
    room = size
    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            if not room:
                out.append([])
                room = size
            n = min(room, left)
            out[-1].append([length, n])
            room -= n
            left -= n
    return [g for g in out if g]


def plan_of(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 24, large: int = 4) -> Plan:
    """The runs of a histogram of lengths (1 .. capacity)."""
    plan = Plan(capacity, dict(histogram))
    if full := histogram.get(capacity, 0):
        plan.put(capacity, full, 0, 0)
        plan.sequences = full
    big = {x: n for x, n in histogram.items() if n and capacity > x > capacity // large}
    if big:
        grouped = _grouped(big, groups)
        sizes = [g[0][0] for g in grouped]
        merged: dict[int, int] = {}  # two groups may round up to one size
        for s, g in zip(sizes, grouped, strict=True):
            merged[s] = merged.get(s, 0) + sum(n for _, n in g)
        kinds = sorted(merged, reverse=True)
        stock = {s: [x for t, g in zip(sizes, grouped, strict=True) if t == s for x in g] for s in kinds}
        for pattern, times in sorted(configurations(kinds, [merged[s] for s in kinds], capacity), key=lambda x: -x[1]):
            n = int(times + 1e-9)
            n = min([n, *(sum(c for _, c in stock[s]) // a for s, a in zip(kinds, pattern.tolist(), strict=True) if a)])
            if n <= 0 or not pattern.any():
                continue
            first, plan.sequences = plan.sequences, plan.sequences + n
            parts = [(first, n, 0)]  # first sequence, how many, tokens used
            for s, a in zip(kinds, pattern.tolist(), strict=True):
                for _ in range(a):
                    new = []
                    for at, count, used in parts:
                        while count:
                            length, have = stock[s][0]
                            k = min(have, count)
                            plan.put(length, k, at, used)
                            new.append((at, k, used + length))
                            at, count = at + k, count - k
                            stock[s][0][1] -= k
                            if not stock[s][0][1]:
                                stock[s].pop(0)
                    parts = new
            for at, count, used in parts:
                plan.open(at, count, capacity - used)
    for length in sorted((x for x, n in plan.rest.items() if n), reverse=True):
        plan.best_fit(length)
    return plan


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan with the fewest sequences among those tried, or the first that meets the lower bound."""
    least = -(-sum(x * n for x, n in histogram.items()) // capacity)
    best = None
    for large in LARGE:
        for groups in GROUPS:
            plan = plan_of(histogram, capacity, groups, large)
            if best is None or plan.sequences < best.sequences:
                best = plan
            if best.sequences <= least:
                return best
    return best


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """Pieces of all documents with sequence_id and offset; the offsets of a sequence are gapless from 0."""
    cut = written(pieces(docs, path, capacity, end), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = written(counts, "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_plan(histogram, capacity)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(runs)
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.join(counts.select("part", "length", earlier.alias("earlier")), ["part", "length"])
    wanted = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def place(batches):
        runs = shared.value
        key = runs[:, 0] << 44 | runs[:, 1]
        for batch in batches:
            rank = batch.column(5).to_numpy()
            row = runs[np.searchsorted(key, batch.column(3).to_numpy() << 44 | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], [*wanted, "sequence_id", "offset"])

    return ranked.select(*wanted, (F.col("turn") + F.col("earlier")).alias("rank")).mapInArrow(place, f"{kinds}, sequence_id long, offset long")
