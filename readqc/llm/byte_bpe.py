"""Byte-level BPE by corpus-level merge replay.

The distinct pre-tokens of the corpus meet by an exchange, in buckets of their hashes. A bucket's words form one array of symbols with links
to their neighbours. An inverted index holds, for each rank, the positions of the pairs that merge to it. Ranks
are taken in order; a merge touches only its positions and their neighbours, whose new pairs enter the
index. So each word of the corpus is worked out once. The words with their ids go to the shared folder as sorted arrays, which workers map into
memory and look the words of a stretch of text up in, comparing bytes. The text itself never shuffles, and a frequent word is one row a task.

Nulls: a null text is an empty text and has no ids; a null key stays null. Repeated rows and ties
give a row each. An empty table gives no rows. Texts of any length are encoded whole, one beyond PIECE bytes by itself. Other columns
of the input are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from readqc.llm import arrays
from readqc.llm import textkernel as K
from readqc.llm.shared import arrow, new_folder, partitions, texts
from readqc.llm.wordtable import WordTable, ranges

#: Bytes of text whose new words are encoded together, and of which positions are held at once.
STRETCH, PIECE = 24 << 20, 3 << 20
#: Buckets of the corpus's words at most: words are far fewer than text, so that a bucket of so many stays within a task's memory.
BUCKETS = 4096
_LETTER, _NUMBER, _BLANK, _OTHER = 1, 2, 3, 0
NONE = np.int32(2**31 - 1)


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            # a run may step over the gap of the surrogates, which no text holds
            out[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = kind
    return out


def pretokens(text: K.Flat) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pre-tokens of each text and each document's range of them; they tile the texts.

    The same cuts as the pattern of public_tokenizers.PATTERN: contractions, a run of letters, of numbers or
    of others with one blank before it, or white space, of which the last before a word stays apart.
    """
    data, n = text.data, len(text.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(text.docs + 1, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    kind = _classes()[:256][lead]
    if len(wide := np.flatnonzero(lead >= 0x80)):
        padded = np.concatenate([data, np.zeros(4, np.uint8)])
        b = [padded[at[wide] + i].astype(np.int32) & 0x3F for i in range(4)]
        head = lead[wide].astype(np.int32)
        two, three = ((head & 0x1F) << 6) | b[1], ((head & 0x0F) << 12) | (b[1] << 6) | b[2]
        four = ((head & 0x07) << 18) | (b[1] << 12) | (b[2] << 6) | b[3]
        kind[wide] = _classes()[np.where(head < 0xE0, two, np.where(head < 0xF0, three, four))]
    chars = len(at)
    begin = np.searchsorted(at, text.offsets)  # each document's first character
    edge = np.zeros(chars + 1, bool)
    edge[begin] = True
    change = edge[:chars].copy()
    change[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(change)
    stop = np.append(run[1:], chars)
    blank = kind[run] == _BLANK
    last = edge[stop]  # the run ends its document
    start = np.zeros(chars + 1, bool)
    start[run[blank]] = True
    start[stop[blank & ~last & (stop - run > 1)] - 1] = True
    spaced = np.zeros(len(run), bool)  # a blank U+0020 before it, in the same document
    spaced[1:] = (lead[run[1:] - 1] == 0x20) & ~edge[run[1:]]
    start[run[~blank & ~spaced]] = True
    quote = np.flatnonzero((lead[run[:-1]] == 0x27) & (stop[:-1] - run[:-1] == 1) & ~spaced[:-1] & ~last[:-1] & (kind[run[1:]] == _LETTER)) if len(run) > 1 else np.zeros(0, np.int64)
    if len(quote):
        more = np.append(lead, [0, 0])
        c, d, size = more[run[quote + 1]], more[run[quote + 1] + 1], (stop - run)[quote + 1]
        two = (size >= 2) & (((c == ord("r")) & (d == ord("e"))) | ((c == ord("v")) & (d == ord("e"))) | ((c == ord("l")) & (d == ord("l"))))
        one = np.isin(c, np.frombuffer(b"stmd", np.uint8))
        taken = np.where(one, 1, np.where(two, 2, 0))
        letters = run[quote + 1]
        hit = taken > 0
        start[letters[hit]] = False
        start[(letters + taken)[hit & (size > taken)]] = True
    first = np.flatnonzero(start[:chars])
    return at[first], np.searchsorted(first, begin)


class Ranks:
    """A vocabulary of byte strings by rank; every split of a token into two tokens is a mergeable pair."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.rank[t[:i]] << 32 | self.rank[t[i:]], r) for t, r in self.rank.items() for i in range(1, len(t)) if t[:i] in self.rank and t[i:] in self.rank]
        keys, to = np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int32)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]
        size = max(self.rank.values()) + 1
        tokens = [b""] * size
        for t, r in self.rank.items():
            tokens[r] = t
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank that each pair merges to, or NONE."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], NONE)

    def one(self, word: bytes) -> list[int]:
        """One word by the definition: a token as it is; else the lowest rank first, the leftmost of equals."""
        if word in self.rank:
            return [self.rank[word]]
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            ranked = [(self.rank.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            r, i = min(ranked, default=(NONE, 0))
            if r == NONE:
                return [self.rank[p] for p in parts]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ranges(self.start[ids], self.length[ids])]

    def replay(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word data[offsets[i]:offsets[i + 1]] and their offsets: every merge in rank order over all
        words at once."""
        n = len(data)
        symbol = self.byte[data]
        after = np.arange(1, n + 1, dtype=np.int32)
        after[offsets[1:][np.diff(offsets) > 0] - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[offsets[:-1][np.diff(offsets) > 0]] = -1
        alive = np.ones(n, bool)
        rank = np.full(n, NONE, np.int32)  # of the pair that starts here
        paired = np.flatnonzero(after >= 0)
        rank[paired] = self.merged(symbol[paired], symbol[after[paired]])
        pending: dict[int, list[np.ndarray]] = {}

        def index(at: np.ndarray, ranks: np.ndarray) -> None:
            if len(at) == 1:
                pending.setdefault(r := int(ranks[0]), []).append(at)
                if len(pending[r]) == 1:
                    heapq.heappush(heap, r)
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            edges = [0, *cut.tolist(), len(at)]
            for r, i, j in zip(ranks[edges[:-1]].tolist(), edges, edges[1:], strict=False):
                if r in pending:
                    pending[r].append(at[i:j])
                else:
                    pending[r] = [at[i:j]]
                    heapq.heappush(heap, r)

        heap: list[int] = []
        can = np.flatnonzero(rank != NONE)
        if len(can):
            index(can, rank[can])
        odd: list[np.ndarray] = []
        while heap:
            r = heapq.heappop(heap)
            held = pending.pop(r)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[(rank[at] == r) & alive[at]]
            if not len(at):
                continue
            if len(at) > 1:
                clash = after[at[:-1]] == at[1:]
                if clash.any():  # a chain of overlapping pairs: the first, the third and so on
                    k = np.arange(len(at))
                    opens = np.maximum.accumulate(np.where(np.append(True, ~clash), k, 0))
                    at = at[(k - opens) % 2 == 0]
            right = after[at]
            beyond = after[right]
            symbol[at] = r
            alive[right] = False
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            left = before[at]
            touched = np.concatenate([at, left[left >= 0]])
            if len(touched) > 2:
                touched = np.unique(touched)
            follow = after[touched]
            new = np.where(follow >= 0, self.merged(symbol[touched], symbol[follow]), NONE)
            rank[touched] = new
            if len(can := np.flatnonzero(new != NONE)):
                index(touched[can], new[can])
                if (new[can] < r).any():
                    odd.append(touched[can][new[can] < r])
        kept = np.flatnonzero(alive)
        bounds = np.searchsorted(kept, offsets)
        ids = symbol[kept]
        # a merge made a pair of lower rank: within such a word order matters, so it is done by the definition
        again = set((np.searchsorted(offsets, np.concatenate(odd), side="right") - 1).tolist()) if odd else set()
        # a word that is a token stays whole, also where its merges lead elsewhere
        flat, size = data.tobytes(), np.diff(offsets)
        again |= {w for w in np.flatnonzero((np.diff(bounds) > 1) & (size <= self.length.max())).tolist() if flat[offsets[w] : offsets[w + 1]] in self.rank}
        if again:
            parts, lengths = np.split(ids, bounds[1:-1]), np.diff(bounds)
            for w in again:
                parts[w] = np.array(self.one(flat[offsets[w] : offsets[w + 1]]), np.int32)
                lengths[w] = len(parts[w])
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)])
        return ids, bounds


@functools.cache
def ranks(path: str) -> Ranks:
    return Ranks(path)


def cut(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a batch of texts, starts and ends of their pre-tokens, and each document's range of them."""
    text = K.flat(column)
    starts, bounds = pretokens(text)
    return text.data, starts, np.append(starts[1:], len(text.data)).astype(np.int64)[: len(starts)], bounds


@dataclass
class Vocabulary:
    """The pre-tokens of a corpus with their ids: for each bucket of their hashes sorted hashes, ends of words and of ids, bytes and ids. The arrays
    lie in the shared folder; this is where."""

    folder: str
    buckets: int
    path: str

    def bucket_of(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)


class Lookup:
    """A vocabulary in a worker."""

    def __init__(self, words: Vocabulary):
        self.words, self.shelf, self.book = words, arrays.Shelf(words.folder), ranks(words.path)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word and their offsets: taken from the vocabulary, where words are compared byte by byte. What is not there, as a word that
        shares its hash with another, is worked out here."""
        n = len(offsets) - 1
        h = K.span_hash(data, offsets[:-1], offsets[1:])
        order = np.argsort(h)
        edges = np.searchsorted(self.words.bucket_of(h[order]), np.arange(self.words.buckets + 1))
        length, parts, where = np.zeros(n, np.int64), [np.zeros(0, np.int32)], np.zeros(n, np.int64)
        done, missing = 0, []
        for b in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[b] : edges[b + 1]]
            known, ends, flat, last, ids = (self.shelf[f"{kind}-{b}"] for kind in ("hashes", "ends", "bytes", "last", "ids"))
            at = np.minimum(np.searchsorted(known, h[own]), max(len(known) - 1, 0))
            there = known[at] == h[own] if len(known) else np.zeros(len(own), bool)
            there[there] = K.same_spans(data, offsets[own[there]], offsets[own[there] + 1], flat, ends[at[there]], ends[at[there] + 1])
            missing.append(own[~there])
            own, at = own[there], at[there]
            size = last[at + 1] - last[at]
            parts.append(ids[ranges(last[at], size)])
            length[own], where[own] = size, done + np.cumsum(size) - size
            done += int(size.sum())
        if len(left := np.concatenate(missing) if missing else np.zeros(0, np.int64)):
            size = offsets[left + 1] - offsets[left]
            ids, bounds = self.book.replay(data[ranges(offsets[left], size)], np.concatenate([[0], np.cumsum(size)]))
            parts.append(ids)
            length[left], where[left] = np.diff(bounds), done + bounds[:-1]
        return np.concatenate(parts)[ranges(where, length)], np.concatenate([[0], np.cumsum(length)])


def vocabulary(docs: DataFrame, path: str) -> Vocabulary:
    """Gathers the distinct pre-tokens of all texts by an exchange of their hashes, and replays the merges over all of them, a bucket at a time."""
    out = Vocabulary(new_folder(docs.sparkSession, "pretokens"), min(BUCKETS, partitions(docs)), path)

    def gather(batches):
        table = WordTable(lambda data, offsets: (np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)))

        def sent():
            data, ends = np.frombuffer(bytes(table.bytes), np.uint8), np.frombuffer(table.ends, np.int64)
            starts = np.append(0, ends[:-1])[: len(ends)]
            bucket = out.bucket_of(K.span_hash(data, starts, ends)) if len(ends) else np.zeros(0, np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(out.buckets + 1))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[b] : edges[b + 1]]
                size = ends[own] - starts[own]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([data[ranges(starts[own], size)].tobytes()], pa.binary()), pa.array([size.tobytes()], pa.binary())], ["bucket", "words", "sizes"])

        for piece in K.chunks(batches, "text", PIECE):
            data, starts, ends, _ = cut(piece["text"])
            table.add(data, starts, ends)
            if table.full:
                yield from sent()
                table = WordTable(table.encode)
        yield from sent()

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, book = key[0].as_py(), ranks(path)
        table = WordTable(book.replay)
        for batch in batches:
            for words, sizes in zip(batch.column("words").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                ends = np.cumsum(np.frombuffer(sizes, np.int64))
                table.add(np.frombuffer(words, np.uint8), np.append(0, ends[:-1]), ends)
        table.encode_new()
        data, ends = np.frombuffer(bytes(table.bytes), np.uint8), np.frombuffer(table.ends, np.int64)
        starts = np.append(0, ends[:-1])
        hashes = K.span_hash(data, starts, ends)
        _, order = np.unique(hashes, return_index=True)  # of words that share a hash, one
        size = ends[order] - starts[order]
        numbers = order.astype(np.int32)
        values = {"hashes": hashes[order], "ends": np.concatenate([[0], np.cumsum(size)]), "bytes": data[ranges(starts[order], size)], "last": np.concatenate([[0], np.cumsum(table.counts(numbers))]), "ids": table.ids_of(numbers).astype(np.int32)}
        for kind, value in values.items():
            arrays.save(out.folder, f"{kind}-{b}", value)
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([len(order)], pa.int64())], ["bucket", "n"])

    rows = texts(docs).select("text").mapInArrow(gather, "bucket long, words binary, sizes binary").groupBy("bucket").applyInArrow(merge, "bucket long, n long").collect()  # a row a bucket
    full = {r["bucket"] for r in rows}
    for b in range(out.buckets):
        if b not in full:  # buckets without a word are files too, so that a file that is missing is an error
            for kind, value in {"hashes": np.zeros(0, np.uint64), "ends": np.zeros(1, np.int64), "bytes": np.zeros(0, np.uint8), "last": np.zeros(1, np.int64), "ids": np.zeros(0, np.int32)}.items():
                arrays.save(out.folder, f"{kind}-{b}", value)
    return out


#: One table for a vocabulary lives as long as the Python worker, so that tasks after the first find most words in it.
_tables: dict[str, WordTable] = {}


def _table(words: Vocabulary) -> WordTable:
    if words.folder not in _tables or _tables[words.folder].full:
        _tables.clear()
        _tables[words.folder] = WordTable(Lookup(words))
    return _tables[words.folder]


def encoded(batches: Iterator[pa.RecordBatch], words: Vocabulary) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """(doc_ids, ids of each document) for stretches of a partition."""
    table = _table(words)
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    size = 0

    def emit():
        table.encode_new()
        for keys, numbers, bounds in held:
            ends = np.concatenate([[0], np.cumsum(table.counts(numbers))])[bounds]
            yield keys, np.split(table.ids_of(numbers), ends[1:-1])

    for piece in K.chunks(batches, "text", PIECE):
        data, starts, ends, bounds = cut(piece["text"])
        held.append((piece["doc_id"], table.add(data, starts, ends), bounds))
        size += len(data)
        if size >= STRETCH:
            yield from emit()
            held, size = [], 0
            table = _table(words)
    yield from emit()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every text of docs."""
    arrow(docs.sparkSession)
    words = vocabulary(docs, path)

    def run(batches):
        for keys, ids in encoded(batches, words):
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            ends = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([keys.combine_chunks(), lists], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, data binary) of (doc_id, ids)."""

    def run(batches):
        book = ranks(path)
        for batch in batches:
            data = [None if x is None else book.decode(np.array(x, np.int64)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of ids, their SHA-256 (little-endian unsigned 32-bit) and that of the bytes that they
    decode to."""
    arrow(docs.sparkSession)
    words = vocabulary(docs, path)

    def run(batches):
        book = ranks(path)
        for keys, ids in encoded(batches, words):
            rows = [(len(x), hashlib.sha256(x.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(book.decode(x).tobytes()).hexdigest()) for x in ids]
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([keys.combine_chunks(), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
