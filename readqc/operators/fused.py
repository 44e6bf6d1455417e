"""One pass over reads that fills the histograms of all families at once.

A task goes through its Arrow batches in pieces of bounded size and counts each family with a few numpy passes over the flat bytes: the cube of (position, base,
quality), lengths, GC, mean qualities, adapters, tiles, k-mers, and 50-base keys. What it sends are tagged rows (file, family, numbers, counts); one exchange adds them
up. Where positions are grouped, they are mapped to the first position of their group as they are counted, so state and rows are bounded by the groups and not by the
longest read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readqc.functions import expr
from readqc.operators.cube import _BASES, _CODE, DENSE, _Counter, _flat
from readqc.operators.positions import step_of

CUBE, LENGTH, GC, QUALITY, ADAPTER, TILE, KMER, KEY = FAMILIES = range(8)
ROWS = "file_id int, family int, a long, b int, c int, key string, n long, s long"
_NAMES = ["file_id", "family", "a", "b", "c", "key", "n", "s"]
#: Bases of a piece; entries of tiles and of keys that are held before they are merged or sent.
PIECE, MERGE, KEYS = 2_000_000, 1_000_000, 200_000
#: Every how many reads tiles and k-mers are taken; bases of a k-mer and of a read in which they are looked for.
TILES, KMERS, K, KMER_BASES = 10, 50, 7, 500
#: Bases by which places of adapters are told apart first.
SEED = 5

_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32
_CLEAN = np.frombuffer(b"ACGTN", np.uint8)[_CODE]
_THREE = np.full(256, 5, np.uint16)
for _i, _b in enumerate(b"ACGTN"):
    _THREE[_b] = _THREE[ord(chr(_b).lower())] = _i
#: The digits of k-mers, A C T G; anything else counts as G.
_KMER = np.full(256, 3, np.int64)
for _i, _b in enumerate(b"ACT"):
    _KMER[_b] = _KMER[ord(chr(_b).lower())] = _i


class Adapters:
    """All adapters at once: places whose first SEED bases begin any of them, then the whole words of those few places."""

    def __init__(self, adapters: list[tuple[str, str]]):
        self.many = len(adapters)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        seqs = [s.upper().encode() for _, s in adapters]
        for size in sorted({len(s) for s in seqs if s}):
            words = sorted({s for s in seqs if len(s) == size})
            owners = [[i for i, s in enumerate(seqs) if s == w] for w in words]
            self.by_size[size] = np.array(words, f"S{size}"), np.array([len(x) for x in owners]), np.concatenate(owners)
        self.seed = min([SEED, *self.by_size])
        self.starts = np.zeros(8**self.seed, bool)
        for s in filter(None, seqs):
            self.starts[self._codes(np.frombuffer(s[: self.seed], np.uint8))] = True

    def _codes(self, data: np.ndarray) -> np.ndarray:
        three, n = _THREE[data], len(data) - self.seed + 1
        code = np.zeros(max(n, 0), np.uint16)
        for j in range(self.seed if n > 0 else 0):
            code <<= np.uint16(3)
            code |= three[j : j + n]
        return code

    def first(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(adapter, place from 1) of the first place of each adapter in each read that has it."""
        found = np.flatnonzero(self.starts[self._codes(data)])
        read = np.searchsorted(at, found, side="right") - 1
        room = at[read + 1] - found
        keys, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, (words, many, owners) in self.by_size.items():
            fits = room >= size
            p, r = found[fits], read[fits]
            text = np.ascontiguousarray(_UPPER[data[p[:, None] + np.arange(size)]]).view(f"S{size}").ravel() if len(p) else np.zeros(0, f"S{size}")
            word = np.minimum(np.searchsorted(words, text), len(words) - 1)
            hit = words[word] == text
            p, r, word = p[hit], r[hit], word[hit]
            # a word may be several adapters'
            each = np.repeat(np.arange(len(p)), many[word])
            within = np.arange(len(each)) - np.repeat(np.cumsum(many[word]) - many[word], many[word])
            owner = owners[(np.cumsum(many) - many)[word][each] + within]
            keys.append(r[each] * self.many + owner)
            places.append((p - at[r] + 1)[each])
        key, place = np.concatenate(keys), np.concatenate(places)
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
        one = np.append(True, key[1:] != key[:-1])[: len(key)]
        return key[one] % max(self.many, 1), place[one]


class _Sums:
    """Sums of integer keys: how many and how much."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.many = 0

    def add(self, keys: np.ndarray, value: np.ndarray) -> None:
        unique, back, n = np.unique(keys, return_inverse=True, return_counts=True)
        self.held.append((unique, n, np.bincount(back, value, len(unique)).astype(np.int64)))
        self.many += len(unique)
        if self.many > MERGE and len(self.held) > 1:
            self.held = [self.items()]
            self.many = len(self.held[0][0]) // 2

    def items(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, n, s = (np.concatenate([x[i] for x in self.held]) for i in range(3))
        unique, back = np.unique(keys, return_inverse=True)
        return unique, np.bincount(back, n, len(unique)).astype(np.int64), np.bincount(back, s, len(unique)).astype(np.int64)


def _rows(file_id: int, family: int, n: np.ndarray, a=None, b=None, c=None, key=None, s=None) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(n), 100_000):
        cut = lambda x, kind, lo=lo: pa.nulls(len(n[lo : lo + 100_000]), kind) if x is None else (x.slice(lo, 100_000) if isinstance(x, pa.Array) else pa.array(x[lo : lo + 100_000], kind))
        many = len(n[lo : lo + 100_000])
        fixed = [pa.repeat(pa.scalar(x, pa.int32()), many) for x in (file_id, family)]
        yield pa.RecordBatch.from_arrays([*fixed, cut(a, pa.int64()), cut(b, pa.int32()), cut(c, pa.int32()), cut(key, pa.string()), cut(n, pa.int64()), cut(s, pa.int64())], _NAMES)


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts data[start:end] of spans in order."""
    offsets = np.empty(2 * len(starts) + 1, np.int64)
    offsets[0], offsets[1::2], offsets[2::2] = 0, starts, ends
    every = pa.Array.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return every.take(pa.array(np.arange(1, 2 * len(starts), 2))).cast(pa.large_string()).cast(pa.string())


class _Places:
    """Counts of k-mers by place: as they come while they are few, then as an array that reaches to the last place met, 8 bytes for each of 4 ** K k-mers there; so
    bounded by KMER_BASES places, whatever the number of reads, and never sorted again."""

    def __init__(self):
        self.dense = np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys.astype(np.int32))
        self.held += len(keys)
        if self.held > MERGE:
            self._settle()

    def _settle(self) -> None:
        for keys in self.waiting:
            if (room := int(keys.max(initial=-1)) + 1) > len(self.dense):
                self.dense = np.concatenate([self.dense, np.zeros(-(-room // 4**K) * 4**K - len(self.dense), np.int64)])
            np.add.at(self.dense, keys, 1)
        self.waiting, self.held = [], 0

    def items(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(self.dense):
            yield np.unique(np.concatenate(self.waiting or [np.zeros(0, np.int32)]), return_counts=True)
            return
        self._settle()
        for lo in range(0, len(self.dense), 64 * 4**K):
            at = np.flatnonzero(self.dense[lo : lo + 64 * 4**K]) + lo
            yield at, self.dense[at]


class _File:
    """The counts of one file in one task."""

    def __init__(self, file_id: int, step: int, stride: int, field: int | None, wanted: frozenset[int], adapters: Adapters, every: tuple[int, int]):
        self.file_id, self.step, self.stride, self.field, self.wanted, self.adapters, self.every = file_id, step, stride, field, wanted, adapters, every
        self.counts = {CUBE: _Counter(DENSE * 640), LENGTH: _Counter(1 << 16), GC: _Counter(1 << 17), QUALITY: _Counter(256), ADAPTER: _Counter(1 << 16)}
        self.kmers = _Places()
        self.tiles = _Sums()
        self.keys: list[pa.Table] = []
        self.many = 0

    def _group(self, pos: np.ndarray) -> np.ndarray:
        return pos if self.step == 1 else np.where(pos < 9, pos, 9 + (pos - 9) // self.step)

    def _first(self, group: np.ndarray) -> np.ndarray:
        """The first position, from 1, of a group."""
        return group + 1 if self.step == 1 else np.where(group < 9, group + 1, 10 + (group - 9) * self.step)

    def add(self, piece: pa.Table) -> Iterator[pa.RecordBatch]:
        idx = piece.column("read_idx").to_numpy()
        seq, at = _flat(piece.column("seq").combine_chunks())
        size = np.diff(at)
        code = _CODE[seq]
        if LENGTH in self.wanted:
            self.counts[LENGTH].add(size)
        if GC in self.wanted and len(seq):
            upto = np.concatenate([[0], np.cumsum((code == 1) | (code == 2))])
            gc, n = (upto[at[1:]] - upto[at[:-1]])[size > 0], size[size > 0]
            self.counts[GC].add(np.minimum(n, expr.GC_CAP) * 256 + np.where(n < expr.GC_CAP, gc, expr.GC_CAP * gc // np.maximum(n, 1)))
        if self.wanted & {CUBE, QUALITY, TILE}:
            qual, qat = _flat(piece.column("qual").combine_chunks())
            qsize = np.diff(qat)
        if CUBE in self.wanted and len(seq):
            pos = np.arange(len(seq)) - np.repeat(at[:-1], size)
            q = np.zeros(len(seq), np.int64)
            has = np.repeat(qsize == size, size)  # a missing quality string is shorter
            q[has] = qual if has.all() and len(qual) == len(seq) else qual[np.repeat(qsize == size, qsize)]
            self.counts[CUBE].add((self._group(pos) * 5 + code) * 128 + q)
        if QUALITY in self.wanted and len(qual):
            upto = np.concatenate([[0], np.cumsum(qual, dtype=np.int64)])
            some = qsize > 0
            self.counts[QUALITY].add((upto[qat[1:]] - upto[qat[:-1]])[some] // qsize[some])
        if ADAPTER in self.wanted and len(seq):
            adapter, place = self.adapters.first(seq, at)
            self.counts[ADAPTER].add(place * self.adapters.many + adapter)
        if TILE in self.wanted and self.field is not None:
            self._tiles(piece, idx, qual, qat, qsize)
        if KMER in self.wanted:
            some = np.flatnonzero((idx % self.every[1] == 0) & (size >= K))
            if len(some):
                upto = np.minimum(size[some], KMER_BASES) - K + 1
                read = np.repeat(some, upto)
                pos = np.arange(len(read)) - np.repeat(np.cumsum(upto) - upto, upto)
                start, value = at[read] + pos, np.zeros(len(read), np.int64)
                for j in range(K):
                    value = value * 4 + _KMER[seq[start + j]]
                self.kmers.add((pos + 1) * 4**K + value)
        if KEY in self.wanted:
            some = np.flatnonzero((size > 0) & (idx % self.stride == 0))
            if len(some):
                keys = _strings(_CLEAN[seq], at[some], np.minimum(at[some] + expr.PREFIX, at[some + 1]))
                self.keys.append(pa.table({"key": keys, "n": pa.array(np.ones(len(some), np.int64))}))
                self.many += len(some)
                if self.many >= KEYS:
                    yield from self._send_keys()

    def _tiles(self, piece: pa.Table, idx: np.ndarray, qual: np.ndarray, qat: np.ndarray, qsize: np.ndarray) -> None:
        some = np.flatnonzero((idx % self.every[0] == 0) & (qsize > 0))
        if not len(some):
            return
        names = piece.column("name").combine_chunks().take(pa.array(some))
        digits = pc.struct_field(pc.extract_regex(names, rf"^(?:[^:]*:){{{self.field}}}(?P<tile>[0-9]+)"), 0)
        tile = digits.filter(pc.less_equal(pc.utf8_length(digits), 9))
        if tile.null_count or len(tile) < len(some):
            lacks = names.filter(pc.fill_null(pc.greater(pc.utf8_length(digits), 9), True))[0].as_py()
            raise ValueError(f"no tile in header {lacks}")
        tile, n = tile.cast(pa.int64()).to_numpy(), qsize[some]
        pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.tiles.add(np.repeat(tile, n) << 32 | self._group(pos), qual[np.repeat(qat[some], n) + pos])

    def _send_keys(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            table = pa.concat_tables(self.keys).group_by("key").aggregate([("n", "sum")])
            self.keys, self.many = [], 0
            yield from _rows(self.file_id, KEY, table.column("n_sum").to_numpy(), key=table.column("key").combine_chunks())

    def finish(self) -> Iterator[pa.RecordBatch]:
        yield from self._send_keys()
        for family, counter in self.counts.items():
            keys, n = counter.items()
            if family == CUBE:
                rest, q = np.divmod(keys, 128)
                group, base = np.divmod(rest, 5)
                yield from _rows(self.file_id, family, n, self._first(group), base.astype(np.int32), q.astype(np.int32))
            elif family in (GC, ADAPTER):
                a, b = np.divmod(keys, {GC: 256, ADAPTER: max(self.adapters.many, 1)}[family])
                yield from _rows(self.file_id, family, n, a, b.astype(np.int32))
            else:
                yield from _rows(self.file_id, family, n, keys)
        for keys, n in self.kmers.items():
            a, b = np.divmod(keys, 4**K)
            yield from _rows(self.file_id, KMER, n, a, b.astype(np.int32))
        if self.tiles.held:
            keys, n, s = self.tiles.items()
            yield from _rows(self.file_id, TILE, n, keys >> 32, self._first(keys & (2**32 - 1)).astype(np.int32), s=s)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Table]]:
    """The rows of a batch by file, in pieces of some PIECE bases."""
    table = pa.Table.from_batches([batch])
    files = table.column("file_id").to_numpy()
    for f in np.unique(files).tolist():
        own = table if (files == f).all() else table.filter(pa.array(files == f))
        upto = np.cumsum(pc.fill_null(pc.binary_length(own.column("seq")), 0).to_numpy().astype(np.int64))
        lo = 0
        while lo < own.num_rows:
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PIECE, side="right")))
            yield f, own.slice(lo, hi - lo)
            lo = hi


def profile(reads: DataFrame) -> DataFrame:
    """(file_id, n_reads, longest, tile_field) of each file, in a light pass: reads with bases, the longest of them, and where the header of the first read names
    the tile. Reads staged from files have their lengths as a column `bases`, so their bases are not read for it."""
    size = expr.size(reads)
    first = F.min_by("name", "read_idx")
    return reads.groupBy("file_id").agg(F.count(F.when(size > 0, 1)).alias("n_reads"), F.max(size).alias("longest"), first.alias("name")).select("file_id", "n_reads", "longest", expr.tile_field(F.col("name")).alias("tile_field"))


def settings(files: DataFrame, groups: bool = False, every: int | None = None) -> DataFrame:
    """(file_id, step, stride, tile_field) for `count`: the width of position groups, every how many reads one is a key, and the tile's place in headers."""
    from readqc.operators.duplicates import FULL

    step = step_of(F.col("longest")) if groups else F.lit(1)
    stride = F.lit(every) if every else F.when(F.col("n_reads") < FULL, 1).otherwise(1 + F.floor(F.col("n_reads") / FULL))
    return files.select("file_id", step.cast("long").alias("step"), stride.cast("long").alias("stride"), "tile_field")


def count(reads: DataFrame, known: DataFrame | None = None, families: Iterable[int] = FAMILIES, adapters: list[tuple[str, str]] = (), tiles: int = TILES, kmers: int = KMERS) -> DataFrame:
    """(file_id, family, a, b, c, key, n, s): the counts of the families asked for, by one scan and one exchange. known: a row a file, see `settings`; it meets
    the reads as Spark joins a table of its size. Without it there are no groups, no tiles, and every read is a key. For
    CUBE a is the position, b the base, c the quality character (0: none); LENGTH a; GC a and b are the bins; QUALITY a; ADAPTER a is the place, b the adapter; KMER
    a is the place, b the k-mer's number; TILE a is the tile, b the position, s the sum of characters; KEY key."""
    wanted, searched = frozenset(families), list(adapters)
    if wanted == {LENGTH, KMER}:  # lengths need no bases, and k-mers few reads
        blank = [F.lit(None).cast(k).alias(c) for c, k in (("b", "int"), ("c", "int"), ("key", "string"))]
        lengths = reads.groupBy("file_id", expr.size(reads).cast("long").alias("a")).agg(F.count("*").alias("n"))
        return count(reads, known, [KMER], kmers=kmers).unionByName(lengths.select("file_id", F.lit(LENGTH).alias("family"), "a", *blank, "n", F.lit(None).cast("long").alias("s")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, files = Adapters(searched), {}
        for batch in batches:
            for f, piece in _pieces(batch) if batch.num_rows else ():
                if f not in files:
                    step, stride, field = (piece.column(c)[0].as_py() for c in ("step", "stride", "tile_field"))
                    files[f] = _File(f, step, stride, field, wanted, matcher, (tiles, kmers))
                yield from files[f].add(piece)
        for own in files.values():
            yield from own.finish()

    # names are needed where a tile is taken, qualities where they are counted
    name = F.when((F.col("read_idx") % tiles == 0) & F.col("tile_field").isNotNull(), F.col("name")) if TILE in wanted else F.lit(None).cast("string")
    qual = F.col("qual") if wanted & {CUBE, QUALITY, TILE} else F.lit(None).cast("string")
    if known is None:
        reads = reads.withColumns({"step": F.lit(1), "stride": F.lit(1), "tile_field": F.lit(None).cast("int")})
    else:
        reads = reads.join(known, "file_id")
    seq = F.col("seq")
    if LENGTH not in wanted:
        reads = expr.some(reads)
    if wanted == {TILE}:  # what a sample alone needs
        reads, seq = reads.where((F.col("read_idx") % tiles == 0) & F.col("tile_field").isNotNull()), F.lit(None).cast("string")
    elif wanted == {KMER}:
        reads, seq = reads.where(F.col("read_idx") % kmers == 0), F.substring("seq", 1, KMER_BASES)
    rows = reads.select("file_id", "read_idx", "step", "stride", "tile_field", name.alias("name"), seq.alias("seq"), qual.alias("qual"))
    partial = rows.mapInArrow(run, ROWS)
    return partial.groupBy("file_id", "family", "a", "b", "c", "key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def part(counts: DataFrame, family: int) -> DataFrame:
    """A family of counts under the names that the modules on it use."""
    own = counts.where(F.col("family") == family)
    a, n = F.col("a").cast("int"), F.col("n")
    if family == CUBE:
        base = F.element_at(F.array(*map(F.lit, _BASES)), F.col("b") + 1)
        return own.select("file_id", a.alias("pos"), base.alias("base"), F.nullif("c", F.lit(0)).alias("q"), n)
    if family == TILE:
        return own.select("file_id", a.alias("tile"), F.col("b").alias("pos"), F.col("s").alias("qsum"), n)
    if family == KMER:
        digits = F.lpad(F.conv(F.col("b").cast("string"), 10, 4), K, "0")
        return own.select("file_id", a.alias("pos"), F.translate(digits, "0123", "ACTG").alias("kmer"), n)
    names = {LENGTH: {"length": a}, GC: {"len_bin": a, "gc_bin": F.col("b")}, QUALITY: {"q": a}, ADAPTER: {"adapter_id": F.col("b"), "pos": a}, KEY: {"seq": F.col("key")}}[family]
    return own.select("file_id", *(c.alias(x) for x, c in names.items()), n)
