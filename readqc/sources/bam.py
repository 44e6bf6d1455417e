"""BAM as a Spark data source, split by bytes: a split owns the records that start in its blocks, and finds the first of them by what a record looks
like, several in a row. Reads of the reverse strand are turned back; absent qualities are null.

Records are decoded by the piece: where they start is a chain of sizes, all else are numpy passes over flat bytes. Numbers are gathered from the
records' fixed places; names, bases and qualities are spans, each base a half byte that a table turns into a letter; a span of the reverse strand is gathered from its
end and through the table of complements.
"""

from __future__ import annotations

import collections
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader

from readqc.sources import bgzf, store
from readqc.sources.fastq import BATCH, COLUMNS, KINDS, SPLIT, Split

#: Fixed value: bases by their four-bit codes.
CODES = b"=ACMGRSVTWYHKDBN"
_LETTER = np.frombuffer(CODES, np.uint8)
#: The complement; whatever is no base becomes N.
_COMPLEMENT = np.array([{65: 84, 67: 71, 71: 67, 84: 65}.get(b, 78) for b in CODES], np.uint8)
#: Bytes that are decoded together.
PIECE = 1 << 22


class _Stream:
    """Inflated blocks as one stream, which knows in which block a place lies."""

    def __init__(self, blocks: Iterator[tuple[int, bytes]]):
        self.blocks, self.data, self.at, self.before = blocks, b"", 0, 0
        self.starts: collections.deque[tuple[int, int]] = collections.deque()  # place in the stream, address of the block

    def more(self) -> bool:
        """One block more is at hand; False at the end of the file."""
        got = next(self.blocks, None)
        if got is None:
            return False
        if got[1]:
            self.starts.append((self.before + len(self.data), got[0]))
            self.data += got[1]
        return True

    def has(self, n: int) -> bool:
        if len(self.data) - self.at < n:
            self.before += self.at
            parts, have = [self.data[self.at :]], len(self.data) - self.at
            while have < n and (got := next(self.blocks, None)) is not None:
                if got[1]:
                    self.starts.append((self.before + have, got[0]))
                parts.append(got[1])
                have += len(got[1])
            self.data, self.at = b"".join(parts), 0
        return len(self.data) - self.at >= n

    def take(self, n: int) -> bytes | None:
        """The next n bytes; None at the end, where none are left."""
        if not self.has(n):
            if self.at == len(self.data) and n:
                return None
            raise ValueError("the file ends inside a record")
        self.at += n
        return self.data[self.at - n : self.at]

    def address(self) -> int | None:
        """Of the block that the next byte lies in; None at the end."""
        if not self.has(1):
            return None
        while len(self.starts) > 1 and self.starts[1][0] <= self.before + self.at:
            self.starts.popleft()
        return self.starts[0][1]


def pieces(s: _Stream, end: int) -> Iterator[tuple[bytes, list[int]]]:
    """Bytes of some PIECE and where in them the records begin that start in blocks before `end`."""
    while True:
        s.has(PIECE)
        if (address := s.address()) is None or address >= end:
            return
        # the first byte of a block from `end` on ends the split
        stop = next((place - s.before for place, block in s.starts if block >= end), len(s.data))
        begin, after = starts(s.data, s.at, stop)
        if not begin:  # a record longer than what is at hand
            if not s.has(len(s.data) - s.at + PIECE) and len(s.data) - s.at < 4 + (struct.unpack_from("<i", s.data, s.at)[0] if s.has(4) else 0):
                raise ValueError("the file ends inside a record")
            continue
        yield s.data, begin
        s.at = after


def _head(s: _Stream) -> int:
    """Goes past the header; the number of references."""
    if s.take(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    s.take(struct.unpack("<i", s.take(4))[0])
    n = struct.unpack("<i", s.take(4))[0]
    for _ in range(n):
        s.take(struct.unpack("<i", s.take(4))[0] + 4)
    return n


#: Records in a row that must look like records where one is looked for inside a file; bytes of a record at most there.
CHAIN, LARGEST = 8, 1 << 28


def _record_size(data: bytes, at: int, references: int) -> int | None:
    """The length of what may be a record there, with its length field; 0 if too little is at hand to tell; None if it is none."""
    if len(data) - at < 36:
        return 0
    size, ref, pos, name, _, _, cigar, _, length, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (-1 <= ref < references and -1 <= next_ref < references and pos >= -1 and next_pos >= -1 and name and length >= 0):
        return None
    if not 32 + name + 4 * cigar + (length + 1) // 2 + length <= size <= LARGEST:
        return None
    if len(data) - at < 36 + name:
        return 0
    text = data[at + 36 : at + 36 + name]
    if text[-1] or not all(33 <= c <= 126 for c in text[:-1]):
        return None
    return size + 4


def _find(s: _Stream, references: int) -> bool:
    """Goes to the first record that starts in the stream, told by CHAIN records in a row or as many as are left; False if there is none."""
    at = 0
    while True:
        if at >= len(s.data) and not s.more():
            return False
        place, chain = at, 0
        while chain < CHAIN:
            size = _record_size(s.data, place, references)
            if size is None:
                break
            if not size or place + size > len(s.data):
                if s.more():
                    continue
                if place != len(s.data):  # the last one must end with the file
                    chain = -1
                break
            place, chain = place + size, chain + 1
        if chain >= CHAIN or (chain > 0 and place == len(s.data)):
            s.at = at
            return True
        at += 1


def starts(data: bytes, at: int, stop: int) -> tuple[list[int], int]:
    """Where the records begin that begin before `stop` and are whole, and where the next one would: each size tells the next start."""
    out, n, size_at = [], len(data), struct.Struct("<i").unpack_from
    while at < stop and at + 4 <= n:
        end = at + 4 + size_at(data, at)[0]
        if end > n:
            break
        if end < at + 36:
            raise ValueError("a record is shorter than its fixed part")
        out.append(at)
        at = end
    return out, at


def _gather(starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For spans one after the other: offsets, which span each element is of, and its place in it."""
    offsets = np.concatenate([[0], np.cumsum(size)])
    row = np.repeat(np.arange(len(size)), size)
    return offsets, row, np.arange(offsets[-1]) - offsets[row]


def _strings(offsets: np.ndarray, values: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    mask = None
    if missing is not None and missing.any():
        mask = pa.py_buffer(np.packbits(~missing, bitorder="little").tobytes())
    made = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [mask, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))])
    return made.cast(pa.string())


def decoded(data: bytes, begin: list[int]) -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray]:
    """Names, bases, qualities, and numbers of bases, of the records that begin there."""
    flat, at = np.frombuffer(data, np.uint8), np.array(begin, np.int64) + 4
    number = lambda place, width: (flat[at[:, None] + place + np.arange(width)].astype(np.int64) << (8 * np.arange(width))).sum(1)
    name, cigar, flag, size = number(8, 1), number(12, 2), number(14, 2), number(16, 4)
    seq_at = at + 32 + name + 4 * cigar
    qual_at = seq_at + (size + 1) // 2
    ends = at - 4 + 4 + number(-4, 4)
    if (name < 1).any() or (size >= 1 << 31).any() or (qual_at + size > ends).any():
        raise ValueError("a record's parts are longer than it")
    turned = (flag & 16) != 0
    offsets, row, k = _gather(at + 32, name - 1)
    names = _strings(offsets, flat[(at + 32)[row] + k])
    offsets, row, k = _gather(seq_at, size)
    k = np.where(turned[row], size[row] - 1 - k, k)  # from the end where the strand is the other one
    pair = flat[seq_at[row] + (k >> 1)]
    code = np.where(k & 1, pair & 15, pair >> 4)
    seqs = _strings(offsets, np.where(turned[row], _COMPLEMENT[code], _LETTER[code]))
    first = flat[np.minimum(qual_at, len(flat) - 1)]
    missing = (size > 0) & (first == 0xFF)
    quals = np.minimum(flat[qual_at[row] + k].astype(np.int64) + 33, 255).astype(np.uint8)
    quals[missing[row]] = 33  # never seen
    if (quals > 126).any():
        raise ValueError("a quality over 93")
    return names, seqs, _strings(offsets, quals, missing), size


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = json.loads(options["files"])
        self.split = int(options.get("splitbytes", SPLIT))

    def partitions(self) -> list[Split]:
        out = []
        for i, path, _ in self.files:
            size = store.size(path)
            out += [Split(i, path.rstrip("/").rpartition("/")[2], path, "bam", start, min(size, start + self.split), size) for start in range(0, size, self.split)]
        return out

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        local = 0
        fixed = {"file_id": partition.file_id, "file_name": partition.file_name, "part": partition.start}
        with store.open_file(partition.path) as f:
            references = _head(s := _Stream(bgzf.blocks(f, 0, partition.size, True)))
            if partition.start:
                s = _Stream(bgzf.blocks(f, partition.start, partition.size, False))
                if not _find(s, references):
                    return
            for data, begin in pieces(s, partition.end):
                for lo in range(0, len(begin), BATCH):
                    names, seqs, quals, size = decoded(data, begin[lo : lo + BATCH])
                    some = size > 0
                    values = {c: pa.repeat(pa.scalar(v, COLUMNS[c]), len(size)) for c, v in fixed.items()} | {"local": pa.array(local + np.cumsum(some) - some), "name": names, "seq": seqs, "qual": quals}
                    local += int(some.sum())
                    yield pa.RecordBatch.from_arrays([values[c] for c in COLUMNS], list(COLUMNS))


class BamSource(DataSource):
    """Options: files (JSON list of [file_id, path, kind]), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return ", ".join(f"{c} {k}" for c, k in KINDS.items())

    def reader(self, schema) -> DataSourceReader:
        return BamReader(dict(self.options))
