"""Whole-batch text kernels: numpy over the flat UTF-8 buffer of an Arrow string column.

Every function takes the buffer of many documents at once, so the cost is a few vector passes a
byte and some ten operations a word, without a Python object per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_K0, _K1, _K2, _K3 = (U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Flat:
    """UTF-8 bytes of a batch of documents; document i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1


def flat(column: pa.Array | pa.ChunkedArray) -> Flat:
    """The bytes of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    if not len(column):
        return Flat(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    return Flat(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def trim() -> None:
    """Gives freed memory back to the machine: a Python worker lives on for the tasks of later stages, and what it keeps counts
    against its executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[pa.Table]:
    """Gathers Arrow batches up to about `size` bytes of text, so that fixed costs are paid seldom and
    memory stays bounded: a chunk ends with the row that passes the size."""
    trim()
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        at = 0
        lengths = _lengths(batch.column(batch.schema.get_field_index(text)))
        while at < batch.num_rows:
            upto = at + int(np.searchsorted(np.cumsum(lengths[at:]), max(1, size - n))) + 1
            part = batch.slice(at, min(upto, batch.num_rows) - at)
            n += int(lengths[at : at + part.num_rows].sum())
            held.append(part)
            at += part.num_rows
            if n >= size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)
        del held
    trim()


def kept(batches: Iterator[pa.RecordBatch], text: str, size: int, keep: Callable[[pa.ChunkedArray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows, all columns, for whose texts keep(..) is true, asked by chunks."""
    for piece in chunks(batches, text, size):
        yield from piece.filter(pa.array(keep(piece[text]))).to_batches()


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads them evenly."""
    h = h ^ (h >> U(30))
    h = h * _K1
    h ^= h >> U(27)
    h *= _K2
    h ^= h >> U(31)
    return h


def unmix(h: np.ndarray) -> np.ndarray:
    """The inverse of mix."""
    h = h ^ (h >> U(31)) ^ (h >> U(62))
    h = h * U(pow(int(_K2), -1, 2**64))
    h = h ^ (h >> U(27)) ^ (h >> U(54))
    h = h * U(pow(int(_K1), -1, 2**64))
    return h ^ (h >> U(30)) ^ (h >> U(60))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end], eight bytes a step."""
    lanes = _lanes(data)
    size = ends - starts
    h = size.astype(U) * _K0 + _K3
    h = mix(h ^ ((lanes[starts] & _MASK[np.minimum(size, 8)]) * _K1))
    left = np.flatnonzero(size > 8)
    at = 8
    while len(left):
        rest = size[left] - at
        h[left] = mix((h[left] ^ ((lanes[starts[left] + at] & _MASK[np.minimum(rest, 8)]) * _K1)) + _K0)
        left = left[rest > 8]
        at += 8
    return h


def _lanes(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, as one number."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether each data[start:end] is the same bytes as other[begin:stop], eight bytes a step."""
    size = ends - starts
    same = size == stop - begin
    left, at = np.flatnonzero(same), 0
    mine, others = _lanes(data), _lanes(other)
    while len(left):
        rest = size[left] - at
        equal = ((mine[starts[left] + at] ^ others[begin[left] + at]) & _MASK[np.clip(rest, 0, 8)]) == 0
        same[left[~equal]] = False
        left = left[equal & (rest > 8)]
        at += 8
    return same


@dataclass
class Words:
    """Words of a batch in order: hash each, and the range of words of each document."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def word_spans(text: Flat, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes marked in `inside`, and each document's range of runs.
    A run ends with its document."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(text.docs + 1, np.int64)
    first = np.zeros(n + 1, bool)
    first[text.offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, text.offsets)


def words(column: pa.Array | pa.ChunkedArray, lower: bool = True) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of each text, A-Z in lower case."""
    text = flat(column)
    data = LOWER[text.data] if lower else text.data
    starts, ends, bounds = word_spans(text, ~SPACE[data])
    return Words(span_hash(data, starts, ends), bounds, starts, ends, data)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; entry i is of words i .. i + k - 1."""
    if len(h) < k:
        return np.zeros(0, U)
    g = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        g *= _K2
        g ^= g >> U(29)
        g += h[i : len(h) - k + 1 + i]
    return mix(g)


def sequence_hash(h: np.ndarray) -> int:
    """Hash of a whole sequence of words, with its length."""
    at = np.arange(1, len(h) + 1, dtype=U)
    return int(mix(np.array([np.sum(mix(h + at * _K0), dtype=U) ^ U(len(h))]))[0])


def digest(h: np.ndarray) -> bytes:
    """128-bit fingerprint of an ordered array of hashes."""
    import hashlib

    return hashlib.blake2b(np.ascontiguousarray(h), digest_size=16).digest()


def planes(a: np.ndarray) -> bytes:
    """Bytes of an array by plane (all lowest bytes first), which the codec of a shuffle packs well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unplanes(b: bytes, kind: type | str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def pack_sorted(a: np.ndarray) -> bytes:
    """A sorted uint64 array as byte planes of its steps."""
    return planes(np.diff(a, prepend=U(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b, U), dtype=U)
