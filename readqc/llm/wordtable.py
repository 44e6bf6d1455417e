"""Distinct words of a stretch of text and their token ids, so that each distinct word is encoded once."""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Callable

import numpy as np

from readqc.llm import textkernel as K


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of each range, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


class WordTable:
    """Maps words (byte spans) to numbers, and numbers to token ids.

    `encode` takes the flat bytes of new words and their offsets and returns their flat ids and the ids'
    offsets. Words are found by a 64-bit hash and then compared byte by byte; one that shares its hash with
    another has a number of its own. `full` says when to start a new table.
    """

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], limit: int = 600_000, hashed=K.span_hash):
        self.encode, self.limit, self.hashed = encode, limit, hashed
        self.number: dict[int | bytes, int] = {}
        self.bytes, self.starts, self.ends = bytearray(), array("q"), array("q")
        self.ids, self.offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.done = 0

    @property
    def full(self) -> bool:
        return len(self.starts) >= self.limit

    def _append(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        lengths = ends - starts
        upto = len(self.bytes) + np.cumsum(lengths)
        self.bytes += data[ranges(starts, lengths)].tobytes()
        self.starts.frombytes((upto - lengths).tobytes())
        self.ends.frombytes(upto.tobytes())

    def add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the spans' words."""
        unique, first, inverse = np.unique(self.hashed(data, starts, ends), return_index=True, return_inverse=True)
        number, size = self.number, len(self.starts)
        free = itertools.count(size)
        numbers = np.fromiter((number[h] if h in number else number.setdefault(h, next(free)) for h in unique.tolist()), np.int64, len(unique))
        fresh = first[numbers >= size]
        self._append(data, starts[fresh], ends[fresh])
        numbers = numbers[inverse]
        held, begin, stop = np.frombuffer(self.bytes, np.uint8), np.frombuffer(self.starts, np.int64), np.frombuffer(self.ends, np.int64)
        same = K.same_spans(data, starts, ends, held, begin[numbers], stop[numbers])
        del held, begin, stop  # a buffer that is looked at cannot grow
        for i in np.flatnonzero(~same).tolist():
            word = data[starts[i] : ends[i]].tobytes()
            if word not in number:
                number[word] = len(self.starts)
                self._append(data, starts[i : i + 1], ends[i : i + 1])
            numbers[i] = number[word]
        return numbers.astype(np.int32)

    def encode_new(self) -> None:
        if self.done == len(self.starts):
            return
        cut = np.append(np.frombuffer(self.starts[self.done :], np.int64), self.ends[-1])
        ids, offsets = self.encode(np.frombuffer(bytes(self.bytes[cut[0] :]), np.uint8), cut - cut[0])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
        self.done = len(self.starts)

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """How many ids each word has."""
        return np.diff(self.offsets)[numbers]

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the words in order."""
        return self.ids[ranges(self.offsets[numbers], self.counts(numbers))]
