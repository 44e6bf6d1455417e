"""FASTQ as a Spark data source: plain and blocked-gzip files split by bytes; a gzip file is inflated by one task, as nothing in it can be found but in order, and
parsed by as many as there are: it becomes blocks of whole records that an exchange deals out.

A split owns the records that start after its first byte, up to and including one at its end; a record start inside a
file is a line with @ of which the second next starts with + and the next and third next are equally long, so a quality line
with @ is no start. A last record without a newline counts; lines that make no whole record at the end do not. A record that breaks
the format is an error. With mode DROPMALFORMED it is left out, and reading goes on at the next line that looks like a start, so that missing, blank or
further lines cost no record besides their own; mode MALFORMED gives just what is left out.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readqc.sources import bgzf, store

COLUMNS = {"file_id": pa.int32(), "file_name": pa.string(), "part": pa.int64(), "local": pa.int64(), "name": pa.string(), "seq": pa.string(), "qual": pa.string()}
KINDS = {"file_id": "int", "file_name": "string", "part": "long", "local": "long", "name": "string", "seq": "string", "qual": "string"}
SPLIT, BATCH = 64 << 20, 20_000
#: Compressed bytes that become a block.
BLOCK = 1 << 20
#: Bytes of the file before a split that are read to find the footing where records may be bad.
LOOK = 1 << 16


@dataclass
class Split(InputPartition):
    file_id: int
    file_name: str
    path: str
    kind: str
    start: int
    end: int
    size: int


def _record_start(data: bytes, at: int) -> int | None:
    """The first record start among the next lines from `at`, or None if too few lines are there."""
    lines, ends = [], [at]
    for _ in range(8):
        end = data.find(b"\n", ends[-1])
        stop = len(data) if end < 0 else end
        lines.append(data[ends[-1] : stop].rstrip(b"\r"))
        ends.append(stop + 1)
        if end < 0:
            break
    for i in range(len(lines) - 3):
        if lines[i][:1] == b"@" and lines[i + 2][:1] == b"+" and len(lines[i + 1]) == len(lines[i + 3]):
            return ends[i]
    return None


def _line_ends(data: bytes, at: int) -> np.ndarray:
    """Where the lines from `at` on end: their newlines, and the end of the data if the last has none."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8, offset=at) == 10) + at
    return ends if data.endswith(b"\n") or at == len(data) else np.append(ends, len(data))


def whole(own: bytes, more: Callable[[], bytes]) -> bytes:
    """own and so much of what lies behind it that a record which starts at its end is there; more() gives the bytes behind it, empty at the end of the file."""
    pieces, lines = [own], 0
    while lines < 9 and (got := more()):
        lines += got.count(b"\n")
        pieces.append(got)
    return b"".join(pieces)


def region(own: bytes, first: bool, more: Callable[[], bytes]) -> bytes:
    """The records that a split owns, where all records are as they should be."""
    data = whole(own, more)
    at = 0
    if not first:
        at = data.find(b"\n") + 1
        start = _record_start(data, at) if at else None
        if start is None:
            return b""
        at = start
    ends = _line_ends(data, at)[3::4] + 1
    starts = np.append(at, ends)[: len(ends)]
    kept = int(np.searchsorted(starts, len(own), side="right"))
    return data[at : ends[kept - 1]] if kept else b""


def stream(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from a stream."""
    rest = b""
    for chunk in chunks:
        rest += chunk
        ends = np.flatnonzero(np.frombuffer(rest, np.uint8) == 10)[3::4]
        if len(ends):
            yield rest[: ends[-1] + 1]
            rest = rest[ends[-1] + 1 :]
    if len(_line_ends(rest, 0)) >= 4:
        yield rest


def gunzip(f, step: int = 1 << 22) -> Iterator[bytes]:
    """The inflated bytes of a gzip file of any number of members. A file that ends inside a member is an error."""
    z, fed = zlib.decompressobj(31), False
    while data := f.read(step):
        while data:
            out = z.decompress(data, 8 * step)
            fed = True
            if out:
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, z, fed = z.unused_data.lstrip(b"\0"), zlib.decompressobj(31), False
    if fed:
        raise ValueError("the gzip file ends inside a member: it is cut short")


@dataclass
class Records:
    """Records of a text: for each where its lines start and end, without line ends, and the bytes."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, text: bytes) -> Records:
        ends = _line_ends(text, 0)
        ends = ends[: len(ends) // 4 * 4]
        starts = np.append(0, ends[:-1] + 1)[: len(ends)]
        data = np.frombuffer(text, np.uint8)
        while len(data) and (back := (ends > starts) & (data[ends - 1] == 13)).any():
            ends = ends - back
        return cls(data, starts.reshape(-1, 4), ends.reshape(-1, 4))

    @classmethod
    def found(cls, text: bytes, limit: int | None = None, searching: bool = False, ended: bool = True) -> tuple[Records, list[tuple[int, int]], int, bool]:
        """The records of a text with bad places in it, those places as (start, end), where reading stopped, and whether it was looking for a start there. After a bad place, or from the start if `searching`,
        a record begins at the next line that may be a start. Records that start behind `limit` are another split's; without `ended` more text follows."""
        ends = _line_ends(text, 0) if ended else np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
        n = len(ends)
        starts = np.append(0, ends[:-1] + 1)[:n]
        data, bare = np.frombuffer(text, np.uint8), ends.copy()
        while n and len(data) and (back := (bare > starts) & (data[np.maximum(bare - 1, 0)] == 13)).any():
            bare = bare - back
        mine = int(np.searchsorted(starts, len(text) if limit is None else limit, side="right"))
        most = max(0, n - 3)  # lines at which a record may start
        last = min(mine, most)
        size = bare - starts
        head = np.where(size > 0, data[np.minimum(starts, max(len(data) - 1, 0))] if n else 0, 0)
        i = np.arange(most)
        good = (head[i] == ord("@")) & (head[i + 2] == ord("+")) & (size[i + 1] == size[i + 3])
        # letters, gaps or nothing: what bases may begin with
        likely = np.flatnonzero(good & ~np.isin(head[i + 1], list(b"@+>")))
        bad_of = [np.flatnonzero(~good & (i % 4 == r)) for r in range(4)]
        at, taken, bad = 0, [], []
        while True:
            if searching:
                k = int(np.searchsorted(likely, at))
                to = int(likely[k]) if k < len(likely) else n if ended else max(at, most)
                if to > at:
                    bad.append((int(starts[at]), int(starts[to]) if to < n else len(text)))
                at = to
            if at >= last:
                searching = searching and at >= most and not ended
                break
            own = bad_of[at % 4]
            k = int(np.searchsorted(own, at))
            searching = k < len(own) and int(own[k]) < last
            stop = int(own[k]) if searching else at + -(-(last - at) // 4) * 4
            taken.append(np.arange(at, stop, 4))
            at = stop
            if not searching:
                break
        if ended and not searching and at < mine:  # too few lines at the end
            bad.append((int(starts[at]), len(text)))
            at = n
        rows = np.concatenate(taken) if taken else np.zeros(0, np.int64)
        lines = rows[:, None] + np.arange(4)
        stop = int(starts[at]) if at < n else len(text) if ended else int(ends[-1]) + 1 if n else 0
        return cls(data, starts[lines], bare[lines]), bad, stop, searching

    def good(self) -> np.ndarray:
        """Which begin with @, have a third line that begins with +, and as many qualities as bases."""
        size = self.ends - self.starts
        first = lambda i: self.data[np.minimum(self.starts[:, i], len(self.data) - 1)]
        return (size[:, 0] > 0) & (first(0) == ord("@")) & (size[:, 2] > 0) & (first(2) == ord("+")) & (size[:, 1] == size[:, 3])

    def columns(self, rows: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Names, bases and qualities of some of the records, taken from the text as it lies."""
        s, e = self.starts[rows], self.ends[rows]
        return tuple(_spans(self.data, a, b) for a, b in ((s[:, 0] + 1, e[:, 0]), (s[:, 1], e[:, 1]), (s[:, 3], e[:, 3])))


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings data[start:end]; spans are in order. They are every second one of the strings that the bounds cut."""
    offsets = np.empty(2 * len(starts) + 1, np.int64)
    offsets[0], offsets[1::2], offsets[2::2] = 0, starts, ends
    every = pa.Array.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return every.take(pa.array(np.arange(1, 2 * len(starts), 2))).cast(pa.large_string()).cast(pa.string())


class FastqReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.files = json.loads(options["files"])  # [file_id, path, kind] each
        self.split = int(options.get("splitbytes", SPLIT))
        mode = options.get("mode", "FAILFAST").upper()
        if mode not in ("FAILFAST", "DROPMALFORMED", "MALFORMED"):
            raise ValueError(f"no such mode: {mode}")
        self.drop, self.lost = mode != "FAILFAST", mode == "MALFORMED"
        self.columns = columns

    def partitions(self) -> list[Split]:
        out = []
        for file_id, path, kind in self.files:
            size = store.size(path)
            step = size if kind == "fastq_gz" else self.split
            for start in range(0, max(size, 1), max(step, 1)):
                out.append(Split(file_id, path.rstrip("/").rpartition("/")[2], path, kind, start, min(size, start + max(step, 1)), size))
        return out

    def _texts(self, s: Split, back: int = 0) -> Iterator[tuple[bytes, bytes, Callable[[], bytes]]]:
        """What lies before the split, up to some `back` bytes of the file, the split's bytes, and a way to what lies behind."""
        start = max(0, s.start - back)
        with store.open_file(s.path) as f:
            if s.kind == "fastq_bgzf":
                it = bgzf.blocks(f, start, s.size, start == 0)
                before, own, behind = [], [], []
                for at, data in it:
                    if at >= s.end:
                        behind.append(data)
                        break
                    (own if at >= s.start else before).append(data)
                if own or s.start == 0:
                    yield b"".join(before), b"".join(own), lambda: behind.pop() if behind else next((d for _, d in it if d), b"")
            else:
                f.seek(start)
                yield f.read(s.start - start), f.read(s.end - s.start), lambda: f.read(1 << 16)

    def _records(self, s: Split) -> Iterator[tuple[Records, bytes, list[tuple[int, int]]]]:
        """Records, the text that they lie in, and its bad places."""
        if s.kind == "fastq_gz":
            with store.open_file(s.path) as f:
                if not self.drop:
                    for text in stream(gunzip(f)):
                        yield Records.of(text), text, []
                    return
                rest, searching = b"", False
                for chunk in itertools.chain(gunzip(f), [None]):
                    text = rest + (chunk or b"")
                    found, bad, at, searching = Records.found(text, None, searching, chunk is None)
                    yield found, text, bad
                    rest = text[at:]
            return
        for before, own, more in self._texts(s, LOOK if self.drop else 0):
            first = s.start == 0
            if not self.drop:
                text = region(own, first, more)
                yield Records.of(text), text, []
                continue
            # read from some records ahead of the split, so that it and the one before see the same records
            text = before + whole(own, more)
            found, bad, *_ = Records.found(text, len(before) + len(own), s.start > LOOK)
            mine = np.flatnonzero((found.starts[:, 0] > len(before)) | first)
            yield Records(found.data, found.starts[mine], found.ends[mine]), text, [x for x in bad if first or x[0] > len(before)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        local = 0
        fixed = {"file_id": partition.file_id, "file_name": partition.file_name, "part": partition.start}
        for found, text, bad in self._records(partition):
            if self.lost:
                if bad:
                    values = {c: pa.repeat(pa.scalar(v, COLUMNS[c]), len(bad)) for c, v in fixed.items()} | {
                        "local": pa.array([text.count(b"\n", a, b) + (not text[a:b].endswith(b"\n")) for a, b in bad], pa.int64()), "name": pa.array([text[a : min(b, a + 200)].decode(errors="replace") for a, b in bad])
                    }
                    yield pa.RecordBatch.from_arrays([values.get(c, pa.nulls(len(bad), COLUMNS[c])) for c in self.columns], self.columns)
                continue
            for batch in columns_of(found, fixed, local, self.columns, partition.path):
                yield batch
            local += int((found.ends[:, 1] > found.starts[:, 1]).sum())


def columns_of(found: Records, fixed: dict, local: int, columns: list[str], path: str) -> Iterator[pa.RecordBatch]:
    """Records as batches; the first of them with bases has the number `local`. One that breaks the format is an error."""
    good = found.good()
    if not good.all():
        wrong = int(np.argmin(good))
        name, seq, qual = (bytes(found.data[found.starts[wrong, i] : found.ends[wrong, i]]) for i in (0, 1, 3))
        raise ValueError(f"{path}: not a FASTQ record: {name[:80]!r}, {len(seq)} bases, {len(qual)} qualities")
    for i in range(0, len(good), BATCH):
        rows = np.arange(i, min(i + BATCH, len(good)))
        n = len(rows)
        name, seq, qual = found.columns(rows)
        some = found.ends[rows, 1] > found.starts[rows, 1]
        index = local + np.cumsum(some) - some
        local += int(some.sum())
        values = {c: pa.repeat(pa.scalar(v, COLUMNS[c]), n) for c, v in fixed.items()} | {"local": pa.array(index.astype(np.int64)), "name": name, "seq": seq, "qual": qual}
        yield pa.RecordBatch.from_arrays([values[c] for c in columns], columns)


class FastqSource(DataSource):
    """Options: files (JSON list of [file_id, path, kind]), splitBytes, mode, columns (comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def _columns(self) -> list[str]:
        return [c for c in self.options.get("columns", ",".join(COLUMNS)).split(",")]

    def schema(self) -> str:
        return ", ".join(f"{c} {KINDS[c]}" for c in self._columns())

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(dict(self.options), self._columns())


class BlockReader(DataSourceReader):
    """gzip files as blocks of whole records, numbered in their order."""

    def __init__(self, options: dict[str, str]):
        self.files = json.loads(options["files"])

    def partitions(self) -> list[Split]:
        return [Split(i, path.rstrip("/").rpartition("/")[2], path, kind, 0, store.size(path), store.size(path)) for i, path, kind in self.files]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        with store.open_file(partition.path) as f:
            for number, text in enumerate(stream(gunzip(f, BLOCK))):
                yield pa.RecordBatch.from_arrays([pa.array([partition.file_id], pa.int32()), pa.array([partition.file_name]), pa.array([number]), pa.array([text], pa.binary())], ["file_id", "file_name", "part", "text"])


class BlockSource(DataSource):
    """Options: files (JSON list of [file_id, path, kind])."""

    @classmethod
    def name(cls) -> str:
        return "fastq_blocks"

    def schema(self) -> str:
        return "file_id int, file_name string, part long, text binary"

    def reader(self, schema) -> DataSourceReader:
        return BlockReader(dict(self.options))


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of blocks, in the columns of the data source."""
    for batch in batches:
        for i in range(batch.num_rows):
            file_id, name, part = (batch.column(k)[i].as_py() for k in range(3))
            yield from columns_of(Records.of(batch.column(3)[i].as_py()), {"file_id": file_id, "file_name": name, "part": part}, 0, list(COLUMNS), name)
