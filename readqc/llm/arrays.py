"""Flat arrays in the shared folder, written by tasks and memory-mapped by workers."""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid

import numpy as np
import pyarrow.fs as fs

#: Files that a worker holds mapped; a process may have 65,530 maps by default.
MAPPED = 24_576
#: Bytes before an array: the kind of its numbers.
HEAD = 8


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an address with its scheme, as shared.new_folder gives it."""
    return fs.FileSystem.from_uri(uri)


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Writes an array under its name. It is written aside and then moved, so that a file is whole or not there; attempts of one task write the
    same bytes."""
    system, path = _at(folder)
    system.create_dir(path, recursive=True)
    aside = f"{path}/{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as f:
        f.write(array.dtype.str[1:].encode().ljust(HEAD))
        f.write(memoryview(np.ascontiguousarray(array)).cast("B") if len(array) else b"")
    try:
        system.move(aside, f"{path}/{name}")
    except OSError:  # some stores don't move onto a file that another attempt has left
        if system.get_file_info(f"{path}/{name}").type != fs.FileType.File:
            raise
        system.delete_file(aside)


def smallest(array: np.ndarray) -> np.ndarray:
    """The same counts in the smallest unsigned type that holds them."""
    most = int(array.max()) if len(array) else 0
    return array.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


def load(folder: str, name: str) -> np.ndarray:
    """Maps an array into memory; one that is not there is an error. A local file is mapped where it lies; one from elsewhere is copied to an
    unnamed temporary file first, which goes with the map."""
    system, path = _at(folder)
    path = f"{path}/{name}"
    if isinstance(system, fs.LocalFileSystem):
        with open(path, "rb") as f:
            return _mapped(f.fileno())
    with tempfile.TemporaryFile() as out, system.open_input_stream(path) as f:
        while part := f.read(1 << 24):
            out.write(part)
        out.flush()
        return _mapped(out.fileno())


def _mapped(file: int) -> np.ndarray:
    data = mmap.mmap(file, 0, access=mmap.ACCESS_READ)
    kind = np.dtype("<" + data[:HEAD].decode().strip())
    return np.frombuffer(data, kind, offset=HEAD) if os.fstat(file).st_size > HEAD else np.zeros(0, kind)


class Shelf:
    """Arrays of a folder, mapped when they are first asked for. Each piece of text asks for all buckets in their order, so where there are more arrays than
    `most`, what came last goes for what comes next: those that came first stay and need not be opened again."""

    def __init__(self, folder: str, most: int = MAPPED):
        self.folder, self.most, self.opened = folder, most, 0
        self.held: dict[str, np.ndarray] = {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name in self.held:
            return self.held[name]
        if len(self.held) >= self.most:
            self.held.popitem()
        self.opened += 1
        return self.held.setdefault(name, load(self.folder, name))
