"""Opening files by path or address: local ones, and any store that Arrow knows."""

from __future__ import annotations

import pyarrow.fs as fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def size(path: str) -> int:
    system, name = locate(path)
    info = system.get_file_info(name)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(f"no such file: {path}")
    return info.size


def open_file(path: str):
    system, name = locate(path)
    return system.open_input_file(name)


def write_text(folder: str, name: str, content: str) -> None:
    """A text file in a folder, which is made if it is not there."""
    system, path = locate(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}") as f:
        f.write(content.encode())


def head(path: str, n: int = 1 << 16) -> bytes:
    with open_file(path) as f:
        return f.read(n)
