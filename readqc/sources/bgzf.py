"""Blocked gzip: blocks of at most 64 KiB that inflate alone, so a file can be split anywhere."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

MAGIC = b"\x1f\x8b\x08\x04"
#: Fixed value: the empty block that ends a file.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block_size(data: bytes, at: int = 0) -> int | None:
    """The length of the block that starts there, or None if none does (or too little of it is there to tell)."""
    if data[at : at + 4] != MAGIC or len(data) < at + 18:
        return None
    extra = int.from_bytes(data[at + 10 : at + 12], "little")
    i, stop = at + 12, at + 12 + extra
    while i + 4 <= min(stop, len(data)):
        n = int.from_bytes(data[i + 2 : i + 4], "little")
        if data[i : i + 2] == b"BC" and n == 2:
            return int.from_bytes(data[i + 4 : i + 6], "little") + 1
        i += 4 + n
    return None


def inflate(block: bytes) -> bytes:
    extra = int.from_bytes(block[10:12], "little")
    out = zlib.decompress(block[12 + extra : -8], -15)
    if zlib.crc32(out) != int.from_bytes(block[-8:-4], "little") or len(out) != int.from_bytes(block[-4:], "little"):
        raise ValueError("a block is damaged")
    return out


def blocks(f, start: int, size: int, first: bool) -> Iterator[tuple[int, bytes]]:
    """(address, inflated bytes) of the blocks from the first that starts at `start` or later. A start inside a file is looked for by the
    magic number, and taken if another block or the end of the file follows it."""
    window = b""
    at = start
    if not first:
        f.seek(at)
        window = f.read(min(1 << 18, size - at))
        i = 0
        while True:
            i = window.find(MAGIC, i)
            if i < 0:
                return
            n = block_size(window, i)
            if n and (at + i + n == size or window[i + n : i + n + 4] == MAGIC):
                at += i
                break
            i += 1
    f.seek(at)
    data = b""
    while at < size:
        if len(data) < (1 << 16) + 18:
            data += f.read(1 << 22)
        n = block_size(data)
        if not n or n > len(data):
            raise ValueError(f"no whole block at {at}")
        yield at, inflate(data[:n])
        data = data[n:]
        at += n


def deflate(data: bytes, size: int = 60_000) -> bytes:
    """data as blocked gzip, with the end block."""
    out = []
    for i in range(0, len(data), size):
        part = data[i : i + size]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out.append(MAGIC + bytes(5) + b"\xff\x06\x00BC\x02\x00" + (len(body) + 25).to_bytes(2, "little") + body + zlib.crc32(part).to_bytes(4, "little") + len(part).to_bytes(4, "little"))
    return b"".join(out) + END
