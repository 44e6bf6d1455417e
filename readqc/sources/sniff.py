"""Which format a file has, by its first bytes."""

from __future__ import annotations

import re
import zlib

from readqc.sources import bgzf, store

#: Formats and what reports call them.
FORMATS = {"fastq": "FASTQ", "fastq_gz": "FASTQ gzip", "fastq_bgzf": "FASTQ BGZF", "sam": "SAM", "bam": "BAM"}
_SAM_HEADER = re.compile(rb"@(HD|SQ|RG|PG|CO)\t")


def _text_format(data: bytes) -> str | None:
    if not data:
        return "fastq"
    if _SAM_HEADER.match(data):
        return "sam"
    if data[:1] == b"@":
        return "fastq"
    if data.split(b"\n", 1)[0].count(b"\t") >= 10:
        return "sam"
    return None


def detect(path: str) -> str:
    """One of FORMATS. An empty file is FASTQ without reads; anything unknown is an error."""
    data = store.head(path)
    found = None
    if data[:2] == b"\x1f\x8b":
        try:
            inner = zlib.decompressobj(31).decompress(data, 1 << 16)
        except zlib.error as e:
            raise ValueError(f"{path}: {e}") from None
        blocked = bgzf.block_size(data) is not None
        if inner[:4] == b"BAM\x01":
            found = "bam" if blocked else None
        elif _text_format(inner) == "fastq":
            found = "fastq_bgzf" if blocked else "fastq_gz"
    else:
        found = _text_format(data)
    if not found:
        raise ValueError(f"{path}: neither FASTQ nor SAM nor BAM")
    return found
