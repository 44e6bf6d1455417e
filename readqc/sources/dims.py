"""Adapter and contaminant lists."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from readqc.sources import store

#: Adapters that are looked for unless a list is given.
DEFAULT_ADAPTERS = [
    ("Illumina Universal Adapter", "AGATCGGAAGAG"),
    ("Illumina Small RNA 3' Adapter", "TGGAATTCTCGG"),
    ("Illumina Small RNA 5' Adapter", "GATCGTCGGACT"),
    ("Nextera Transposase Sequence", "CTGTCTCTTATA"),
    ("PolyA", "AAAAAAAAAAAA"),
    ("PolyG", "GGGGGGGGGGGG"),
]
SHORTEST, LONGEST = 6, 16
#: Contaminants of a list at most.
MOST = 100_000


def parse_pairs(lines: Iterable[str]) -> list[tuple[str, str]]:
    """name<TAB>sequence a line; # opens a comment line; repeated blanks count as one."""
    out = []
    for line in lines:
        text = line.strip()
        if not text or text.startswith("#"):
            continue
        fields = re.sub(r"([ \t])\1+", r"\1", text).split("\t")
        if len(fields) != 2 or not all(x.isprintable() and x for x in fields):
            raise ValueError(f"malformed line: {line.rstrip()!r}")
        out.append((fields[0], fields[1]))
    return out


def check_adapters(adapters: list[tuple[str, str]]) -> list[tuple[str, str]]:
    sizes = {len(s) for _, s in adapters}
    if len(sizes) != 1 or not SHORTEST <= min(sizes) <= LONGEST:
        raise ValueError(f"adapters must be equally long, {SHORTEST} to {LONGEST} bases; found lengths {sorted(sizes)}")
    return adapters


def _lines(path: str) -> list[str]:
    with store.open_file(path) as f:
        return f.read().decode().splitlines()


def read_adapters(path: str) -> list[tuple[str, str]]:
    return check_adapters(parse_pairs(_lines(path)))


def contaminants(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, name, seq.upper()) for i, (name, seq) in enumerate(pairs)], "contam_id int, name string, seq string")


def read_contaminants(spark: SparkSession, path: str) -> DataFrame:
    pairs = parse_pairs(_lines(path))
    if len(pairs) > MOST:
        raise ValueError(f"{path}: {len(pairs)} contaminants; {MOST} at most, as the list goes to every executor")
    return contaminants(spark, pairs)
