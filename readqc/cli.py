"""Command line: python -m readqc -o OUT FILES.."""

from __future__ import annotations

import argparse
import sys
import time
from dataclasses import replace

from pyspark.sql import SparkSession

from readqc import __version__
from readqc.config import RunMode, parse_limits
from readqc.plans.engine import run
from readqc.sources import dims, store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readqc", description="Quality control of sequencing reads (FASTQ, SAM, BAM) on Spark.")
    p.add_argument("files", nargs="+", metavar="FILE")
    p.add_argument("-o", "--output", required=True, help="folder for the reports, one below it for each file")
    p.add_argument("-t", "--threads", type=int, default=None, help="local cores, where no cluster is set")
    p.add_argument("-m", "--mem", default=None, help="bytes of a split, with K, M or G")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--config", help="limits file; options given here come before it")
    p.add_argument("--contaminants", help="file of name<TAB>sequence")
    p.add_argument("--adapters", help="file of name<TAB>sequence; turns adapters on")
    p.add_argument("--max-length", type=int, default=None, help="accepted for compatibility; reads of any length are taken")
    for name in ("bisulfite", "preseq", "groups"):
        p.add_argument(f"--{name}", action="store_true", default=None)
    p.add_argument("--orig-dups", action="store_true", default=None)
    for name in ("tiles", "dups", "adap", "kmers"):
        p.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=None)
    p.add_argument("--license", action="version", version="MIT License")
    p.add_argument("--version", action="version", version=__version__)
    return p


def mode_of(args: argparse.Namespace) -> RunMode:
    """The run mode of options over a limits file over defaults."""
    mode = RunMode()
    if args.config:
        with store.open_file(args.config) as f:
            mode = parse_limits(f.read().decode().splitlines(), mode)
    mode = mode.switched(tile=args.tiles, duplication=args.dups, overrepresented=args.dups, adapter=True if args.adapters else args.adap, kmer=args.kmers)
    return replace(mode, groups=bool(args.groups), bisulfite=bool(args.bisulfite), preseq=bool(args.preseq), original_duplicates=bool(args.orig_dups))


def size_of(text: str | None) -> int | None:
    if not text:
        return None
    unit = {"K": 10, "M": 20, "G": 30}.get(text[-1].upper(), 0)
    return int(text[:-1] if unit else text) << unit


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        mode = mode_of(args)
        builder = SparkSession.builder.appName("readqc")
        if args.threads:
            builder = builder.master(f"local[{args.threads}]").config("spark.sql.shuffle.partitions", 2 * args.threads)
        spark = builder.getOrCreate()
        began = time.time()
        folders = run(
            spark, args.files, args.output, mode, adapters=dims.read_adapters(args.adapters) if args.adapters else None,
            contaminants=dims.read_contaminants(spark, args.contaminants) if args.contaminants else None, split_bytes=size_of(args.mem),
        )
    except (ValueError, OSError) as e:
        print(f"readqc: {e}", file=sys.stderr)
        return 1
    if args.verbose:
        print(f"{len(folders)} reports in {time.time() - began:.1f} s", file=sys.stderr)
    return 0
