"""Runs files through an analysis and writes a report folder for each: text, HTML, summary and duplicate histogram."""

from __future__ import annotations

import datetime
import json
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readqc.config import RunMode
from readqc.plans import finish
from readqc.plans.analysis import Analysis
from readqc.report import html, text
from readqc.sources import sniff, store
from readqc.sources.files import staged_files

SUFFIXES = (".fastq.gz", ".fq.gz", ".fastq", ".fq", ".bam", ".sam")
#: The family of rows that tell a file's name, type and folder.
INFO = -1


def stem(path: str) -> str:
    """A file's name without the ending of its format."""
    name = path.rstrip("/").rpartition("/")[2]
    return next((name[: -len(s)] for s in SUFFIXES if name.endswith(s)), name)


def output_folders(paths: list[str], out: str) -> list[str]:
    stems = [stem(p) for p in paths]
    if twice := sorted({s for s in stems if stems.count(s) > 1}):
        raise ValueError(f"these inputs would share a folder: {twice}")
    return [f"{out.rstrip('/') or '/'}/{s}" for s in stems]


def write_reports(analysis: Analysis, infos: DataFrame) -> list[str]:
    """A folder for each row of infos (file_id, name, type, folder, began). A file's histograms meet in one task, which writes its report; only the folders' names come to
    the driver. Folders must be addresses that the tasks reach. A task that is tried again writes the same files."""
    mode, adapters = analysis.mode, analysis.adapters

    def write(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info: list[dict] = []

        def counts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                is_info = pc.equal(batch.column(1), INFO)
                info.extend(map(json.loads, batch.column(5).filter(is_info).to_pylist()))
                yield batch.filter(pc.invert(is_info))

        file = finish.of_batches(counts(), mode, adapters)
        results, grade = finish.finished(file)
        if not results.get("basic_stats", True):
            results["basic_stats"] = [finish.EMPTY]
        (own,), levels = info, file.levels()
        files = {"fastqc_data.txt": text.report(results, grade, own), "fastqc_report.html": html.report(results, grade, own, mode.graders, levels), "summary.txt": text.summary(grade, own["name"])}
        if mode.on("duplication"):
            files["preseq_hist.txt"] = text.preseq(levels)
        for name, content in files.items():
            store.write_text(own["folder"], name, content)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([own["folder"]])], ["file_id", "folder"])

    rows = analysis.file_rows()
    told = {"file_id": F.col("file_id"), "family": F.lit(INFO), "key": F.to_json(F.struct("name", "type", "folder", "began"))}
    every = rows.unionByName(infos.select(*(told.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema)))
    done = every.groupBy("file_id").applyInArrow(write, "file_id int, folder string")
    return [r["folder"] for r in done.orderBy("file_id").select("folder").collect()]


def run(spark: SparkSession, paths: list[str], out: str, mode: RunMode | None = None, adapters: list[tuple[str, str]] | None = None, contaminants: DataFrame | None = None, **options) -> list[str]:
    """Reports on files, one folder each under `out`, a path or the address of any store; all files go through one analysis. Returns the folders."""
    folders = output_folders(paths, out)
    if out == out.lstrip("/") and "://" not in out:
        folders = [os.path.abspath(f) for f in folders]  # tasks may run elsewhere
    kinds = [sniff.detect(p) for p in paths]
    began = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S UTC")
    rows = [(i, p.rstrip("/").rpartition("/")[2], sniff.FORMATS[kind], folder, began) for i, (p, kind, folder) in enumerate(zip(paths, kinds, folders, strict=True))]
    infos = spark.createDataFrame(rows, "file_id int, name string, type string, folder string, began string")
    analysis = Analysis(staged_files(spark, paths, kinds=kinds, **options), mode or RunMode(), contaminants=contaminants, **({"adapters": adapters} if adapters else {}))
    try:
        return write_reports(analysis, infos)
    finally:
        analysis.close()
