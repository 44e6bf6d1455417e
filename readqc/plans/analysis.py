"""A run over reads: the results and grades of the enabled modules, as DataFrames.

The reads are scanned once, by a kernel that counts for all enabled modules together (`operators/fused.py`); the counts are written to the shared folder, and
modules are queries over them, and grades come from each file's histograms (`finish.py`). A light pass before it tells the kernel each file's number of reads, longest read and header. Branches of disabled
modules are never built. Nothing of a result comes to the driver.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readqc.config import MODULES, RunMode
from readqc.functions import stats
from readqc.operators import adapters as ad
from readqc.operators import duplicates as dup
from readqc.operators import fused, per_read, positions, tiles
from readqc.operators import kmers as km
from readqc.plans import finish
from readqc.shared import written
from readqc.sources.dims import DEFAULT_ADAPTERS

#: What the modules are made from, besides lengths.
NEEDS = {
    "basic_stats": {fused.CUBE}, "quality_base": {fused.CUBE}, "tile": {fused.CUBE, fused.TILE}, "quality_sequence": {fused.CUBE, fused.QUALITY}, "sequence": {fused.CUBE},
    "gc_sequence": {fused.GC}, "n_content": {fused.CUBE}, "sequence_length": set(), "duplication": {fused.KEY}, "overrepresented": {fused.KEY}, "adapter": {fused.ADAPTER}, "kmer": {fused.KMER},
}


def _kept(f):
    """A DataFrame of small results that several modules use: built once and persisted."""
    return functools.cached_property(lambda self: f(self).persist())


@dataclass
class Analysis:
    reads: DataFrame
    mode: RunMode = field(default_factory=RunMode)
    adapters: list[tuple[str, str]] = field(default_factory=lambda: list(DEFAULT_ADAPTERS))
    contaminants: DataFrame | None = None

    cube = _kept(lambda self: self.family(fused.CUBE))
    encodings = _kept(lambda self: positions.encoding(self.cube))
    lengths = _kept(lambda self: self.family(fused.LENGTH))
    summary = _kept(lambda self: per_read.length_summary(self.lengths))
    qualities = _kept(lambda self: per_read.in_phred(self.family(fused.QUALITY), self.encodings))
    gc = _kept(lambda self: per_read.gc_combined(self.family(fused.GC)))
    levels = _kept(lambda self: self._levels())
    adapter_hits = _kept(lambda self: self.family(fused.ADAPTER))
    tile_means = _kept(lambda self: tiles.centered(tiles.in_phred(self.family(fused.TILE), self.encodings), self.mode.groups, self._longest))
    kmer_cells = _kept(lambda self: self.family(fused.KMER))

    @functools.cached_property
    def files(self) -> DataFrame:
        """A row a file: reads, longest read, place of the tile in headers."""
        return written(fused.profile(self.reads), "files")

    @property
    def _longest(self) -> DataFrame:
        return self.files.select("file_id", "longest")

    @functools.cached_property
    def families(self) -> frozenset[int]:
        """What the enabled modules need."""
        own = {fused.LENGTH}.union(*(NEEDS[m] for m in self.mode.enabled))
        return frozenset(own - {fused.KEY} if self.mode.original_duplicates else own)

    def _count(self, families: frozenset[int]) -> DataFrame:
        known = fused.settings(self.files, self.mode.groups, 1 if self.mode.preseq else None)
        return fused.count(self.reads, known, families, self.adapters)

    @functools.cached_property
    def counts(self) -> DataFrame:
        """All families that the enabled modules need, by one scan of the reads."""
        return written(self._count(self.families).sortWithinPartitions("family"), "counts")

    def family(self, family: int) -> DataFrame:
        return fused.part(self.counts if family in self.families else self._count(frozenset([family])), family)

    @functools.cached_property
    def _original(self) -> tuple[DataFrame, DataFrame]:
        return dup.seeds(self.reads)

    @functools.cached_property
    def key_counts(self) -> DataFrame:
        if self.mode.original_duplicates:
            return written(dup.original_counts(self.reads, self._original[0]), "keys")
        return self.family(fused.KEY)

    def _levels(self) -> DataFrame:
        hist = dup.levels(self.key_counts)
        return dup.corrected(hist, self._original[1]) if self.mode.original_duplicates else hist

    def result(self, module: str) -> DataFrame:
        """The rows of a module's report."""
        on = self.mode.groups
        if module == "basic_stats":
            gc = positions.base_counts(self.cube).groupBy("file_id").agg(F.sum(F.col("g") + F.col("c")).alias("gc"))
            rows = self.summary.join(gc, "file_id", "left").join(self.encodings, "file_id", "left")
            pct = 100.0 * F.coalesce("gc", F.lit(0)) / F.expr("nullif(total_bases, 0)")
            return rows.select("file_id", "n_reads", "total_bases", "min_len", "max_len", "mean_len", "median_len", pct.alias("gc_pct"), F.coalesce("encoding", F.lit("unknown")).alias("encoding"))
        if module == "quality_base":
            return positions.quality_by_position(self.cube, on, self.encodings, self._longest)
        if module == "tile":
            return self.tile_means
        if module == "quality_sequence":
            return per_read.trimmed(self.qualities, "quality")
        if module == "sequence":
            return positions.base_content(self.cube, on, self._longest)
        if module == "gc_sequence":
            grid = self.gc.select("file_id").distinct().withColumn("gc", F.explode(F.sequence(F.lit(0), F.lit(100))))
            return grid.join(self.gc, ["file_id", "gc"], "left").select("file_id", "gc", F.coalesce("n", F.lit(0.0)).alias("n"))
        if module == "n_content":
            return positions.n_content(self.cube, on, self._longest)
        if module == "sequence_length":
            return per_read.dense_lengths(self.lengths)
        if module == "duplication":
            return dup.binned(self.levels).join(dup.summary(self.levels).select("file_id", "dedup_pct"), "file_id")
        if module == "overrepresented":
            over = dup.overrepresented(self.key_counts)
            return dup.contaminant_match(over, self.contaminants) if self.contaminants is not None else over.withColumn("source", F.lit("No Hit"))
        if module == "adapter":
            return ad.cumulative(self.adapter_hits, self.summary.select("file_id", "n_reads", "max_len"), self.adapters, on)
        if module == "kmer":
            return km.enriched(self.kmer_cells)
        raise ValueError(f"no such module: {module}")

    def statistic(self, module: str) -> DataFrame:
        """(file_id, value) that a module is graded by; two columns (value, lower) for qualities by position."""
        if module == "quality_base":
            return self.result(module).groupBy("file_id").agg(F.min("median").alias("value"), F.min("lower_quartile").alias("lower"))
        if module == "tile":
            return self.tile_means.groupBy("file_id").agg(F.max(F.abs("centered_mean")).alias("value"))
        if module == "quality_sequence":
            return self.result(module).groupBy("file_id").agg(F.max_by("quality", F.struct("n", -F.col("quality"))).cast("double").alias("value"))
        if module == "sequence":
            a, c, g, t = (F.col(f"{b}_pct") for b in "acgt")
            worst = F.abs((a + g) - (t + c)) if self.mode.bisulfite else F.greatest(F.abs(a - t), F.abs(c - g))
            return self.result(module).groupBy("file_id").agg(F.max(worst).alias("value"))
        if module == "gc_sequence":
            # 101 numbers a file
            rows = self.result(module).groupBy("file_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("gc", "n"))), lambda x: x["n"]).alias("h"))

            @F.pandas_udf("double")
            def deviation(h: pd.Series) -> pd.Series:
                return h.map(lambda x: stats.gc_deviation(np.asarray(x)))

            return rows.select("file_id", deviation("h").alias("value"))
        if module == "n_content":
            return self.result(module).groupBy("file_id").agg((F.max_by("n_pct", F.struct("n", -F.col("group_id"))) / 100).alias("value"))
        if module == "duplication":
            return dup.summary(self.levels).select("file_id", (F.col("dedup_pct") / 100).alias("value"))
        if module == "overrepresented":
            most = self.key_counts.groupBy("file_id").agg(F.max("n").alias("most"), F.sum("n").alias("total"))
            return most.select("file_id", (F.col("most") / F.expr("nullif(total, 0)")).alias("value"))
        if module == "adapter":
            most = self.adapter_hits.groupBy("file_id").agg(F.max("n").alias("most"))
            return self.summary.join(most, "file_id", "left").select("file_id", (F.coalesce("most", F.lit(0)) / F.col("n_reads")).alias("value"))
        if module == "kmer":
            first = self.result(module).where("rank = 1").select("file_id", "pvalue")
            value = F.when(F.col("pvalue") > 0, -F.log10("pvalue")).when(F.col("pvalue") == 0, F.lit(float(np.finfo(float).max))).otherwise(0.0)  # no k-mer: pass
            return self.summary.select("file_id").join(first, "file_id", "left").select("file_id", value.alias("value"))
        raise ValueError(f"no statistic for {module}")

    def file_rows(self) -> DataFrame:
        """(file_id, family, a, b, c, key, n, s): all that a file's report is made from. Keys are there as levels of duplication and as overrepresented ones."""
        small = self.counts.where(F.col("family") != fused.KEY)
        blank = lambda **own: [own.get(c, F.lit(None).cast(k)).alias(c) for c, k in (x.split() for x in fused.ROWS.split(", "))]
        level = lambda df, family: df.select(*blank(file_id=F.col("file_id"), family=F.lit(family), a=F.col("times_seen"), n=F.col("n_keys")))
        ready = lambda df, family: df.select(*blank(file_id=F.col("file_id"), family=F.lit(family), key=F.to_json(F.struct(*(c for c in df.columns if c != "file_id")), {"ignoreNullFields": "false"})))
        parts = [small.select(*blank(**{c: F.col(c) for c in small.columns}))]
        if self.mode.on("duplication") or self.mode.on("overrepresented"):
            parts.append(level(dup.levels(self.key_counts), finish.LEVELS))
            if self.mode.original_duplicates:
                parts.append(level(self.levels, finish.REPORTED))
        if self.mode.on("overrepresented"):
            parts.append(ready(self.result("overrepresented"), finish.OVERREPRESENTED))
        if self.mode.on("kmer"):
            parts.append(ready(self.result("kmer"), finish.ENRICHED))
        return functools.reduce(DataFrame.unionByName, parts)

    def grades(self) -> DataFrame:
        """(file_id, section_no, module, title, grade) of the enabled modules, each file's from its histograms in one task."""
        mode, adapters = self.mode, self.adapters

        def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, grades = finish.finished(finish.of_batches(batches, mode, adapters))
            names = list(MODULES)
            rows = [(key[0].as_py(), names.index(m), m, MODULES[m][0], g) for m, g in grades.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], ["file_id", "section_no", "module", "title", "grade"])

        return self.file_rows().groupBy("file_id").applyInArrow(run, "file_id int, section_no int, module string, title string, grade string")

    def close(self) -> None:
        """Frees what is persisted."""
        for x in list(vars(self).values()):
            if isinstance(x, DataFrame) and x is not self.reads and x is not self.contaminants:
                x.unpersist()
