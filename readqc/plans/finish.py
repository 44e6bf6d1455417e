"""What a report needs from the histograms of one file: the rows of each module, and its grades.

A file's histograms are small: positions or groups of them by bases and qualities, lengths, tiles. They meet in one task a file, which works out all modules in one go;
the same rows come from `Analysis.result`, module by module, as queries over all files.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np

from readqc.config import MODULES, RunMode, grade
from readqc.functions import stats
from readqc.operators import fused
from readqc.operators.duplicates import BINS
from readqc.operators.kmers import neg_log10
from readqc.operators.positions import QUANTILES

#: Families besides those of the kernel: levels of duplication as counted and as reported, and rows of two modules as JSON.
LEVELS, REPORTED, OVERREPRESENTED, ENRICHED = range(8, 12)
EMPTY = {"n_reads": 0, "total_bases": 0, "min_len": 0, "max_len": 0, "mean_len": 0.0, "median_len": 0, "gc_pct": None, "encoding": "unknown"}


def quantiles(value: np.ndarray, n: np.ndarray) -> dict:
    """Mean and quantiles of a histogram in ascending order of its values."""
    upto = np.cumsum(n)
    total = int(upto[-1])
    picks = {name: int(value[np.searchsorted(upto, total * a // b, side="right")]) for name, (a, b) in QUANTILES.items()}
    return {"mean": float((value * n).sum()) / total} | picks


def spread_gc(len_bin: np.ndarray, gc_bin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """GC counts of all lengths over the bins of 0 .. 100 that their shares of the scale overlap, added up in the order of lengths and counts."""
    order = np.lexsort((gc_bin, len_bin))
    len_bin, gc_bin, n = len_bin[order], gc_bin[order], n[order]
    width = 101.0 / (len_bin + 1)
    lo, hi = gc_bin * width, (gc_bin + 1) * width
    first = np.floor(lo).astype(int)
    last = np.minimum(101, np.ceil(hi)).astype(int) - 1
    many = np.maximum(first, last) - first + 1
    row = np.repeat(np.arange(len(n)), many)
    gc = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    share = np.where(first[row] == last[row], width[row], np.where(gc == first[row], first[row] + 1 - lo[row], np.where(gc == last[row], hi[row] - last[row], 1.0)))
    out = np.zeros(101)
    np.add.at(out, gc, n[row] / width[row] * share)
    return out


@dataclass
class File:
    """The counts of one file, by family as columns a, b, c, n, s, and the rows of modules that come ready."""

    parts: dict[int, tuple[np.ndarray, ...]]
    ready: dict[int, list[dict]]
    mode: RunMode
    adapters: list[tuple[str, str]]

    def __post_init__(self):
        none = (np.zeros(0, np.int64),) * 5
        length, _, _, n, _ = self.parts.get(fused.LENGTH, none)
        order = np.argsort(length)
        self.length, self.length_n = length[order], n[order]
        self.n_reads = int(n.sum())
        self.longest = int(length.max()) if len(length) else 0
        self.groups = stats.base_groups(self.longest, self.mode.groups)
        self.starts = np.array([a for a, _ in self.groups], np.int64)
        pos, base, q, n, _ = self.parts.get(fused.CUBE, none)
        group = self._group(pos)
        self.bases = np.bincount(group * 5 + base, n, len(self.groups) * 5).astype(np.int64).reshape(-1, 5)
        has = q > 0
        self.quals = np.bincount(group[has] * 128 + q[has], n[has], len(self.groups) * 128).astype(np.int64).reshape(-1, 128)
        seen = np.flatnonzero(self.quals.sum(0))
        if len(seen) and seen[-1] > 126:
            raise ValueError("a quality character over 126")
        self.encoding = "unknown" if not len(seen) or seen[0] < 33 else "Sanger" if seen[0] < 64 else "Solexa"
        self.offset = 33 if not len(seen) or seen[0] < 64 else 64

    def _group(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, pos, side="right") - 1

    def _tag(self, group: int) -> dict:
        lo, hi = self.groups[group]
        return {"group_id": group, "tag": str(lo) if lo == hi else f"{lo}-{hi}"}

    def rows(self, module: str) -> list[dict]:
        if not self.n_reads:
            return []
        return getattr(self, f"_{module}")()

    def _basic_stats(self) -> list[dict]:
        total = int((self.length * self.length_n).sum())
        middle = quantiles(self.length, self.length_n)
        gc = 100.0 * int(self.bases[:, 1:3].sum()) / total if total else None
        return [{"n_reads": self.n_reads, "total_bases": total, "min_len": int(self.length[0]), "max_len": self.longest, "mean_len": middle["mean"], "median_len": middle["median"], "gc_pct": gc, "encoding": self.encoding}]

    def _quality_base(self) -> list[dict]:
        out = []
        for g in np.flatnonzero(self.quals.sum(1)).tolist():
            q = np.flatnonzero(self.quals[g])
            out.append(self._tag(g) | quantiles(q - self.offset, self.quals[g, q]))
        return out

    def _tile(self) -> list[dict]:
        if fused.TILE not in self.parts:
            return []
        tile, pos, _, n, s = self.parts[fused.TILE]
        key, back = np.unique(tile << 32 | self._group(pos), return_inverse=True)
        many = np.bincount(back, n)
        mean = (np.bincount(back, s) - self.offset * many) / many
        tile, group = key >> 32, key & (2**32 - 1)
        total = np.zeros(len(self.groups))
        np.add.at(total, group, mean)  # in the order of tiles
        centred = mean - total[group] / np.bincount(group, minlength=len(self.groups))[group]
        return [{"tile": t, **self._tag(g), "centered_mean": m} for t, g, m in zip(tile.tolist(), group.tolist(), centred.tolist(), strict=True)]

    def _quality_sequence(self) -> list[dict]:
        if fused.QUALITY not in self.parts:
            return []
        q, _, _, n, _ = self.parts[fused.QUALITY]
        hist = np.bincount(q, n).astype(np.int64)
        return [{"quality": i - self.offset, "n": int(hist[i])} for i in range(int(q.min()), int(q.max()) + 1)]

    def _sequence(self) -> list[dict]:
        out = []
        for g in np.flatnonzero(self.bases.sum(1)).tolist():
            a, c, t_g, t, _ = self.bases[g].tolist()
            total = a + c + t_g + t
            out.append(self._tag(g) | {f"{b}_pct": 100.0 * x / total if total else None for b, x in zip("gatc", (t_g, a, t, c), strict=True)})
        return out

    def _gc_sequence(self) -> list[dict]:
        if fused.GC not in self.parts:
            return []
        len_bin, gc_bin, _, n, _ = self.parts[fused.GC]
        return [{"gc": i, "n": x} for i, x in enumerate(spread_gc(len_bin, gc_bin, n).tolist())]

    def _n_content(self) -> list[dict]:
        return [self._tag(g) | {"n": int(self.bases[g, 4]), "n_pct": 100.0 * int(self.bases[g, 4]) / int(self.bases[g].sum())} for g in np.flatnonzero(self.bases.sum(1)).tolist()]

    def _sequence_length(self) -> list[dict]:
        hist = np.zeros(self.longest + 1, np.int64)
        hist[self.length] = self.length_n
        lo = int(self.length[0])
        return [{"length": i, "n": n} for i, n in enumerate(hist[lo:].tolist(), lo)]

    def levels(self) -> list[dict]:
        part = self.parts.get(REPORTED, self.parts.get(LEVELS))
        return [] if part is None else [{"times_seen": a, "n_keys": n} for a, n in sorted(zip(part[0].tolist(), part[3].tolist(), strict=True))]

    def _duplication(self) -> list[dict]:
        levels = self.levels()
        if not levels:
            return []
        mass, keys = [0] * len(BINS), sum(r["n_keys"] for r in levels)
        for r in levels:
            if r["times_seen"] > 0:
                mass[max(i for i, (low, _) in enumerate(BINS) if r["times_seen"] >= low)] += r["times_seen"] * r["n_keys"]
        total = max(sum(mass), 1)
        return [{"bin_no": i, "bin": label, "mass_pct": 100.0 * mass[i] / total, "dedup_pct": 100.0 * keys / total} for i, (_, label) in enumerate(BINS)]

    def _overrepresented(self) -> list[dict]:
        return self.ready.get(OVERREPRESENTED, [])

    def _kmer(self) -> list[dict]:
        return self.ready.get(ENRICHED, [])

    def _adapter(self) -> list[dict]:
        size = len(self.adapters[0][1])
        last = self.longest - size + 1 if self.longest + 1 >= size else self.longest
        groups = self.groups or [(1, 1)]
        hist = np.zeros((len(groups), len(self.adapters)), np.int64)
        if fused.ADAPTER in self.parts:
            pos, adapter, _, n, _ = self.parts[fused.ADAPTER]
            np.add.at(hist, (self._group(pos), adapter), n)
        upto = np.cumsum(hist, axis=0)
        tag = lambda i: {"group_id": i, "tag": str(groups[i][0]) if groups[i][0] == groups[i][1] else f"{groups[i][0]}-{groups[i][1]}"}
        return [tag(i) | {"adapter_id": k, "adapter": name, "cumulative_pct": 100.0 * int(upto[i, k]) / self.n_reads} for k, (name, _) in enumerate(self.adapters) for i in range(len(groups)) if groups[i][0] <= last]

    def grades(self, results: dict[str, list[dict]]) -> dict[str, str]:
        """The grade of each module in `results`. Without any base there is no statistic; such a file passes, and so does one whose headers name no tile."""
        limits, out = self.mode.graders, {}
        for module, rows in results.items():
            value: float | None = None
            known = bool(rows)
            if module == "sequence_length" and rows:
                out[module] = "fail" if self.length[0] == 0 else "warn" if len(self.length) > 1 else "pass"
                continue
            if module == "quality_base" and rows:
                both = [grade(min(r[c] for r in rows), *limits[k]) for c, k in (("median", "quality_base_median"), ("lower_quartile", "quality_base_lower"))]
                out[module] = max(both, key=["pass", "warn", "fail"].index)
                continue
            if module == "tile" and rows:
                value = max(abs(r["centered_mean"]) for r in rows)
            elif module == "quality_sequence" and rows:
                value = float(max(rows, key=lambda r: (r["n"], -r["quality"]))["quality"])
            elif module == "sequence" and rows:
                apart = lambda r: abs(r["a_pct"] + r["g_pct"] - r["t_pct"] - r["c_pct"]) if self.mode.bisulfite else max(abs(r["a_pct"] - r["t_pct"]), abs(r["c_pct"] - r["g_pct"]))
                value = max((apart(r) for r in rows if r["a_pct"] is not None), default=None)
            elif module == "gc_sequence" and rows:
                value = stats.gc_deviation(np.array([r["n"] for r in rows]))
            elif module == "n_content" and rows:
                value = max(rows, key=lambda r: (r["n"], -r["group_id"]))["n_pct"] / 100
            elif module == "duplication" and rows:
                value = rows[0]["dedup_pct"] / 100
            elif module == "overrepresented" and LEVELS in self.parts:
                times, _, _, n, _ = self.parts[LEVELS]
                total = int((times * n).sum())
                value, known = int(times.max()) / total if total else None, True
            elif module == "adapter" and rows:
                value = (int(self.parts[fused.ADAPTER][3].max()) if fused.ADAPTER in self.parts else 0) / self.n_reads
            elif module == "kmer":
                first = next((r for r in rows if r["rank"] == 1), None)
                value, known = neg_log10(first["pvalue"]) if first else 0.0, True
            out[module] = grade(value, *limits[module]) if known and module in limits else "pass"
        return out


def of_batches(batches, mode: RunMode, adapters: list[tuple[str, str]]) -> File:
    """A file from Arrow batches of (file_id, family, a, b, c, key, n, s)."""
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}
    ready: dict[int, list[dict]] = {}
    for batch in batches:
        family = batch.column(1).to_numpy()
        columns = [batch.column(i).fill_null(0).to_numpy().astype(np.int64) for i in (2, 3, 4, 6, 7)]
        for f in np.unique(family).tolist():
            own = family == f
            if f in (OVERREPRESENTED, ENRICHED):
                ready.setdefault(f, []).extend(json.loads(batch.column(5)[i].as_py()) for i in np.flatnonzero(own).tolist())
            else:
                held.setdefault(f, []).append(tuple(c[own] for c in columns))
    parts = {f: tuple(np.concatenate(x) for x in zip(*own, strict=True)) for f, own in held.items()}
    return File(parts, ready, mode, adapters)


def finished(file: File) -> tuple[dict[str, list[dict]], dict[str, str]]:
    """Rows and grades of the enabled modules, in the order of reports."""
    results = {m: file.rows(m) for m in MODULES if file.mode.on(m)}
    return results, file.grades(results)
