"""The text report: a section for each module, in the order of modules, each from a few collected rows."""

from __future__ import annotations

from readqc import __version__
from readqc.config import MODULES

END = ">>END_MODULE\n"
HEADERS = {
    "basic_stats": ["Measure", "Value"],
    "quality_base": ["Base", "Mean", "Median", "Lower Quartile", "Upper Quartile", "10th Percentile", "90th Percentile"],
    "tile": ["Tile", "Base", "Mean"],
    "quality_sequence": ["Quality", "Count"],
    "sequence": ["Base", "G", "A", "T", "C"],
    "gc_sequence": ["GC Content", "Count"],
    "n_content": ["Base", "N-Count"],
    "sequence_length": ["Length", "Count"],
    "duplication": ["Duplication Level", "Percentage of total"],
    "overrepresented": ["Sequence", "Count", "Percentage", "Possible Source"],
    "kmer": ["Sequence", "Count", "PValue", "Obs/Exp Max", "Max Obs/Exp Position"],
}
#: The order of rows in a section.
ORDER = {"tile": ("tile", "group_id"), "quality_sequence": ("quality",), "gc_sequence": ("gc",), "sequence_length": ("length",), "duplication": ("bin_no",), "overrepresented": ("rank",), "kmer": ("rank",)}


def _number(x, form: str) -> str:
    return "nan" if x is None else format(x, form)


def bases(n: int) -> str:
    for size, unit in ((1e9, "G"), (1e6, "M")):
        if n >= size:
            return f"{n / size:.1f} {unit}bp"
    return f"{n / 1e3:.1f} Kbp"


def _rows(module: str, rows: list[dict], info: dict) -> list[list[str]]:
    if module == "basic_stats":
        r = rows[0]
        lengths = str(r["max_len"]) if r["min_len"] == r["max_len"] else f"{r['min_len']}-{r['max_len']}"
        pairs = [
            ("Filename", info["name"]), ("File type", info["type"]), ("Encoding", r["encoding"]), ("Total Sequences", r["n_reads"]), ("Total Bases", bases(r["total_bases"])),
            ("Sequence length", lengths), ("Mean Length", f"{r['mean_len']:.15g}"), ("Median Length", r["median_len"]), ("%GC", _number(r["gc_pct"], ".1f")),
        ]
        return [[k, str(v)] for k, v in pairs]
    if module == "quality_base":
        return [[r["tag"], f"{r['mean']:.15g}", *(str(r[q]) for q in ("median", "lower_quartile", "upper_quartile", "p10", "p90"))] for r in rows]
    if module == "tile":
        return [[str(r["tile"]), r["tag"], f"{r['centered_mean']:.15f}"] for r in rows]
    if module == "sequence":
        return [[r["tag"], *(_number(r[f"{b}_pct"], ".4f") for b in "gatc")] for r in rows]
    if module == "gc_sequence":
        return [[str(r["gc"]), str(int(r["n"] + 0.5))] for r in rows]
    if module == "n_content":
        return [[r["tag"], _number(r["n_pct"], ".6g")] for r in rows]
    if module in ("quality_sequence", "sequence_length"):
        return [[str(r["quality" if module == "quality_sequence" else "length"]), str(r["n"])] for r in rows]
    if module == "duplication":
        return [[r["bin"], f"{r['mass_pct']:.3g}"] for r in rows]
    if module == "overrepresented":
        return [[r["seq"], str(r["n"]), f"{r['pct']:.3g}", r["source"]] for r in rows]
    if module == "kmer":
        return [[r["kmer"], str(r["n"]), f"{r['pvalue']:.6g}", f"{r['obs_exp']:.6g}", str(r["pos"])] for r in rows]
    raise ValueError(module)


def section(module: str, grade: str, rows: list[dict], info: dict) -> str:
    out = [f">>{MODULES[module][0]}\t{grade}"]
    rows = sorted(rows, key=lambda r: [r[c] for c in ORDER.get(module, ("group_id",) if rows and "group_id" in rows[0] else ())])
    if module == "adapter":
        names = [n for _, n in sorted({(r["adapter_id"], r["adapter"]) for r in rows})]
        out.append("\t".join(["#Position", *names]))
        lines: dict[int, list[str]] = {}
        for r in sorted(rows, key=lambda r: (r["group_id"], r["adapter_id"])):
            lines.setdefault(r["group_id"], [r["tag"]]).append(f"{r['cumulative_pct']:.6g}")
        out += ["\t".join(x) for x in lines.values()]
    else:
        if module == "duplication" and rows:
            out.append(f"#Total Deduplicated Percentage\t{rows[0]['dedup_pct']:.6f}")
        if rows or module not in ("overrepresented", "kmer"):
            out.append("#" + "\t".join(HEADERS[module]))
        out += ["\t".join(x) for x in (_rows(module, rows, info) if rows else [])]
    return "\n".join(out) + "\n" + END


def report(results: dict[str, list[dict]], grades: dict[str, str], info: dict) -> str:
    return f"##ReadQC {__version__}\n" + "".join(section(m, grades[m], results[m], info) for m in MODULES if m in results)


def summary(grades: dict[str, str], name: str) -> str:
    return "".join(f"{grades[m].upper()}\t{MODULES[m][0]}\t{name}\n" for m in MODULES if m in grades)


def preseq(rows: list[dict]) -> str:
    return "".join(f"{r['times_seen']}\t{r['n_keys']}\n" for r in sorted(rows, key=lambda r: r["times_seen"]))
