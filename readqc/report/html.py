"""The HTML report: a plot or table for each module; the plotting library comes from its public address when the page is opened."""

from __future__ import annotations

import html
import json
import math

import numpy as np

from readqc.config import MODULES
from readqc.functions.stats import smoothed, theoretical_gc
from readqc.report import text

PLOTLY = "https://cdn.plot.ly/plotly-2.35.2.min.js"
COLOURS = {"pass": "#2e8b57", "warn": "#d98e04", "fail": "#c0392b"}


def _line(x, y, name: str) -> dict:
    return {"x": list(x), "y": list(y), "name": name, "mode": "lines"}


def traces(module: str, rows: list[dict], graders: dict) -> tuple[list[dict], dict]:
    """Plot data and layout of a module."""
    tags = [r.get("tag") for r in rows]
    if module == "quality_base":
        warn, fail = graders["quality_base_median"]
        colour = lambda r: COLOURS["fail" if r["median"] < fail else "warn" if r["median"] < warn else "pass"]
        boxes = [{"type": "box", "name": r["tag"], "x": [r["tag"]], "q1": [r["lower_quartile"]], "median": [r["median"]], "q3": [r["upper_quartile"]], "lowerfence": [r["p10"]], "upperfence": [r["p90"]], "mean": [r["mean"]], "marker": {"color": colour(r)}} for r in rows]
        return boxes, {"showlegend": False, "xaxis": {"title": "Position"}, "yaxis": {"title": "Phred quality"}}
    if module == "tile":
        ids, places = sorted({r["tile"] for r in rows}), sorted({(r["group_id"], r["tag"]) for r in rows})
        at = {(r["tile"], r["group_id"]): r["centered_mean"] for r in rows}
        return [{"type": "heatmap", "x": [t for _, t in places], "y": [str(i) for i in ids], "z": [[at.get((i, g)) for g, _ in places] for i in ids]}], {"xaxis": {"title": "Position"}, "yaxis": {"title": "Tile", "type": "category"}}
    if module == "sequence":
        return [_line(tags, [r[f"{b}_pct"] for r in rows], b.upper()) for b in "acgt"], {"yaxis": {"title": "% of bases"}, "xaxis": {"title": "Position"}}
    if module == "n_content":
        return [_line(tags, [r["n_pct"] for r in rows], "N")], {"yaxis": {"title": "% of bases"}, "xaxis": {"title": "Position"}}
    if module == "gc_sequence":
        hist = [r["n"] for r in rows]
        return [_line(range(101), smoothed(hist), "reads"), _line(range(101), theoretical_gc(np.array(hist)).tolist(), "normal curve")], {"xaxis": {"title": "% GC"}, "yaxis": {"title": "Reads"}}
    if module in ("quality_sequence", "sequence_length"):
        key = "quality" if module == "quality_sequence" else "length"
        return [{"type": "bar", "x": [r[key] for r in rows], "y": [r["n"] for r in rows]}], {"xaxis": {"title": key}, "yaxis": {"title": "Reads"}}
    if module == "duplication":
        return [_line([r["bin"] for r in rows], [r["mass_pct"] for r in rows], "% of reads")], {"xaxis": {"title": "Times seen", "type": "category"}, "yaxis": {"title": "%"}}
    if module == "adapter":
        names = sorted({(r["adapter_id"], r["adapter"]) for r in rows})
        return [_line([r["tag"] for r in rows if r["adapter_id"] == i], [r["cumulative_pct"] for r in rows if r["adapter_id"] == i], n) for i, n in names], {"xaxis": {"title": "Position"}, "yaxis": {"title": "% of reads"}}
    if module == "kmer":
        return [{"type": "bar", "x": [f"{r['kmer']} at {r['pos']}" for r in rows], "y": [math.log2(r["obs_exp"]) for r in rows]}], {"yaxis": {"title": "log2 observed / expected"}}
    return [], {}


def _table(header: list[str], rows: list[list[str]]) -> str:
    line = lambda cells, kind: "<tr>" + "".join(f"<{kind}>{html.escape(str(c))}</{kind}>" for c in cells) + "</tr>"
    return f"<table>{line(header, 'th')}{''.join(line(r, 'td') for r in rows)}</table>"


def report(results: dict[str, list[dict]], grades: dict[str, str], info: dict, graders: dict, levels: list[dict] | None = None) -> str:
    parts = []
    for module in MODULES:
        if module not in results:
            continue
        order = text.ORDER.get(module, ("group_id",))
        rows = sorted(results[module], key=lambda r: [r[c] for c in order]) if module not in ("basic_stats",) else results[module]
        data, layout = traces(module, rows, graders)
        if module == "duplication" and levels:
            total = sum(r["n_keys"] for r in levels) or 1
            from readqc.operators.duplicates import BINS

            share = [0.0] * len(BINS)
            for r in levels:
                if r["times_seen"] > 0:
                    share[max(i for i, (low, _) in enumerate(BINS) if r["times_seen"] >= low)] += 100 * r["n_keys"] / total
            data.append(_line([b for _, b in BINS], share, "% of distinct"))
        if module in ("basic_stats", "overrepresented"):
            body = _table(text.HEADERS[module], text._rows(module, rows, info)) if rows else "<p>None.</p>"
        elif not rows:
            body = "<p>None.</p>"
        else:
            body = f'<div id="{module}" class="plot"></div><script>Plotly.newPlot("{module}", {json.dumps(data).replace("</", "<\\/")}, {json.dumps(layout)});</script>'
        parts.append(f'<section><h2><span style="color:{COLOURS[grades[module]]}">[{grades[module]}]</span> {MODULES[module][0]}</h2>{body}</section>')
    style = "body{font-family:sans-serif;max-width:60rem;margin:auto}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2rem .6rem}.plot{height:26rem}"
    began = f'<p>Begun {html.escape(info["began"])}</p>' if info.get("began") else ""
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(info["name"])}</title><script src="{PLOTLY}"></script><style>{style}</style></head><body><h1>{html.escape(info["name"])}</h1>{began}{"".join(parts)}</body></html>\n'
