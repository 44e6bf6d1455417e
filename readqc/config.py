"""Which modules run, how they are graded, and the limits file that changes both."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

#: Module labels in the order of reports, their titles, and default warn and fail thresholds.
MODULES = {
    "basic_stats": ("Basic Statistics", None),
    "quality_base": ("Per base sequence quality", None),
    "tile": ("Per tile sequence quality", (5.0, 10.0)),
    "quality_sequence": ("Per sequence quality scores", (27.0, 20.0)),
    "sequence": ("Per base sequence content", (10.0, 20.0)),
    "gc_sequence": ("Per sequence GC content", (15.0, 30.0)),
    "n_content": ("Per base N content", (0.05, 0.20)),
    "sequence_length": ("Sequence Length Distribution", (1.0, 1.0)),
    "duplication": ("Sequence Duplication Levels", (0.70, 0.50)),
    "overrepresented": ("Overrepresented sequences", (0.10, 1.00)),
    "adapter": ("Adapter Content", (0.05, 0.10)),
    "kmer": ("Kmer Content", (2.0, 5.0)),
}
#: Further thresholds that a module has besides its own label.
EXTRA = {"quality_base_median": (25.0, 20.0), "quality_base_lower": (10.0, 5.0)}
#: Labels whose limits a file gives in percent while the statistic is a fraction.
PERCENT = {"n_content", "duplication", "overrepresented", "adapter"}


def default_graders() -> dict[str, tuple[float, float]]:
    return {k: v for k, (_, v) in MODULES.items() if v} | EXTRA


@dataclass(frozen=True)
class RunMode:
    """Switches of a run. All modules run but kmers; groups, bisulfite, preseq and original duplicates are off."""

    enabled: frozenset[str] = frozenset(m for m in MODULES if m != "kmer")
    groups: bool = False
    bisulfite: bool = False
    preseq: bool = False
    original_duplicates: bool = False
    graders: dict[str, tuple[float, float]] = field(default_factory=default_graders)

    def __post_init__(self):
        if self.preseq and self.original_duplicates:
            raise ValueError("preseq needs all duplicates counted, so it excludes original duplicates")
        if unknown := self.enabled - MODULES.keys():
            raise ValueError(f"no such modules: {sorted(unknown)}")

    def on(self, module: str) -> bool:
        return module in self.enabled

    def switched(self, **modules: bool | None) -> RunMode:
        """With modules on (True), off (False) or as they are (None)."""
        enabled = set(self.enabled)
        for name, on in modules.items():
            if on is not None:
                (enabled.add if on else enabled.discard)(name)
        return replace(self, enabled=frozenset(enabled))


def parse_limits(lines: Iterable[str], mode: RunMode | None = None) -> RunMode:
    """A limits file: lines of label, `ignore`, `warn` or `error`, and a number; # opens a comment. What a file does not name keeps its
    value. Percent labels are divided by 100."""
    mode = mode or RunMode()
    graders, switches = dict(mode.graders), {}
    for number, line in enumerate(lines, 1):
        tokens = line.partition("#")[0].split()
        if not tokens:
            continue
        if len(tokens) != 3:
            raise ValueError(f"line {number}: label, parameter and value are needed, found {line.strip()!r}")
        label, param, value = tokens
        try:
            x = float(value)
        except ValueError:
            raise ValueError(f"line {number}: {value!r} is not a number") from None
        if param == "ignore":
            if label in MODULES:
                switches[label] = x == 0
            elif label not in graders:
                raise ValueError(f"line {number}: no such module {label!r}")
        elif param in ("warn", "error"):
            if label not in graders:
                raise ValueError(f"line {number}: no such limit {label!r}")
            x = x / 100 if label in PERCENT else x
            warn, fail = graders[label]
            graders[label] = (x, fail) if param == "warn" else (warn, x)
        else:
            raise ValueError(f"line {number}: no such parameter {param!r}")
    return replace(mode.switched(**switches), graders=graders)


def grade(value: float | None, warn: float, fail: float) -> str:
    """pass, warn or fail: ascending where warn < fail, else descending. A missing value fails when ascending, passes when
    descending."""
    if warn < fail:
        if value is None or value != value:
            return "fail"
        return "pass" if value < warn else "warn" if value < fail else "fail"
    if value is None or value != value:
        return "pass"
    return "fail" if value < fail else "warn" if value < warn else "pass"
