"""A slow model of the per-read counts in plain Python, as an oracle for the operators."""

from collections import Counter


def clean(seq):
    return "".join(b if b in "ACGT" else "N" for b in seq.upper())


def counts(reads):
    """reads: (seq, qual or None) pairs."""
    out = {k: Counter() for k in ("cube", "length", "gc", "quality", "prefix")}
    for seq, qual in reads:
        out["length"][len(seq)] += 1
        if not seq:
            continue
        s = clean(seq)
        for i, b in enumerate(s):
            out["cube"][(i + 1, b, ord(qual[i]) if qual else None)] += 1
        gc = sum(b in "GC" for b in s)
        n = len(s)
        out["gc"][(min(n, 250), gc if n < 250 else 250 * gc // n)] += 1
        if qual:
            out["quality"][sum(map(ord, qual)) // n] += 1
        out["prefix"][s[:50]] += 1
    return out
