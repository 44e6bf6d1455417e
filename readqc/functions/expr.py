"""Column expressions over reads; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = 50  #: bases of a duplicate key
GC_CAP = 250  #: longest length bin of the GC histogram


def bases(seq: Column) -> Column:
    """Bases in upper case, everything but A, C, G and T as N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def size(reads: DataFrame) -> Column:
    """The length of a read: the column `bases` where reads have it. A condition on length(seq) would be moved to where seq is made, and make it once more, for each
    time that the condition's expression holds it."""
    return F.col("bases") if "bases" in reads.columns else F.length("seq")


def some(reads: DataFrame) -> DataFrame:
    """The reads with bases."""
    return reads.where(size(reads) > 0)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(bases(seq), "ACGT", "TGCA"))


def oriented(value: Column, flag: Column, turned: Column) -> Column:
    """value, or turned where bit 16 of flag is set."""
    return F.when(flag.bitwiseAND(16) != 0, turned).otherwise(value)


def prefix(seq: Column, size: int = PREFIX) -> Column:
    # a letter's upper case may be two letters, never none
    return F.substring(bases(F.substring(seq, 1, size)), 1, size)


def gc_count(seq: Column) -> Column:
    return F.length(F.regexp_replace(F.upper(seq), "[^GC]", ""))


def gc_bin(seq: Column) -> tuple[Column, Column]:
    """(length bin, GC bin): lengths from 250 on share a bin, to which the count is scaled."""
    n = F.length(seq)
    scaled = F.floor(F.lit(GC_CAP).cast("long") * gc_count(seq) / F.when(n > 0, n)).cast("int")
    return F.least(n, F.lit(GC_CAP)), F.when(n >= GC_CAP, scaled).otherwise(gc_count(seq))


def tile_field(name: Column) -> Column:
    """Which field of a header, split at colons, names the tile; null if none does."""
    colons = F.length(name) - F.length(F.replace(name, F.lit(":"), F.lit("")))
    return F.when(colons >= 6, 4).when(colons >= 4, 2)


def tile_id(name: Column, field: Column) -> Column:
    """The leading digits of that field, or null."""
    return F.regexp_extract(F.get(F.split(name, ":"), field), "^[0-9]+", 0).try_cast("int")


def tag(first: Column, last: Column) -> Column:
    """`p` or `lo-hi` of a closed 1-based range."""
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


#: Fixed value: order of a duplicate key among equals, ascending by these digits.
KEY_ORDER = ("GTCAN", "01234")


def key_rank(seq: Column, head: int = 27) -> list[Column]:
    """Sort keys of the order in which equal counts are reported: the first 27 bases as a number of base 5, the length, the rest."""
    digits = F.translate(seq, *KEY_ORDER)
    return [F.lpad(F.substring(digits, 1, head), head, "0"), F.length(seq), F.lpad(F.substring(digits, head + 1, PREFIX - head), PREFIX - head, "0")]
