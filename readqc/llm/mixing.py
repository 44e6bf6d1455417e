"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target over its size is the number of copies that each of its documents should have on average; whole copies are sure, the
rest is a fraction. In words, a document of size a has a mass m between 0 and a. Two documents are paired: one gains what the other loses,
which is drawn so that each keeps its mass on average, until one has none or all of its words. The other carries what is left to the next pair.
So the words of a source stay what they were, but for the rounding of its last document.

Pairs are of like size: each source's documents are dealt by powers of two of their sizes and by a hash into groups of some GROUP documents, of which one is
left; the left ones are dealt again, a tree over all groups at once, until a source has some GROUP documents a power of two. Of these the
longest is paired with all shorter ones as one, then the next, so that what is left at the end is short; where the shorter ones can balance only one of two outcomes, it is taken. No group is unbounded: rows that are alike (source, doc_id, size)
are counted first and rounded in parts of PART.

Draws are hashes of the two documents, so reruns agree, whatever the partitions. Null or empty texts, and those of white space alone, have size 0 and
nothing taken. A null source is a source of its own, behind all others; '' is another. Rows of one doc_id are documents each, those alike in source and size
share their copies evenly; a null doc_id is one as any. Texts are read whole. An empty table has an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readqc.llm.ordered import numbered
from readqc.llm.shared import written

#: Weights of sources in their order, the share of all words that is mixed, and how often a source is taken at most.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Documents of a group, about; like rows of a part, at most.
GROUP, PART = 64, 4096


def words(text: Column) -> Column:
    """How many words [^\\x20\\x09-\\x0D]+ a text has; 0 for a null."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def shares(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of (source, source_size). Each round the words that full sources leave over go to the others by weight, until none is above
    `most` times its size; two sums a round come to the driver."""
    ranked = numbered(sizes, [F.col("source").isNull(), "source"], "place")
    weighed = written(ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1)), "weights")
    cap = F.col("source_size") * most
    want = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) > cap
        free, taken = weighed.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, cap))).first()
        # those that have no words are full from the start
        new = max(level, (want - (taken or 0)) / free) if free else level
        if new == level:
            break
        level = new
    return weighed.select("source", "source_size", F.least(cap.cast("double"), F.col("weight") * F.lit(level)).alias("target"))


_ITEM = ("size", "doc_id", "part", "n")
_DONE = f"array<struct<{', '.join(f'{c}:bigint' for c in _ITEM)}, took:int>>"


def _item(x: Column, mass: Column) -> Column:
    return F.struct(*(x[c].alias(c) for c in _ITEM), mass.alias("mass"))


def _done(x: Column, took: int) -> Column:
    return F.struct(*(x[c].alias(c) for c in _ITEM), F.lit(took).alias("took"))


def _pair(held: Column, x: Column, level: int) -> Column:
    """The next pair: the document that was carried and x. One is done, the other is carried on."""
    a = held["carried"]
    up = F.least(a["size"] - a["mass"], x["mass"])
    down = F.least(a["mass"], x["size"] - x["mass"])
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(level), *(v[c] for v in (a, x) for c in _ITEM)), 11) * 2.0**-53
    rise = draw * (up + down) < down
    done = (
        F.when(rise & (up == a["size"] - a["mass"]), _done(a, 1)).when(rise, _done(x, 0))
        .when(down == a["mass"], _done(a, 0)).otherwise(_done(x, 1))
    )
    carried = (
        F.when(rise & (up == a["size"] - a["mass"]), _item(x, x["mass"] - up)).when(rise, _item(a, a["mass"] + up))
        .when(down == a["mass"], _item(x, x["mass"] + down)).otherwise(_item(a, a["mass"] - down))
    )
    return F.struct(F.concat(held["done"], F.array(done)).alias("done"), carried.alias("carried"))


def _folded(items: Column, level: int) -> Column:
    """Documents, in order, as those that are done and the one that is carried at the end."""
    start = F.struct(F.array().cast(_DONE).alias("done"), items[0].alias("carried"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, lambda held, x: _pair(held, x, level))


def _level(items: DataFrame, groups: int, level: int) -> DataFrame:
    """(source, size, doc_id, part, n, mass, took): the documents of a level of the tree, of which each group leaves one without `took`."""
    scale = F.floor(F.log2("size"))
    bucket = F.pmod(F.xxhash64(F.lit(level), "doc_id", "size", "part"), F.lit(groups))
    held = items.groupBy("source", scale.alias("scale"), bucket.alias("bucket")).agg(F.sort_array(F.collect_list(F.struct(*_ITEM, "mass"))).alias("items"))
    folded = held.select("source", _folded(F.col("items"), level).alias("f"))
    out = lambda x, mass, took: F.struct(*(x[c].alias(c) for c in _ITEM), mass.alias("mass"), took.alias("took"))
    every = F.concat(F.transform("f.done", lambda x: out(x, F.lit(None).cast("double"), x["took"])), F.array(out(F.col("f.carried"), F.col("f.carried.mass"), F.lit(None).cast("int"))))
    return written(folded.select("source", F.inline(every)), f"mixed-{level}")


def _draw(x: Column, salt: int) -> Column:
    """A number from 0 to under 1 for a document."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), *(x[c] for c in _ITEM)), 11) * 2.0**-53


def _against_rest(held: Column, x: Column, level: int) -> Column:
    """The next pair of a source's last documents: x, and all shorter ones together, whose fractions rise or fall alike, as `scale * fraction + base`. x is done
    with the step, drawn by its mass where the others are done before it."""
    size, mass = x["size"], F.least(F.greatest(held["scale"] * x["mass"] + held["base"] * x["size"], F.lit(0.0)), x["size"].cast("double"))
    size_left, mass_left = held["size"] - x["size"], held["mass"] - x["mass"]
    rest = F.least(F.greatest(held["scale"] * mass_left + held["base"] * size_left, F.lit(0.0)), size_left.cast("double"))
    room = size_left - rest
    up, down = F.least(size - mass, rest), F.least(mass, room)
    # where the rest can balance only one end, that is taken
    full, none = up == size - mass, down == mass
    rise = (full & ~none) | (~(none & ~full) & (_draw(x, level) * (up + down) < down))
    now = F.when(rise, mass + up).otherwise(mass - down)
    step = F.when(rise, F.when(rest > 0, up / rest)).otherwise(F.when(room > 0, down / room))
    keep = 1 - F.least(F.coalesce(step, F.lit(0.0)), F.lit(1.0))
    base = held["base"] * keep + F.when(rise, 0.0).otherwise(1 - keep)
    took = (_draw(x, level + 1) * size < now).cast("int")
    done = F.struct(*(x[c].alias(c) for c in _ITEM), took.alias("took"))
    return F.struct(F.concat(held["done"], F.array(done)).alias("done"), size_left.alias("size"), mass_left.alias("mass"), (held["scale"] * keep).alias("scale"), base.alias("base"))


def _last(items: DataFrame, level: int) -> DataFrame:
    """The same with `took` for all: each source's documents that are left, some GROUP a power of two, from the longest to the shortest."""
    held = items.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(*_ITEM, "mass")), asc=False).alias("items"), F.sum("size").alias("size"))
    start = F.struct(F.array().cast(_DONE).alias("done"), F.col("size").alias("size"), F.aggregate("items", F.lit(0.0), lambda total, x: total + x["mass"]).alias("mass"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("base"))
    return held.select("source", F.inline(F.aggregate("items", start, lambda h, x: _against_rest(h, x, level))["done"]))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target and taken, the words that the mix takes of it, repeats counted."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"))
    alike = written(rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("many")), "sizes")
    sources = written(shares(alike.groupBy("source").agg(F.sum(F.col("size") * F.col("many")).alias("source_size")), weights, share, most).withColumnRenamed("source", "name"), "shares")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    of = lambda df: df.join(sources, F.col("source").eqNullSafe(F.col("name")))

    parts = alike.select("source", "doc_id", "size", "many", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(many - 1) div {PART}"))).alias("part"))
    parts = parts.select("source", "doc_id", "size", "part", F.least(F.lit(PART).cast("long"), F.col("many") - F.col("part") * PART).alias("n"))
    wanted = F.col("n") * rate
    fraction = wanted - F.floor(wanted)
    items = written(of(parts).select("source", *_ITEM, F.when((F.col("size") > 0) & (fraction > 0), fraction * F.col("size")).alias("mass")), "fractions")

    left, done, level = items.where("mass IS NOT NULL"), [items.where("mass IS NULL").select("source", *_ITEM, F.lit(0).alias("took"))], 0
    groups = left.count()
    while groups > 0:
        groups, level = -(-groups // GROUP), level + 1
        table = _level(left, groups, level)
        done.append(table.where("took IS NOT NULL").drop("mass"))
        left = table.where("took IS NULL").drop("took")
        if groups <= GROUP:
            break
    done.append(_last(left, level + 1))
    units = of(functools.reduce(DataFrame.unionByName, done)).withColumn("units", F.floor(wanted) + F.col("took"))
    # what like rows have together is dealt evenly: the first ones take one more
    each = units.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("t"))
    copies = F.expr("units div n") + (F.col("t") < F.expr("units % n")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))
