"""The prefix trie of conversations, as a Cartesian tree over the LCP array of the sorted conversations.

Each conversation is a sequence of turns, of which a key of 16 bytes stands for role and text. Equal sequences are counted as one. Sequences are
sorted by their first CHUNK turns; where different ones agree on all of these, by the next CHUNK, so that a long conversation is never one row. What
a sequence shares with the one before it, its LCP, comes from the two alone.

For each place of the LCP array the nearest smaller values on both sides are found in blocks: inside a block by a stack, beyond it by the
blocks' minima (BLOCKS numbers at most, whatever the input) and a look into the one block that they name, once for each block and value. Places with
one LCP between the same two smaller values are one node: they merge, and their number tells its children. Depths between a node and its parent, where nothing branches, are
expanded from the turns of the node's first sequence. A node is an interval of sorted sequences; its members, leaves and saved tokens are differences of
running sums, its smallest member a minimum over part of two blocks and whole ones between.

Nulls: rows with a null conversation are left out; a null turn comes first, a null role or text is ''. Rows of one turn number are turns each, in the
order of their keys. A conversation may have one turn or any number; texts of any length are read whole. An empty table has an empty result, without a root.
Other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readqc.llm.ordered import block_width, numbered, running
from readqc.llm.shared import arrow, partitions, written

#: Turns that are sorted by at once; turns of a stretch of a conversation; rows of a block at least.
CHUNK, STRETCH, BLOCK = 1024, 1024, 4096
#: How conversations are rebuilt: they come in families of so many, and begin with up to so many turns of the family's first.
FAMILY, HEADS = 20, 4

_NONE = np.iinfo(np.int64).max


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, k, w): the turns of each conversation, numbered from 1, with key and words; as a written table."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(plain(role)).cast("string"), F.lit(":"), plain(role), plain(text)).cast("binary")))
    slim = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), key.alias("k"), F.regexp_count(plain(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w"))
    placed = numbered(slim, ["conv_id", F.col("turn").asc_nulls_first(), "k"], "at")
    first = placed.groupBy("conv_id").agg(F.min("at").alias("first"))
    return written(placed.join(first, "conv_id").select("conv_id", (F.col("at") - F.col("first") + 1).alias("pos"), "k", "w"), "turns")


def rebuilt(own: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of all conversations, and (conv_id, d, k, w) of their turns when the first h turns are those of the family's first conversation."""
    h = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % heads
    convs = own.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = written(convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h("conv_id").alias("h")), "conversations")
    lent = convs.select("conv_id", "base", "h").join(own.where(F.col("pos") < heads).select(F.col("conv_id").alias("base"), F.col("pos").alias("d"), "k", "w"), "base").where("d <= h")
    took = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left").select("conv_id", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("took"))
    kept = own.join(took, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("took")).alias("d"), "k", "w")
    return convs.select("conv_id"), written(lent.select("conv_id", "d", "k", "w").unionByName(kept), "rebuilt")


def _shared(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common at their start."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same)).cast("long")


def ordered_sequences(seqs: DataFrame, own: DataFrame, longest: int) -> DataFrame:
    """(c, i, lcp): place and LCP (-1 for the first) of the sequences of conversations c; own: (c, d, k). A round for each CHUNK turns that two different sequences share."""
    items, done, number = seqs.select("c", F.lit(0).cast("long").alias("g"), F.lit(-1).cast("long").alias("before")), [], 0
    while True:
        lo = CHUNK * number
        keys = own.where((F.col("d") > lo) & (F.col("d") <= lo + CHUNK)).groupBy("c").agg(F.sort_array(F.collect_list(F.struct("d", "k"))).getField("k").alias("keys"))
        rows = items.join(keys, "c", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<binary>")))
        placed = numbered(rows, ["g", "keys", "c"], "q")
        if number:
            placed = placed.join(placed.groupBy("g").agg(F.min("q").alias("q0")), "g")
        else:
            placed = placed.withColumn("q0", F.lit(0).cast("long"))
        # a row next to the one before it, which may lie in the block before
        block = F.floor(F.col("q") / BLOCK)
        near = placed.withColumn("block", F.explode(F.when(F.col("q") % BLOCK == BLOCK - 1, F.array(block, block + 1)).otherwise(F.array(block))))
        lcp = F.when(F.col("q") == F.col("q0"), F.col("before")).otherwise(lo + _shared(F.col("keys"), F.col("ahead")))
        near = near.withColumn("ahead", F.lag("keys").over(Window.partitionBy("block").orderBy("q"))).where(F.col("block") == block)
        placed = written(near.select("c", "g", "keys", (F.col("g") + F.col("q") - F.col("q0")).alias("i"), lcp.alias("lcp")), "placed")
        if longest <= lo + CHUNK:
            done.append(placed)
            break
        alike = placed.where(F.size("keys") == CHUNK).groupBy("g", "keys").agg(F.min("i").alias("start"), F.min_by("lcp", "i").alias("before"), F.count("*").alias("many"))
        alike = written(alike.where("many > 1").drop("many"), "alike")
        done.append(placed.join(alike, ["g", "keys"], "left_anti"))
        items, number = placed.join(alike, ["g", "keys"]).select("c", F.col("start").alias("g"), "before"), number + 1
        if alike.isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, (df.select("c", "i", "lcp") for df in done))


def nearest_smaller(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one on the left, and on the right, with a smaller value; -1 and len(a) where there is none."""
    left, right = np.full(len(a), -1), np.full(len(a), len(a))
    values, stack = a.tolist(), []
    for j, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = j
        if stack:
            left[j] = left[stack[-1]] if values[stack[-1]] == v else stack[-1]
        stack.append(j)
    return left, right


class Minima:
    """Least values of ranges of an array."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        while 2 ** len(self.levels) <= len(x):
            half = 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of x[lo:hi], each of one place at least."""
        out = np.empty(len(lo), np.int64)
        level = np.frexp(hi - lo)[1] - 1
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(self.levels[k][lo[own]], self.levels[k][hi[own] - 2**k])
        return out


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), strict=True)


def spans(places: DataFrame, m: int) -> tuple[DataFrame, np.ndarray, int]:
    """(i, lcp, p, r, low): for each place the nearest smaller LCP on both sides (m behind the last), and the smallest c between, from p on, where one block holds
    all of it. With the smallest c of each block, and the width of a block."""
    width = block_width(m, BLOCK)

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, a, c = (x.to_numpy() for x in pa.Table.from_batches(list(batches)).select(["i", "lcp", "c"]).columns)
        order = np.argsort(i)
        a, c = a[order], c[order]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([a.tobytes()]), pa.array([c.tobytes()]), pa.array([a.min()]), pa.array([c.min()])], ["block", "a", "c", "least", "low"])

    blocks = places.withColumn("block", F.floor(F.col("i") / width)).select("block", "i", "lcp", "c")
    blocks = written(blocks.groupBy("block").applyInArrow(pack, "block long, a binary, c binary, least long, low long"), "blocks")
    heads = blocks.select("block", "least", "low").orderBy("block").collect()  # BLOCKS rows at most
    least, low = (np.array([r[c] for r in heads], np.int64) for c in ("least", "low"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b, data in _columns(batch, "block", "a"):
                a = np.frombuffer(data, np.int64)
                for side, way in (("l", a), ("r", a[::-1])):
                    for v in np.unique(way[way == np.minimum.accumulate(way)]).tolist():
                        there = np.flatnonzero(least[:b] < v)[-1:] if side == "l" else b + 1 + np.flatnonzero(least[b + 1 :] < v)[:1]
                        out += [(b, side, v, int(t)) for t in there]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["block", "side", "value", "target"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b, data, asked in _columns(batch, "block", "a", "asked"):
                a = np.frombuffer(data, np.int64)
                for x in asked:
                    found = np.flatnonzero(a < x["value"])
                    out.append((b, x["side"], x["value"], b * width + int(found[-1] if x["side"] == "l" else found[0])))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["target", "side", "value", "at"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, data, ids, told in _columns(batch, "block", "a", "c", "told"):
                a, c, start = np.frombuffer(data, np.int64), np.frombuffer(ids, np.int64), b * width
                left, right = nearest_smaller(a)
                p, r = start + left, start + right
                beyond = {(x["side"], x["value"]): x["at"] for x in told or []}
                for k in np.flatnonzero(left < 0).tolist():
                    p[k] = beyond.get(("l", int(a[k])), -1)
                for k in np.flatnonzero(right == len(a)).tolist():
                    r[k] = beyond.get(("r", int(a[k])), m)
                inside = (p >= start) & (r <= start + len(a))
                low = np.full(len(a), _NONE)
                if inside.any():
                    low[inside] = Minima(c).of(p[inside] - start, r[inside] - start)
                i = start + np.arange(len(a))
                for lo in range(0, len(a), 50_000):
                    own = slice(lo, lo + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(i[own]), pa.array(a[own]), pa.array(p[own]), pa.array(r[own]), pa.array(low[own], mask=~inside[own])], ["i", "lcp", "p", "r", "low"])

    asked = written(blocks.select("block", "a").mapInArrow(ask, "block long, side string, value long, target long"), "asked")
    by_target = asked.select("target", "side", "value").distinct().groupBy(F.col("target").alias("block")).agg(F.collect_list(F.struct("side", "value")).alias("asked"))
    answers = blocks.select("block", "a").join(by_target, "block").mapInArrow(answer, "target long, side string, value long, at long")
    told = asked.join(answers, ["target", "side", "value"]).groupBy("block").agg(F.collect_list(F.struct("side", "value", "at")).alias("told"))
    found = blocks.select("block", "a", "c").join(told, "block", "left").mapInArrow(finish, "i long, lcp long, p long, r long, low long")
    return written(found, "spans"), low, width


def _below(nodes: DataFrame, value: Column, of, name: str, longest: int) -> DataFrame:
    """nodes with `name`: of (min or sum) a value over the nodes of the same chain i from this depth down. By stretches of STRETCH depths, which are then added up."""
    stretch = F.floor(F.col("d") / STRETCH)
    nodes = nodes.withColumn("stretch", stretch).withColumn("value", value)
    down = Window.partitionBy("i", "stretch").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = nodes.withColumn(name, of("value").over(down))
    if longest >= STRETCH:
        whole = nodes.groupBy("i", "stretch").agg(of("value").alias("value"))
        deeper = Window.partitionBy("i").orderBy(F.col("stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
        carry = whole.select("i", "stretch", of("value").over(deeper).alias("carry")).where("carry IS NOT NULL")
        out = out.join(carry, ["i", "stretch"], "left")
        both = F.coalesce(name, "carry") if of is F.min else F.col(name) + F.coalesce("carry", F.lit(0))
        out = out.withColumn(name, both).drop("carry")
    return out.drop("stretch", "value")


def digests(members: DataFrame) -> DataFrame:
    """(c, sha): the SHA-256 of the ids of each group c, ascending, in decimal, joined by commas. Ids are joined in sorted pieces first, which then pass through one
    hash as a stream, so a group of any size needs the memory of a piece."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(c):
                continue
            cut = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            text = [",".join(map(str, part.tolist())) for part in np.split(ids, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c[cut]), pa.array(ids[cut]), pa.array(text)], ["c", "first", "ids"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        out: list[tuple[int, str]] = []
        frame = lambda: pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["c", "sha"])
        for batch in batches:
            for c, text in _columns(batch, "c", "ids"):
                if c != now:
                    if now is not None:
                        out.append((now, state.hexdigest()))
                    now, state = c, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            if len(out) >= 10_000:
                yield frame()
                out = []
        if now is not None:
            out.append((now, state.hexdigest()))
        yield frame()

    pieces = written(members.orderBy("c", "conv_id").select("c", "conv_id").mapInArrow(join, "c long, first long, ids string"), "ids")
    return pieces.repartition(partitions(pieces), "c").sortWithinPartitions("c", "first").select("c", "ids").mapInArrow(stream, "c long, sha string")


def trie(own: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of the turns (conv_id, d, k, w) of conversations (conv_id), of which some may have none: (conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256)."""
    spark = own.sparkSession
    arrow(spark)
    # turns carry their depth, so the exclusive or of their hashes tells sequences apart
    sums = own.groupBy("conv_id").agg(F.bit_xor(F.xxhash64("d", "k")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "d", "k")).alias("h2"), F.count("*").alias("len"))
    known = written(convs.join(sums, "conv_id", "left").na.fill(0, ["h1", "h2", "len"]), "sequences")
    seqs = written(known.groupBy("h1", "h2", "len").agg(F.min("conv_id").alias("c"), F.count("*").alias("copies")), "distinct")
    m, longest = seqs.agg(F.count("*"), F.max("len")).first()
    if not m:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    of_first = written(own.join(seqs.select(F.col("c").alias("conv_id")), "conv_id", "left_semi").withColumnRenamed("conv_id", "c"), "first")
    places = written(ordered_sequences(seqs, of_first, longest).join(seqs.select("c", "len", "copies"), "c"), "places")
    found, lows, width = spans(places, m)
    merged = written(found.where("i > 0").groupBy("p", F.col("lcp").alias("l")).agg(F.count("*").alias("joins"), F.max("r").alias("r"), F.min("low").alias("low")), "merged")

    # a sequence is a leaf unless another one goes on from it, which makes it a node of its own length
    inner = merged.select(F.col("p").alias("i"), F.col("l").alias("len"), F.lit(0).alias("leaf"))
    leaves = places.join(inner, ["i", "len"], "left").withColumn("leaf", F.coalesce("leaf", F.lit(1)).cast("long"))
    within = Window.partitionBy("block").orderBy("i")
    ends = leaves.withColumn("block", F.floor(F.col("i") / width)).withColumns({"low_to": F.min("c").over(within.rowsBetween(Window.unboundedPreceding, 0)), "low_from": F.min("c").over(within.rowsBetween(0, Window.unboundedFollowing))})
    at = written(running(ends.drop("block"), "i", width, {"copies": "upto", "leaf": "leaves_upto"}), "sums")

    @F.pandas_udf("long")
    def between(first: pd.Series, last: pd.Series) -> pd.Series:
        lo, hi = first.to_numpy() + 1, last.to_numpy()
        out = np.full(len(lo), _NONE)
        some = lo < hi
        if some.any():
            out[some] = Minima(lows).of(lo[some], hi[some])
        return pd.Series(out)

    a = at.select(F.col("i").alias("p"), "copies", "leaf", F.col("upto").alias("upto_p"), F.col("leaves_upto").alias("leaves_p"), "low_from")
    b = at.select((F.col("i") + 1).alias("r"), F.col("upto").alias("upto_r"), F.col("leaves_upto").alias("leaves_r"), "low_to")
    apart = between(F.floor(F.col("p") / width), F.floor((F.col("r") - 1) / width))
    nodes_at = merged.join(a, "p").join(b, "r").select(
        "p", "l", "r", "joins", F.coalesce("low", F.least("low_from", "low_to", apart)).alias("low"), (F.col("upto_r") - F.col("upto_p") + F.col("copies")).alias("n"), (F.col("leaves_r") - F.col("leaves_p") + F.col("leaf")).alias("leaves")
    )
    nodes_at = written(nodes_at, "branches")

    # the chain of a sequence: the depths at which it is the first
    chain = of_first.join(places, "c").where("d > lcp").select("i", "d", "w", "c", "len", "copies")
    root = places.where("i = 0").select("i", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("w"), "c", "len", "copies")
    marks = nodes_at.select(F.col("p").alias("i"), F.col("l").alias("d"), F.struct("l", "r", "n", "leaves", "low").alias("mark"), "joins")
    above = nodes_at.select(F.col("p").alias("i"), (F.col("l") + 1).alias("d"), F.col("low").alias("above"))
    above = above.unionByName(found.where("i > 0").join(nodes_at.select("p", F.col("l").alias("lcp"), F.col("low").alias("above")), ["p", "lcp"]).select("i", (F.col("lcp") + 1).alias("d"), "above"))
    nodes = chain.unionByName(root).join(marks, ["i", "d"], "left").join(above, ["i", "d"], "left")
    nodes = _below(nodes, F.col("mark"), F.min, "whole", longest)
    nodes = nodes.withColumns({"n": F.coalesce("whole.n", "copies"), "low": F.coalesce("whole.low", "c"), "leaves": F.coalesce("whole.leaves", F.lit(1).cast("long"))})
    nodes = written(_below(nodes, (F.col("n") - 1) * F.col("w"), F.sum, "saved", longest), "nodes")

    # what the nodes of later sequences of an interval save
    totals = nodes.where("d > 0").groupBy("i").agg(F.max("saved").alias("own"))  # the topmost node of a chain has all of it
    totals = places.select("i").join(totals, "i", "left").select("i", F.coalesce("own", F.lit(0)).alias("own"))
    upto = written(running(totals, "i", width, {"own": "upto"}), "saved")
    later = nodes_at.select("p", "l", "r").join(upto.select(F.col("i").alias("p"), F.col("upto").alias("upto_p")), "p").join(upto.select((F.col("i") + 1).alias("r"), F.col("upto").alias("upto_r")), "r")
    later = later.select(F.col("p").alias("i"), "l", (F.col("upto_r") - F.col("upto_p")).alias("later"))
    members = known.join(seqs.select("h1", "h2", "len", "c"), ["h1", "h2", "len"]).select("c", "conv_id")
    sha = digests(members).join(places.select("c", "i", F.col("len").alias("d")), "c").select("i", "d", "sha")
    none = hashlib.sha256(b"").hexdigest()
    longer = (F.col("len") > F.col("d")).cast("long")
    return nodes.withColumn("l", F.col("whole.l")).join(later, ["i", "l"], "left").join(sha, ["i", "d"], "left").select(
        F.col("low").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") > 0, F.coalesce("above", "low")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.coalesce(F.col("joins") + longer, longer).alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") + F.coalesce("later", F.lit(0))).alias("saved_tokens"), F.coalesce("sha", F.lit(none)).alias("ends_sha256"),
    )


def prefix_trie(rows: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """The trie of the rebuilt conversations of a table."""
    convs, own = rebuilt(turns(rows), family, heads)
    return trie(own, convs)


def prefix_trie_sql(table: str = "conversations", family: int = FAMILY, heads: int = HEADS) -> str:
    """The same in DuckDB's SQL: every prefix of every conversation, and every pair of a prefix with what it begins with. The table of the CRC and its steps are
    written out, as there is no function."""
    return rf"""
WITH RECURSIVE steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
t AS (SELECT conv_id AS c, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM {table} WHERE conv_id IS NOT NULL),
own AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS pos, k, w FROM t),
convs AS (SELECT c, c - c % {family} AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % {heads} AS h FROM (SELECT DISTINCT c FROM own), steps),
lent AS (SELECT convs.c, pos AS d, k, w FROM convs JOIN own ON own.c = base WHERE pos <= h),
took AS (SELECT convs.c, h, count(lent.c) AS took FROM convs LEFT JOIN lent USING (c) GROUP BY ALL),
turns AS (SELECT * FROM lent UNION ALL SELECT own.c, pos - h + took, k, w FROM own JOIN took USING (c) WHERE pos > h),
seqs AS (SELECT c, list(k ORDER BY d) FILTER (k IS NOT NULL) AS ks, list(w ORDER BY d) FILTER (k IS NOT NULL) AS ws FROM convs LEFT JOIN turns USING (c) GROUP BY c),
every AS (SELECT c, coalesce(len(ks), 0) AS n, coalesce(ks, []) AS ks, coalesce(ws, []) AS ws, unnest(range(0, coalesce(len(ks), 0) + 1)) AS d FROM seqs),
prefixes AS (SELECT c, n, d, md5(array_to_string(ks[1:d], ',')) AS id, CASE WHEN d > 0 THEN md5(array_to_string(ks[1:d - 1], ',')) END AS parent, coalesce(ws[d], 0) AS w FROM every),
nodes AS (SELECT d, id, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM prefixes GROUP BY d, id),
children AS (SELECT d - 1 AS d, parent AS id, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (SELECT a.d, a.id, sum((v.n_convs - 1) * v.w) AS saved_tokens, count(*) FILTER (c.n_children IS NULL) AS n_leaves
  FROM nodes v JOIN prefixes x ON x.c = v.conv_id AND x.d <= v.d JOIN nodes a ON a.d = x.d AND a.id = x.id LEFT JOIN children c ON c.d = v.d AND c.id = v.id GROUP BY a.d, a.id)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.id = n.parent LEFT JOIN children c ON c.d = n.d AND c.id = n.id JOIN below b ON b.d = n.d AND b.id = n.id"""
