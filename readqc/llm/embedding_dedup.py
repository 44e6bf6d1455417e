"""Embedding near-duplicates by dual traversal of cover trees.

Unit vectors are dealt to blocks of bounded size by their nearest pivot. Each block is a cover tree: nested levels whose
radii halve; a node's covering radius is the largest distance to a vector below it. Pairs of blocks, then pairs of nodes,
are dropped when their centres are farther apart than the threshold and both radii, and taken whole when even their farthest
vectors link. What is left is compared in double precision. Blocks meet by bands, so that a block ships once for a band of others. A
band against a band gives counts and one root a vector, not its links, so that a group of copies costs rows in proportion to its size.

In data without structure (all distances near a right angle, as random directions in many dimensions have) no bound can drop
pairs of blocks, and the work is that of comparing all blocks: this is so for any exact method of this kind.

Nulls: vectors that are null, zero, or hold null or non-finite components link with nothing and are kept. Vectors link with those of
their own size, each size in a run of its own. A row with a null vec_id links with nothing and has a null component. Repeated rows are vectors
each: they count among each other's links, and rows that share the least vec_id of a component are all kept. An empty table has an empty
result. Other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readqc.llm.components import components
from readqc.llm.shared import arrow, written
from readqc.llm.vectors import block_of, deal, numbered, packed, sizes, unit_vectors, unpacked

#: Vectors of a block, radii of the levels below the root, slack for rounding.
BLOCK, RADII, SLACK = 4096, (1.0, 0.5, 0.25), 1e-7
#: Blocks of a band at most; blocks whose outlines meet at once.
BAND, OUTLINES = 8, 512
#: Pairs of vectors that are multiplied at once; vectors of a node below the root, at least, unless it holds one alone.
PAIRS, FEW = 50_000, 16
#: Edges that are held before they are made few.
EDGES = 1_000_000
COSINE = 0.9


@dataclass
class Tree:
    """Unit vectors in tree order; for each level the nodes' centres (rows), covering radii, and bounds of rows."""

    x: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def cover_tree(x: np.ndarray, radii=RADII) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """An order of the rows and the levels over it. A centre is a centre in all finer levels too (nesting), and every row of a node
    lies within the level's radius of its centre (covering)."""
    n = len(x)
    order = np.arange(n)
    bounds = np.array([0, n])
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    cuts = [bounds]
    for radius in radii:
        new_order, new_bounds = [], [0]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            left = order[a:b]
            while len(left):
                if len(left) == 1:
                    near = np.ones(1, bool)
                else:
                    near = x[left] @ x[left[0]] >= 1 - radius * radius / 2
                    near[0] = True
                new_order.append(left[near])
                many = int(near.sum())
                # the bound of a node of few vectors costs more than it saves: each is a node of its own
                new_bounds += [new_bounds[-1] + many] if many >= FEW else range(new_bounds[-1] + 1, new_bounds[-1] + many + 1)
                left = left[~near]
        order, bounds = np.concatenate(new_order), np.array(new_bounds)
        cuts.append(bounds)
    y = x[order]
    for bounds in cuts:
        centre = bounds[:-1]
        # a node's centre is its first row in this order at every level, as splitting starts with it and keeps the order
        dot = np.einsum("ij,ij->i", y, y[np.repeat(centre, np.diff(bounds))])
        far = np.minimum.reduceat(dot, centre)
        levels.append((centre, np.where(np.diff(bounds) > 1, np.sqrt(np.maximum(0, 2 - 2 * far)) + SLACK, 0.0), bounds))
    return order, levels


def _between(t: Tree, u: Tree, i: np.ndarray, j: np.ndarray, level: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of nodes of a level, of rows i of t's and j of u's nodes, that may hold a link."""
    ci, ri, _ = t.levels[level]
    cj, rj, _ = u.levels[level]
    left, right = [], []
    x = t.x[ci[i]].astype(np.float32)
    for low, high in ((-1.0, 0.0), (0.0, 0.25), (0.25, 0.5), (0.5, 1.0), (1.0, 9.0)):
        own = j[(rj[j] > low) & (rj[j] <= high)]
        if not len(own):
            continue
        most = reach + ri[i] + rj[own].max()
        least = np.where(most >= 2, -9.0, 1 - most**2 / 2 - 1e-5).astype(np.float32)
        a, b = np.nonzero(x @ u.x[cj[own]].astype(np.float32).T >= least[:, None])
        left.append(i[a])
        right.append(own[b])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _dots(t: Tree, u: Tree, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows a of t with rows b of u, in pieces."""
    out = np.empty(len(a))
    for lo in range(0, len(a), PAIRS):
        part = slice(lo, lo + PAIRS)
        out[part] = np.einsum("ij,ij->i", t.x[a[part]], u.x[b[part]])
    return out


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that edges between rows a and b lead to, for n rows."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def compact(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few edges as hold together what edges between rows a and b of n rows hold together: each row with its least."""
    label = roots(n, a, b)
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def dual(t: Tree, u: Tree, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of links of the rows of t and of u (of t alone if they are the same tree), and ends of edges that hold together what
    links. Ends are rows of t and, unless it is the same tree, rows of u numbered on from them."""
    reach = math.sqrt(2 - 2 * cosine)
    nt, nu = np.zeros(len(t.x), np.int64), np.zeros(len(u.x), np.int64)
    ends_t, ends_u = [], []
    behind = 0 if same else len(nt)
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(len(t.levels)):
        ci, ri, bi = t.levels[level]
        cj, rj, bj = u.levels[level]
        if level == 1:  # below the roots: all children of both
            i, j = _between(t, u, np.arange(len(ci)), np.arange(len(cj)), level, reach)
        d = np.sqrt(np.maximum(0, 2 - 2 * _dots(t, u, ci[i], cj[j])))
        near = d <= reach + ri[i] + rj[j] + SLACK
        i, j, d = i[near], j[near], d[near]
        inside = (d + ri[i] + rj[j] <= reach - SLACK) & (np.diff(bi)[i] + np.diff(bj)[j] > 2)
        for a, b in zip(i[inside].tolist(), j[inside].tolist(), strict=True):
            own, other = slice(bi[a], bi[a + 1]), slice(bj[b], bj[b + 1])
            nt[own] += bj[b + 1] - bj[b]
            if same:
                nt[own] -= 1 if a == b else 0
            else:
                nu[other] += bi[a + 1] - bi[a]
            ends_t += [np.arange(bi[a], bi[a + 1]), np.full(bj[b + 1] - bj[b], ci[a])]
            ends_u += [np.full(bi[a + 1] - bi[a], cj[b] + behind), np.arange(bj[b], bj[b + 1]) + behind]
        i, j = i[~inside], j[~inside]
        if not len(i):
            break
        if level + 1 < len(t.levels) and level > 0:
            down_t, down_u = np.searchsorted(t.levels[level + 1][2], bi), np.searchsorted(u.levels[level + 1][2], bj)
            many = (down_t[i + 1] - down_t[i]) * (down_u[j + 1] - down_u[j])
            pair = np.repeat(np.arange(len(i)), many)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
            wide = (down_u[j + 1] - down_u[j])[pair]
            i, j = down_t[i][pair] + k // wide, down_u[j][pair] + k % wide
    else:
        bi, bj = t.levels[-1][2], u.levels[-1][2]
        many = np.diff(bi)[i] * np.diff(bj)[j]
        lo = 0
        while lo < len(i):  # in pieces, so that memory stays bounded
            m = many[lo : lo + max(1, int(np.searchsorted(np.cumsum(many[lo:]), PAIRS * 10)))]
            pair = np.repeat(np.arange(lo, lo + len(m)), m)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(m) - m, m)
            wide = np.diff(bj)[j][pair]
            a, b = bi[i][pair] + k // wide, bj[j][pair] + k % wide
            lo += len(m)
            link = _dots(t, u, a, b) >= cosine
            a, b = a[link], b[link]
            if same:
                a, b = a[a != b], b[a != b]
            nt += np.bincount(a, minlength=len(nt))
            if not same:
                nu += np.bincount(b, minlength=len(nu))
            ends_t.append(a)
            ends_u.append(b + behind)
            if sum(map(len, ends_t)) > EDGES:
                ends_t, ends_u = ([x] for x in compact(behind + len(nu), np.concatenate(ends_t), np.concatenate(ends_u)))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return nt, nu, join(ends_t), join(ends_u)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """One row for each block: number, ids, row numbers, vectors as they came, tree, centre and radius."""

    def run(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, ids, parts = [], [], []
        for b in batches:
            row.append(b.column("row").to_numpy())
            ids.append(b.column("vec_id").to_numpy())
            parts.append(block_of(b.column("x"), size))
        row, ids, raw = np.concatenate(row), np.concatenate(ids), np.concatenate(parts)
        start = np.lexsort((row, ids))
        row, ids, raw = row[start], ids[start], raw[start]
        x = unit_vectors(raw.astype(float))
        order, levels = cover_tree(x)
        if not all(np.isfinite(r).all() for _, r, _ in levels):
            raise ValueError("a covering radius is no number, so bounds would prune what links")
        cut = [np.int64(len(levels)).tobytes()] + [np.int64(len(v)).tobytes() + v.astype(np.int64).tobytes() for _, _, v in levels]
        values = [ids[order].tobytes(), row[order].tobytes(), packed(raw[order]), b"".join(cut), np.concatenate([r for _, r, _ in levels]).tobytes(), x[order[0]].tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([group[0].as_py()], pa.int64()), *(pa.array([v], pa.binary()) for v in values), pa.array([float(levels[0][1][0])])], ["block", "ids", "rows", "x", "cuts", "radii", "centre", "radius"])

    return rows.groupBy("block").applyInArrow(run, "block long, ids binary, rows binary, x binary, cuts binary, radii binary, centre binary, radius double")


def _tree(x: bytes, cuts: bytes, radii: bytes, size: int) -> Tree:
    cut, r = np.frombuffer(cuts, np.int64), np.frombuffer(radii, np.float64)
    levels, at, done = [], 1, 0
    for _ in range(cut[0]):
        n = int(cut[at])
        bounds = cut[at + 1 : at + 1 + n]
        levels.append((bounds[:-1], r[done : done + n - 1], bounds))
        at, done = at + 1 + n, done + n - 1
    return Tree(unit_vectors(unpacked(x, size)), levels)


def near_blocks(blocks: DataFrame, total: int, size: int, reach: float) -> DataFrame:
    """(b1, b2), b1 <= b2: the pairs of blocks whose centres are no farther apart than reach and both radii. Outlines meet in pieces of OUTLINES
    blocks, so what ships is a centre for BLOCK vectors, for each piece."""

    def gather(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("block").to_numpy(), b.column("centre").to_pylist(), b.column("radius").to_numpy()) for b in batches]
        values = [np.concatenate([n for n, _, _ in held]).tobytes(), b"".join(c for _, own, _ in held for c in own), np.concatenate([r for _, _, r in held]).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([group[0].as_py()], pa.int64()), *(pa.array([v], pa.binary()) for v in values)], ["p", "n", "c", "r"])

    pieces = math.ceil(total / OUTLINES)
    outline = written(blocks.select(F.floor(F.col("block") / OUTLINES).alias("p"), "block", "centre", "radius").groupBy("p").applyInArrow(gather, "p long, n binary, c binary, r binary"), "outlines")
    ahead = outline.toDF("p1", "n1", "c1", "r1").withColumn("p2", F.explode(F.sequence("p1", F.lit(pieces - 1).cast("long"))))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n1, n2 = (np.frombuffer(row[c], np.int64) for c in ("n1", "n2"))
                c1, c2 = (np.frombuffer(row[c], np.float64).reshape(-1, size) for c in ("c1", "c2"))
                r1, r2 = (np.frombuffer(row[c], np.float64) for c in ("r1", "r2"))
                gap = np.sqrt(np.maximum(0, 2 - 2 * (c1 @ c2.T)))
                i, j = np.nonzero((gap <= reach + r1[:, None] + r2[None, :] + SLACK) & ((n1[:, None] <= n2[None, :]) | (row["p1"] != row["p2"])))
                yield pa.RecordBatch.from_arrays([pa.array(n1[i]), pa.array(n2[j])], ["b1", "b2"])

    return ahead.join(outline.toDF("p2", "n2", "c2", "r2"), "p2").select("p1", "n1", "c1", "r1", "p2", "n2", "c2", "r2").mapInArrow(run, "b1 long, b2 long")


def _links(rows: DataFrame, n: int, size: int, cosine: float) -> DataFrame:
    """(vec_id, row, n, root): the links of rows of a size, and a row, as (vec_id, row), that they lead to."""
    spark = rows.sparkSession
    dealt, total = deal(rows, n, size, BLOCK, True)
    blocks = written(_blocks(dealt, size), "blocks")
    pairs = written(near_blocks(blocks, total, size, math.sqrt(2 - 2 * cosine)), "pairs")
    # a unit of work is a band of blocks against a band: a block ships once a unit in which it has a pair, not once a pair
    band = min(BAND, max(1, int(total / math.sqrt(4 * spark.sparkContext.defaultParallelism))))
    pairs = pairs.select(F.floor(F.col("b1") / band).alias("u1"), F.floor(F.col("b2") / band).alias("u2"), "b1", "b2")
    needed = pairs.select("u1", "u2", F.explode(F.array("b1", "b2")).alias("block")).distinct().join(blocks.drop("centre", "radius"), "block")

    def compare(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        trees, start, ids, row = {}, {}, [], []
        many = 0
        for i in range(right.num_rows):
            r = {c: right.column(c)[i].as_py() for c in ("block", "ids", "rows", "x", "cuts", "radii")}
            trees[r["block"]], start[r["block"]] = _tree(r["x"], r["cuts"], r["radii"], size), many
            ids.append(np.frombuffer(r["ids"], np.int64))
            row.append(np.frombuffer(r["rows"], np.int64))
            many += len(ids[-1])
        ids, row = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, row))
        count, ends = np.zeros(many, np.int64), [np.zeros(0, np.int64)] * 2
        for b1, b2 in zip(left.column("b1").to_pylist(), left.column("b2").to_pylist(), strict=True):
            t, u = trees[b1], trees[b2]
            nt, nu, a, c = dual(t, u, cosine, b1 == b2)
            count[start[b1] : start[b1] + len(nt)] += nt
            if b1 != b2:
                count[start[b2] : start[b2] + len(nu)] += nu
            place = lambda e, k=len(nt): np.where(e < k, e + start[b1], e - k + start[b2])  # noqa: B023, E731
            ends = list(compact(many, np.concatenate([ends[0], place(a)]), np.concatenate([ends[1], place(c)])))
        label = roots(many, *ends)
        linked = np.flatnonzero(count)
        return pa.table([pa.array(x[linked]) for x in (ids, row, count, ids[label], row[label])], ["vec_id", "row", "n", "root_id", "root_row"])

    found = pairs.toDF("v1", "v2", "b1", "b2").groupBy("v1", "v2").cogroup(needed.groupBy("u1", "u2")).applyInArrow(lambda key, a, b: compare(key, a, b), "vec_id long, row long, n long, root_id long, root_row long")
    return written(found, "links")


def dedup(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row of vectors: vec_id, n_links (other vectors with that cosine or more), component_id (the least vec_id that links
    reach) and kept (whether it is that one)."""
    arrow(vectors.sparkSession)
    rows = numbered(vectors, key, vector, False)
    parts = [_links(rows.where(F.col("size") == size), n, size, cosine) for size, n in sizes(rows).items() if n > 1]  # one vector alone links with nothing
    every = rows.select("vec_id", "row")
    if not parts:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), (F.col("vec_id") == F.col("vec_id")).alias("kept"))
    found = functools.reduce(DataFrame.unionByName, parts)
    links = found.groupBy("row").agg(F.sum("n").alias("n_links"))
    # ends are (vec_id, row), so that the least end tells the least vec_id
    end = lambda a, b: F.struct(F.col(a).alias("vec_id"), F.col(b).alias("row"))
    ends = components(found.select(end("vec_id", "row").alias("u"), end("root_id", "root_row").alias("v")))
    least = F.coalesce("component", "vec_id")
    return (
        every.join(links, "row", "left")
        .join(ends.select(F.col("id.row").alias("row"), F.col("component.vec_id").alias("component")), "row", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), least.alias("component_id"), (F.col("vec_id") == least).alias("kept"))
    )
