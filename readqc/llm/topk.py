"""Exact top-k inner products by branch and bound over ball trees.

Rows are dealt to shards of bounded size by what lies near; each shard is a ball tree in one packed row. Queries form blocks, dealt alike.
A block first searches the shard of the largest bound at its middle, which seeds the kth score of its queries everywhere. With
that score and the balls of all shards (a centre and a radius each, in pieces of bounded size) those shards are left out, before
anything of them ships, that hold nothing for any query of the block. A unit of work is a block against some of the rest: for each
shard, tree nodes come off a heap by the largest upper bound q c + |q| r of the queries still active there, and a query leaves a node
whose bound is below its current kth score. That score carries over from shard to shard. The k best of each unit meet in a last ranking
of k rows a unit and query. Products that doubles may round are taken in Python integers; a scaled component or a score beyond 64 bits is
an error.

Nulls: vectors that are null or hold null or non-finite components take no part; nor do rows with a null vec_id. Vectors meet those
of their own size, each size in a run of its own. Ties go to the smaller vec_id. Rows that share a query's vec_id are its own. Repeated rows
count each: every row of them is a candidate and may fill a rank. Rows of queries that share a vec_id are one query, and a candidate's
score is its best with any of them. An empty table has an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readqc.llm.shared import arrow, written
from readqc.llm.vectors import block_of, deal, numbered, packed, sizes, unpacked

#: Rows of a shard and of a block of queries, shards of a unit of work, rows of a leaf, balls of a piece.
SHARD, BLOCK, UNIT, LEAF, BALLS = 16_384, 4_096, 8, 256, 1_024
SCALE = 1024
#: Up to this product of norms every sum in an inner product is exact in doubles; a part is left for the rounding of the norms.
EXACT = 2**53 * 0.999


def ball_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows, and nodes (first row, last row + 1, left child, right child; -1 at a leaf) over it."""
    order = np.arange(len(x))
    nodes: list[list[int]] = []
    todo = [(0, len(x), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        me = len(nodes)
        nodes.append([a, b, -1, -1])
        if parent >= 0:
            nodes[parent][2 + side] = me
        if b - a <= leaf:
            continue
        own = x[order[a:b]]
        far = own[np.argmax(((own - own.mean(0)) ** 2).sum(1))]
        other = own[np.argmax(((own - far) ** 2).sum(1))]
        along = own @ (other - far)
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(along, half)]
        todo += [(a, a + half, me, 0), (a + half, b, me, 1)]
    return order, np.array(nodes, np.int32).reshape(-1, 4)


def scaled(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), whole values in doubles."""
    x = np.floor(scale * x)
    if (np.abs(x) >= 2.0**63).any():
        raise ValueError("a scaled component is beyond 64 bits")
    return x


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """x, of whole values, as Python integers."""
    return x.astype(np.int64).astype(object)


def upper_bound(queries: np.ndarray, norm: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """What no inner product of a query (row) with a vector of a ball (column) is above; a little is added for rounding."""
    return queries @ centre.T + norm[:, None] * radius + 1e-6 * (1 + norm[:, None] * (radius + np.sqrt((centre**2).sum(1))))


class Best:
    """The k best (score, id, row) of each query so far. kth is what a score must reach: from `kth` on, the kth of them."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int, kth: np.ndarray | None = None):
        self.queries, self.ids, self.k = queries, ids, k
        self.norm = np.sqrt((queries**2).sum(1))
        none = np.zeros(0, np.int64)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(none, none, none)] * len(ids)
        self.kth = np.full(len(ids), -np.inf) if kth is None else kth.copy()

    def take(self, q: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        s, i, r = (np.concatenate(x) for x in zip(self.found[q], (score, ids, rows), strict=True))
        order = np.lexsort((r, i, -s))[: self.k]
        self.found[q] = s[order], i[order], r[order]
        if len(order) == self.k:
            self.kth[q] = max(self.kth[q], s[order[-1]])

    def search(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> None:
        """Takes in a shard: rows in the order of its tree."""
        if not len(x):
            return
        centre = np.array([x[a:b].mean(0) for a, b, _, _ in nodes.tolist()])
        radius = np.array([math.sqrt(((x[a:b] - c) ** 2).sum(1).max()) for (a, b, _, _), c in zip(nodes.tolist(), centre, strict=True)])
        bound = upper_bound(self.queries, self.norm, centre, radius)
        size = np.sqrt((x**2).sum(1))
        everyone = np.arange(len(self.ids))
        heap = [(-bound[:, 0].max(), 0, everyone)]
        while heap:
            _, node, active = heapq.heappop(heap)
            active = active[bound[active, node] >= self.kth[active]]
            if not len(active):
                continue
            a, b, left, right = nodes[node].tolist()
            if left >= 0:
                for child in (left, right):
                    heapq.heappush(heap, (-bound[active, child].max(), child, active))
                continue
            if self.norm[active].max() * size[a:b].max() < EXACT:
                score, kth = self.queries[active] @ x[a:b].T, self.kth[active]
            else:  # kth is a rounded integer: one step less is no more than it
                score, kth = whole_numbers(self.queries[active]) @ whole_numbers(x[a:b]).T, np.nextafter(self.kth[active], -np.inf)
            good = (score >= kth[:, None]).astype(bool) & (ids[a:b][None, :] != self.ids[active][:, None])
            for r in np.flatnonzero(good.any(1)).tolist():
                self.take(int(active[r]), score[r, good[r]].astype(np.int64), ids[a:b][good[r]], rows[a:b][good[r]])

    def table(self) -> pa.Table:
        many = [len(s) for s, _, _ in self.found]
        score, ids, rows = (np.concatenate(x) if self.found else np.zeros(0, np.int64) for x in (zip(*self.found, strict=True) if self.found else ((), (), ())))
        return pa.table([pa.array(x, pa.int64()) for x in (np.repeat(self.ids, many), ids, rows, score)], ["query_id", "vec_id", "row", "score"])


FOUND = "query_id long, vec_id long, row long, score long"


def _pack(rows: DataFrame, key: str, size: int, scale: float, tree: bool) -> DataFrame:
    """One row for each key: ids, row numbers, components and tree nodes as bytes, with the ball that holds all of them."""

    def run(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, ids, parts = [], [], []
        for b in batches:
            row.append(b.column("row").to_numpy())
            ids.append(b.column("vec_id").to_numpy())
            parts.append(block_of(b.column("x"), size))
        row, ids, x = np.concatenate(row), np.concatenate(ids), np.concatenate(parts)
        whole = scaled(x.astype(float), scale)
        order, nodes = ball_tree(whole) if tree else (np.lexsort((row, ids)), np.zeros((0, 4), np.int32))
        centre = whole.mean(0)
        values = [ids[order].tobytes(), row[order].tobytes(), packed(x[order]), nodes.tobytes(), centre.tobytes()]
        radius = math.sqrt(((whole - centre) ** 2).sum(1).max())
        yield pa.RecordBatch.from_arrays([pa.array([group[0].as_py()], pa.int64()), *(pa.array([v], pa.binary()) for v in values), pa.array([radius])], [key, "ids", "rows", "x", "nodes", "centre", "radius"])

    return rows.groupBy(key).applyInArrow(run, f"{key} long, ids binary, rows binary, x binary, nodes binary, centre binary, radius double")


def _balls(trees: DataFrame) -> DataFrame:
    """(piece, shards, centres, radii): the balls of BALLS shards in a row."""

    def run(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("shard").to_numpy(), b.column("centre").to_pylist(), b.column("radius").to_numpy()) for b in batches]
        values = [np.concatenate([s for s, _, _ in held]).tobytes(), b"".join(c for _, own, _ in held for c in own), np.concatenate([r for _, _, r in held]).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([group[0].as_py()], pa.int64()), *(pa.array([v], pa.binary()) for v in values)], ["piece", "shards", "centres", "radii"])

    return trees.select(F.floor(F.col("shard") / BALLS).alias("piece"), "shard", "centre", "radius").groupBy("piece").applyInArrow(run, "piece long, shards binary, centres binary, radii binary")


def _found(rows: DataFrame, n: int, asked: DataFrame, m: int, size: int, k: int, scale: float) -> DataFrame:
    """(query_id, vec_id, row, score): the k best rows of a size of each unit of work."""
    spark = rows.sparkSession
    dealt, shards = deal(rows, n, size, SHARD, False)
    trees = written(_pack(dealt.withColumnRenamed("block", "shard"), "shard", size, scale, True), "trees")
    dealt, blocks = deal(asked, m, size, BLOCK, False)
    sets = written(_pack(dealt, "block", size, scale, False).drop("nodes", "radius"), "queries")
    balls = written(_balls(trees), "balls")
    pieces = math.ceil(shards / BALLS)
    # the stated queries meet the outline of all rows in blocks: a ball for SHARD rows
    outlined = lambda left: left.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long")))).join(balls, "piece")

    def read(shard: dict, wanted: tuple[str, ...]) -> list[np.ndarray]:
        kinds = {"shards": np.int64, "centres": np.float64, "radii": np.float64}
        return [np.frombuffer(shard[c], kinds[c]) for c in wanted]

    def nearest(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                number, centres, radii = read(r, ("shards", "centres", "radii"))
                q = np.frombuffer(r["centre"], np.float64)[None, :]
                bound = upper_bound(q, np.sqrt((q**2).sum(1)), centres.reshape(-1, size), radii)[0]
                out.append((r["block"], int(number[np.argmax(bound)]), float(bound.max())))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["block", "shard", "bound"])

    start = outlined(sets.select("block", "centre")).mapInArrow(nearest, "block long, shard long, bound double").groupBy("block").agg(F.max_by("shard", F.struct("bound", "shard")).alias("shard"))

    def best_of(r: dict, kth: np.ndarray | None = None) -> Best:
        return Best(scaled(unpacked(r["x"], size), scale), np.frombuffer(r["ids"], np.int64), k, kth)

    def take(best: Best, t: dict) -> None:
        best.search(scaled(unpacked(t["x"], size), scale), np.frombuffer(t["ids"], np.int64), np.frombuffer(t["rows"], np.int64), np.frombuffer(t["nodes"], np.int32).reshape(-1, 4))

    def seed(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                best = best_of({"x": r["qx"], "ids": r["qids"]})
                take(best, r)
                t = best.table()
                values = [best.kth.tobytes(), *(t.column(c).to_numpy().tobytes() for c in ("query_id", "vec_id", "row", "score"))]
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([r["shard"]], pa.int64()), *(pa.array([v], pa.binary()) for v in values)], names)

    names = ["block", "shard", "kth", "query_id", "vec_id", "row", "score"]
    first = sets.select("block", F.col("x").alias("qx"), F.col("ids").alias("qids")).join(start, "block").join(trees.select("shard", "ids", "rows", "x", "nodes"), "shard")
    seeded = written(first.select("block", "shard", "qx", "qids", "ids", "rows", "x", "nodes").mapInArrow(seed, "block long, shard long, kth binary, query_id binary, vec_id binary, row binary, score binary"), "seeded")

    def flat(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r[c], np.int64)) for c in names[3:]], names[3:])

    out = seeded.select(*names[3:]).mapInArrow(flat, FOUND)
    if shards == 1:
        return out

    def open_shards(batches):
        for batch in batches:
            for r in batch.to_pylist():
                number, centres, radii = read(r, ("shards", "centres", "radii"))
                best = best_of(r, np.frombuffer(r["kth"], np.float64))
                some = np.zeros(len(number), bool)
                for lo in range(0, len(best.ids), 512):
                    part = slice(lo, lo + 512)
                    some |= (upper_bound(best.queries[part], best.norm[part], centres.reshape(-1, size), radii) >= best.kth[part, None]).any(0)
                left = number[some & (number != r["first"])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(left), r["block"])), pa.array(left)], ["block", "shard"])

    ready = sets.select("block", "ids", "x").join(seeded.select("block", "kth", F.col("shard").alias("first")), "block")
    pairs = written(outlined(ready).mapInArrow(open_shards, "block long, shard long"), "open")
    units = max(math.ceil(shards / UNIT), min(shards, math.ceil(spark.sparkContext.defaultParallelism / blocks)))
    pairs = pairs.withColumn("unit", F.pmod("shard", F.lit(units)))
    right = pairs.join(trees.select("shard", "ids", "rows", "x", "nodes"), "shard")
    left = pairs.select("block", "unit").distinct().join(ready.drop("first"), "block").withColumnsRenamed({"block": "b", "unit": "u"})

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.to_pylist()[0]
        best = best_of(r, np.frombuffer(r["kth"], np.float64))
        for t in range(right.num_rows):
            take(best, {c: right.column(c)[t].as_py() for c in ("ids", "rows", "x", "nodes")})
        return best.table()

    return out.unionByName(left.groupBy("b", "u").cogroup(right.groupBy("block", "unit")).applyInArrow(lambda key, a, b: run(key, a, b), FOUND))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id of queries its k best rows of vectors by inner product of
    floor(scale * component)."""
    spark = vectors.sparkSession
    arrow(spark)
    rows, asked = numbered(vectors, key, vector, True), numbered(queries, key, vector, True)
    asked = asked.dropDuplicates(["vec_id", "x"])
    many, few = sizes(rows), sizes(asked)
    if not (both := sorted(many.keys() & few.keys())):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = functools.reduce(DataFrame.unionByName, [_found(rows.where(F.col("size") == s), many[s], asked.where(F.col("size") == s), few[s], s, k, scale) for s in both])
    if few_ids_repeat(asked):
        found = found.groupBy("query_id", "vec_id", "row").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id", "row"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def few_ids_repeat(asked: DataFrame) -> bool:
    """Whether different vectors of queries share an id."""
    return bool(asked.where("size > 0").groupBy("vec_id").count().where("count > 1").take(1))


def search_sql(table: str = "embeddings", k: int = 10, scale: int = SCALE) -> str:
    """The query over every hundredth vec_id, in DuckDB's SQL."""
    return f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e FROM {table}
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, v.r, max(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])))::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0 AND len(q.e) > 0 GROUP BY ALL),
k AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id, r)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= {k}"""
