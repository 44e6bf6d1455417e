"""Reading vector columns, and dealing vectors to blocks of bounded size by what lies near."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readqc.llm.shared import written

#: Pivots at most, their components at most, and how many of them are looked at first where there are more than DIRECT.
PIVOTS, COMPONENTS, TOPS, DIRECT = 4096, 1 << 21, 64, 256


def numbered(df: DataFrame, key: str, vector: str, zero: bool) -> DataFrame:
    """(row, vec_id, x, size) as a written table: every row of df under a number of its own, with its vector if that takes part, else null and size 0.
    Out are null and empty vectors, those with null or non-finite components, rows with a null id and, unless `zero`, vectors of zeros. Singles
    stay singles, so that they ship as such."""
    kind = "float" if df.schema[vector].dataType == T.ArrayType(T.FloatType(), df.schema[vector].dataType.containsNull) else "double"
    x, vec_id = F.col(vector).cast(f"array<{kind}>"), F.col(key).cast("long")
    good = vec_id.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    if not zero:
        good = good & F.exists(x, lambda v: v != 0)
    rows = df.select(F.monotonically_increasing_id().alias("row"), vec_id.alias("vec_id"), F.when(good, x).alias("x"))
    return written(rows.withColumn("size", F.when(F.col("x").isNotNull(), F.size("x")).otherwise(0)), "vectors")


def sizes(rows: DataFrame) -> dict[int, int]:
    """How many vectors of a numbered table have each number of components: a row for each size comes to the driver."""
    return {r["size"]: r["count"] for r in rows.where("size > 0").groupBy("size").count().orderBy("size").collect()}


def block_of(column: pa.Array, size: int) -> np.ndarray:
    """The vectors of a list column as rows."""
    return column.flatten().to_numpy().reshape(len(column), size)


def unit_vectors(x: np.ndarray) -> np.ndarray:
    """Rows, none of zeros, as unit vectors. They are scaled by a power of two first, which is exact, so that squares neither vanish nor overflow."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.sqrt((x**2).sum(1))[:, None]


def nearest(x: np.ndarray, pivots: np.ndarray, half: np.ndarray, tops: int, owner: np.ndarray) -> np.ndarray:
    """For each row its nearest pivot: of the first `tops`, then of those that this one owns."""
    first = np.argmax(x @ pivots[:tops].T - half[:tops], axis=1)
    if tops == len(pivots):
        return first
    out = np.empty_like(first)
    for t in np.unique(first).tolist():
        mine, own = first == t, np.flatnonzero(owner == t)
        out[mine] = own[np.argmax(x[mine] @ pivots[own].T - half[own], axis=1)]
    return out


def deal(rows: DataFrame, n: int, size: int, block: int, unit: bool) -> tuple[DataFrame, int]:
    """(row, vec_id, x, block) of the n rows of a size, and the number of blocks. Rows of one pivot share a run of blocks, among which a hash
    deals them, so that a block holds about `block` rows however many lie together. Pivots grow with n up to PIVOTS; they and their counts are
    what comes to the driver. With `unit`, only directions count."""
    spark = rows.sparkSession
    want = min(PIVOTS, max(1, n // block), max(DIRECT, COMPONENTS // size))
    if want == 1:
        total = max(1, math.ceil(n / block))
        return rows.select("row", "vec_id", "x", F.pmod(F.xxhash64("row"), F.lit(total)).alias("block")), total
    pivots = np.array([r["x"] for r in rows.orderBy(F.xxhash64("row"), "row").limit(want).collect()], float)
    if unit:
        pivots = unit_vectors(pivots)
    half = np.zeros(len(pivots)) if unit else (pivots**2).sum(1) / 2
    tops = len(pivots) if len(pivots) <= DIRECT else TOPS
    owner = nearest(pivots, pivots[:tops], half[:tops], tops, np.arange(tops))
    sent = spark.sparkContext.broadcast((pivots, half, tops, owner))

    def assign(batches):
        for b in batches:
            x = block_of(b.column(2), size).astype(float)
            cell = nearest(unit_vectors(x) if unit and len(x) else x, *sent.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int64))], ["row", "vec_id", "x", "cell"])

    kind = rows.schema["x"].dataType.simpleString()
    dealt = written(rows.select("row", "vec_id", "x").mapInArrow(assign, f"row long, vec_id long, x {kind}, cell long"), "cells")
    parts = {r["cell"]: math.ceil(r["count"] / block) for r in dealt.groupBy("cell").count().collect()}
    first, total = {}, 0
    for c in sorted(parts):
        first[c], total = total, total + parts[c]
    table = spark.createDataFrame([(c, first[c], parts[c]) for c in sorted(parts)], "cell long, first long, parts long")  # a row a pivot
    return dealt.join(F.broadcast(table), "cell").select("row", "vec_id", "x", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).alias("block")), total


def packed(x: np.ndarray) -> bytes:
    """Rows as bytes: a mark of the kind of number, then the numbers."""
    return (b"f" if x.dtype == np.float32 else b"d") + np.ascontiguousarray(x).tobytes()


def unpacked(data: bytes, size: int) -> np.ndarray:
    """Rows as doubles."""
    return np.frombuffer(data, np.float32 if data[:1] == b"f" else np.float64, offset=1).reshape(-1, size).astype(float)
