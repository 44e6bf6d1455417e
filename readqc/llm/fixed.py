"""Arrays of fixed length summed over all partitions: count sketches and filters of a size that doesn't grow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Pieces in which arrays are added up: one for so many partitions, within bounds, so that an adder reads a bounded share.
PARTITIONS, LEAST, MOST = 16, 32, 1024


def summed(df: DataFrame, count: Callable[[Iterator[pa.RecordBatch], np.ndarray], None], length: int, sent: type = np.uint32, final: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """The sum over partitions of a uint32 array of `length` that `count` fills from a partition's batches. Added up in
    pieces by an exchange, to which a partition's counts go as `sent` (larger ones as its largest number); `final` turns a piece's
    sums into what comes to the driver. The driver gets one array, whatever the number of partitions."""
    pieces = min(max(df.rdd.getNumPartitions() // PARTITIONS, LEAST), MOST)
    step = -(-length // pieces)
    final = final or (lambda x: x)
    made = final(np.zeros(1, np.uint32)).dtype

    def fill(batches):
        out = np.zeros(step * pieces, np.uint32)
        count(batches, out)
        # cut piece by piece, so that no second array of the whole length is held
        cut = [np.minimum(out[i * step : (i + 1) * step], np.iinfo(sent).max).astype(sent).tobytes() for i in range(pieces)]
        del out
        yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array(cut, pa.binary())], ["piece", "data"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(step, np.uint64)
        for batch in batches:
            for x in batch.column(1):
                total += np.frombuffer(x.as_buffer(), sent)
        total = final(np.minimum(total, 2**32 - 1).astype(np.uint32))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["piece", "data"])

    kind = "piece int, data binary"
    out = np.zeros((pieces, step), made)
    for r in df.mapInArrow(fill, kind).groupBy("piece").applyInArrow(add, kind).collect():
        out[r["piece"]] = np.frombuffer(r["data"], made)
    return out.reshape(-1)[:length]
