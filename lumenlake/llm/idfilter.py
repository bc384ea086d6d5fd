"""A bitmap of ids that keeps texts out of a shuffle when a join cannot need them.

Its size follows the number of ids between fixed bounds, so what is broadcast is at most
``MOST_BITS / 8`` bytes; a full bitmap lets more rows pass and never loses one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
SLOT = "slot_"


def slot(bits: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(bits)).cast("long").alias(SLOT)


def bitmap(ids: DataFrame, col: str) -> tuple[int, object]:
    """Number of bits and a broadcast of them; at most MOST_BITS / 64 pre-aggregated rows reach the driver."""
    n = ids.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * n).bit_length()))
    words = (
        ids.select(slot(bits, F.col(col)))
        .groupBy(F.shiftright(SLOT, 6).alias("w"))
        .agg(F.expr(f"bit_or(shiftleft(1L, cast({SLOT} & 63 AS int))) AS b"))
    )
    out = np.zeros(bits // 64, np.int64)
    got = words.toArrow()
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return bits, ids.sparkSession.sparkContext.broadcast(out.tobytes())


def passing(bits_: object, kernel: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: ``kernel`` over the rows whose slot is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bits_.value, np.uint64)
        for batch in batches:
            at = batch.column(batch.schema.get_field_index(SLOT)).to_numpy(zero_copy_only=False).astype(np.uint64)
            hit = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
            if hit.any():
                yield kernel(batch.filter(pa.array(hit.astype(bool))))

    return run
