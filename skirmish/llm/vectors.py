"""Vectors as whole numbers, in the form that the exact vector operators take them.

Defined results: a vector takes no part if it is null, holds a null or non-finite
component, or one whose whole number is 2^62 or more in size. Shorter vectors than
the longest count as filled up with zeros. Ids may be null or repeat: each row is a
vector of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a batch that is worked on at a time.
ROWS = 4096
_LOW = (1 << 32) - 1


def whole(df: DataFrame, scale: int, vec_id: str = "vec_id", embedding: str = "embedding", label: str | None = None) -> DataFrame:
    """(vec_id, label, v): floor(``scale`` x component) of the vectors that take part; ``label`` is null if none is named."""
    scaled = F.transform(F.col(embedding), lambda c: c.cast("double") * F.lit(float(scale)))
    fits = F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float(1 << 62))))
    taken = df.where(F.col(embedding).isNotNull() & F.coalesce(fits, F.lit(False)))
    kept = F.lit(None).cast("int") if label is None else F.col(label)
    return taken.select(F.col(vec_id).cast("long").alias("vec_id"), kept.alias("label"), F.transform(scaled, lambda c: F.floor(c)).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of whole numbers, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def rows_at_a_time(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows, the last of fewer."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows - size)
            held.append(part)
            size += part.num_rows
            at += part.num_rows
            if size == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def halves(values: Iterable[int]) -> tuple[pa.Array, pa.Array]:
    """Whole numbers of any size as (high, low): high x 2^32 + low. Sums of halves are halves of sums."""
    values = [int(v) for v in values]
    return pa.array([v >> 32 for v in values], pa.int64()), pa.array([v & _LOW for v in values], pa.int64())


def joined(high: int, low: int) -> int:
    return (high << 32) + low


def exact_sums(partial: DataFrame, *keys: str) -> dict[tuple, int]:
    """Sums of the halves in ``partial`` (keys, high, low) by key, on the driver: as many as there are keys, which are places in a vector."""
    wide = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]
    return {tuple(r[k] for k in keys): joined(int(r["high"]), int(r["low"])) for r in partial.groupBy(*keys).agg(*wide).collect()}


def spans(bound: int) -> type:
    """The numbers in which results below ``bound`` are exact."""
    return np.int64 if bound < 1 << 62 else object
