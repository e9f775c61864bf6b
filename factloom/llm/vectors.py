"""What the operators on embeddings share: clean rows, and their numbers as matrices inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is not null nor empty and all its entries are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def dimension(vectors: DataFrame, vector: str) -> int:
    """The most frequent length of the usable vectors, the larger of two as frequent ones; 0 where there is none."""
    n = F.size(vector).alias("n")
    top = vectors.groupBy(n).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return top.n if top else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls, all of one length, as float64 rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A matrix as a list column."""
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Arrow batches as tables of ``rows`` rows; the last may be shorter."""
    held, n = [], 0
    for batch in batches:
        while n + batch.num_rows >= rows:
            cut = rows - n
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            batch, held, n = batch.slice(cut), [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
