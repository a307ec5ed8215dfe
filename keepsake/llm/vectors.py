"""What the operators on embedding columns share: which vectors count, sorted streams cut into runs, matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors with components that are all numbers and finite; false for null and empty ones and for any null, NaN or infinity in them."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(F.transform(vector, lambda x: x.cast("double")), odd), F.lit(False))


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of batches sorted by their first columns, run by run of equal ``keys`` columns; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    at: tuple = ()
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        edges = [0, *cuts.tolist(), b.num_rows]
        for start, end in zip(edges, edges[1:], strict=False):
            key = tuple(c[start].item() for c in columns)
            if held and key != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = key
            held.append(b.slice(start, end - start))
    if held:
        yield at, pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """A column of lists of ``size`` numbers as rows of doubles."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
