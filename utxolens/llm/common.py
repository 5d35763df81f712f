"""Pieces that several training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import components as connected_components
from ..session import forget, keep, prepare, shared_dir, shuffle_tasks

__all__ = ["connected_components", "forget", "keep", "matrix", "new_path", "shuffle_tasks", "sorted_groups", "spanning_forest", "table", "text_slices"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, whatever store its path names."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def text_slices(batches, n_bytes: int = 1 << 20, text: int | str = 1):
    """Arrow batches cut to about n_bytes of their text column each.

    Python objects of a slice are freed before the next, so memory follows the slice, not the batch.
    """
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size + 64) // n_bytes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def spanning_forest(n: int, i, j):
    """Rows of n that have a smaller one in their component under the links (i, j), and that component's smallest row."""
    import numpy as np

    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            break
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def sorted_groups(batches, keys: list[str]):
    """Groups of consecutive rows with equal keys, as Arrow tables; rows must come sorted by keys.

    One group is held at a time, so whoever deals out the groups bounds their size.
    """
    import numpy as np
    import pyarrow as pa

    held = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            this = key[:, a].tolist()
            if held and this != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
            last = this
    if held:
        yield pa.Table.from_batches(held)


def matrix(column, dim: int):
    """A list column of equal lengths as a float64 matrix."""
    import numpy as np
    import pyarrow as pa

    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(c.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
