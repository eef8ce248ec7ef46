"""Rows of vectors between Spark and numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def doubles(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Each row's vector in double precision; None if it is null, empty, zero or not finite throughout."""
    column = column.cast(pa.list_(pa.float64()))
    flat = column.values
    values, holes = flat.to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
    ends, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    for k, ok in enumerate(valid):
        at, to = ends[k], ends[k + 1]
        x = values[at:to]
        yield x if ok and to > at and not holes[at:to].any() and np.isfinite(x).all() and x.any() else None


def stacked(column: pa.Array, width: int) -> np.ndarray:
    """Rows of packed doubles as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)
