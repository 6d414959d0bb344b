"""Stored vectors as matrices: which rows have one, and how wide it is."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def real(vector: Column) -> Column:
    """Whether a vector is there, has entries, and all of them are finite numbers."""
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(sound, F.lit(False))


def width(df: DataFrame, vector: str) -> int:
    """The number of entries that most of the real vectors have, the larger of two such; 0 if there
    are none."""
    sizes = df.where(real(F.col(vector))).groupBy(F.size(vector).alias("entries")).count()
    found = sizes.agg(F.max_by("entries", F.struct("count", "entries"))).first()[0]
    return found or 0


def matrix(column: pa.Array, entries: int) -> np.ndarray:
    """A column of real vectors of one width, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, entries)
