"""Vector columns as matrices: which rows take part, and how they are read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def clean(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id long, vector array<double>) of the usable rows."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.empty((0, 0))


def ints(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)
