"""Vectors as written tables and numpy blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmark.session import cut_lineage


def sound(vector: str) -> Column:
    """Not null, not empty, and every component a finite number."""
    return F.coalesce(
        (F.size(vector) > 0)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))),
        F.lit(False),
    )


def rows(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """Written once: row (unique), id, x, ok. Repeated ids stay separate rows."""
    return cut_lineage(
        df.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), F.col(vector).alias("x")
        ).withColumn("ok", sound("x"))
    )


def matrix(column: pa.ChunkedArray | pa.Array, dtype=np.float64) -> np.ndarray:
    """A column of equally long lists as rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(n, -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
