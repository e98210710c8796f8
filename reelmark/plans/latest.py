"""Last writer wins, as an aggregation so that a hot key is combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep, per key, the row with the greatest ``order`` value (a column or struct, unique per key)."""
    rest = [name for name in rows.columns if name not in (*keys, order)]
    latest = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(1).alias("_one")), F.col(order)).alias("_row")
    )
    return latest.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])
