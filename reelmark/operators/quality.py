"""Declared constraints as reports of the rows that break them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmark.plans.joins import lookup_join
from reelmark.schemas import TableSpec


def dq_unique(rows: DataFrame, keys: list[str] | tuple[str, ...]) -> DataFrame:
    """Keys held by more than one row. Keys with a null never clash."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return rows.where(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def dq_not_null(rows: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    """Null count of each column that may hold none: (column_name, null_count)."""
    counts = rows.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns])
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c), F.lit(0)).alias("null_count"))
            for c in columns
        ]
    )
    return counts.select(F.explode(pairs).alias("_p")).select("_p.column_name", "_p.null_count")


def dq_foreign_key(
    rows: DataFrame, column: str, parent: DataFrame, parent_column: str, salt_on: list[str] | None = None
) -> DataFrame:
    """Values of ``column`` with no parent row, and how many rows hold each."""
    # Grouped first: the join then sees each value once.
    values = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
    keys = parent.select(F.col(parent_column).alias(column)).distinct()
    return lookup_join(values, keys, column, "left_anti", salt_on=salt_on)


def dq_max_length(rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Per limited column: rows longer than the limit and the longest length seen."""
    counts = rows.agg(
        *[F.sum((F.length(c) > limit).cast("long")).alias(f"{c}_over") for c, limit in limits.items()],
        *[F.max(F.length(c)).alias(f"{c}_longest") for c in limits],
    )
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(limit).alias("max_length"),
                F.coalesce(F.col(f"{c}_over"), F.lit(0)).alias("too_long"),
                F.col(f"{c}_longest").cast("long").alias("longest"),
            )
            for c, limit in limits.items()
        ]
    )
    return counts.select(F.explode(pairs).alias("_p")).select("_p.*")


def require_valid(rows: DataFrame, spec: TableSpec, name: str) -> None:
    """Fail on a broken NOT NULL, length or key, as the stores with declared constraints do."""
    if spec.not_null:
        broken = dq_not_null(rows, spec.not_null).where("null_count > 0").limit(5).collect()
        if broken:
            raise ValueError(f"{name}: nulls in {[r.column_name for r in broken]}")
    if spec.max_length:
        broken = dq_max_length(rows, spec.max_length).where("too_long > 0").collect()  # a row a column
        if broken:
            raise ValueError(f"{name}: too long {[(r.column_name, r.longest) for r in broken]}")
    for keys in spec.unique:
        clash = dq_unique(rows, keys).limit(1).collect()
        if clash:
            raise ValueError(f"{name}: duplicate key {keys}: {clash[0].asDict()}")
