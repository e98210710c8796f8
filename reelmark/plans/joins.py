"""Joining a large, possibly skewed, frame to a lookup with one row per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from reelmark.session import scratch_path

NULL_SALTS = 1 << 20
BROADCAST_BYTES = 16 << 20  # most that a lookup may measure to be sent to every task


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: str | list[str],
    how: str = "left",
    *,
    salt_on: list[str | Column] | None = None,
) -> DataFrame:
    """Join ``facts`` to ``lookup`` on equal ``on`` columns.

    Nothing is broadcast on an estimate: under `session.JOINS` Spark broadcasts the lookup only if what it
    shuffled measures under the limit. Keys that own a large share of ``facts`` are left to Spark's
    skew-join splitting, which has no ceiling and repeats only the lookup rows of a split partition.
    Null keys match nothing and are spread by a hash of ``salt_on`` (default: all columns of the facts).
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported lookup join: {how}")
    keys = [on] if isinstance(on, str) else list(on)
    spread = F.xxhash64(*(salt_on or [F.col(f"`{name}`") for name in facts.columns]))
    has_null = reduce(lambda a, b: a | b, [F.col(f"`{key}`").isNull() for key in keys])
    salt = F.when(has_null, F.pmod(spread, F.lit(NULL_SALTS))).otherwise(0).cast("int")
    return facts.withColumn("_salt", salt).join(lookup.withColumn("_salt", F.lit(0)), [*keys, "_salt"], how).drop("_salt")


def measured(lookup: DataFrame) -> tuple[DataFrame, int]:
    """The rows, written once, and their size in memory as counted while writing: text, numbers and overhead of each row."""
    path = scratch_path(lookup.sparkSession, "lookup")
    size = F.octet_length(F.to_json(F.struct("*"))) + 24 * len(lookup.columns) + 64
    seen = Observation("lookup-size")
    lookup.observe(seen, F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes")).write.parquet(path)
    return lookup.sparkSession.read.schema(lookup.schema).parquet(path), seen.get["bytes"]


def measured_join(
    facts: DataFrame, lookup: DataFrame, on: str | list[str], how: str = "left", *, salt_on: list[str | Column] | None = None,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """As `lookup_join`, for a lookup that is small as a rule: where it measures under ``limit``, the facts stay where they are."""
    kept, size = measured(lookup)
    if size <= limit:
        return facts.join(F.broadcast(kept), on, how)
    return lookup_join(facts, kept, on, how, salt_on=salt_on)


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join on ``on`` columns where null equals null; ``on`` columns come from the left."""
    named = right.select(*[F.col(f"`{c}`").alias(f"_right_{c}" if c in on else c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`_right_{c}`")) for c in on])
    return left.join(named, same, how).drop(*[f"_right_{c}" for c in on])


def repeat_rows(rows: DataFrame, times: str, chunk: int = 10_000) -> DataFrame:
    """Each row ``times`` times, without ever holding that many copies in one array."""
    n = F.col(times).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), n - 1, F.lit(chunk).cast("long"))
    return (
        rows.where(n > 0)
        .withColumn("_from", F.explode(starts))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(chunk), n - F.col("_from")))))
        .drop("_from", "_copy", times)
    )
