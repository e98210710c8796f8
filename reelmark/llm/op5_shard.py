"""Sharding: a uniform shuffle with exact shard sizes, by a hypergeometric communication matrix.

Each input partition is permuted locally. How many of its rows go to each shard is drawn from the
distribution a uniform shuffle of all rows has (`contingency.split_tree`: leaves are input partitions,
entries are shards), so shard sizes are exact, at most one row apart. A partition's permuted rows are
dealt out in runs of those counts, exchanged, and permuted again within the shard.

DataFrame functions only. The permuted rows are written once to the shared folder, so a lost executor
can't change which partition a row was in. Slots come from sub-buckets of a shard and their offsets: no
task numbers a whole shard.

Defined results: rows with nulls, empty or very long texts and repeated rows are rows like any other; an
empty table gives an empty result. Input columns travel in the struct ``doc``, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmark.llm import contingency
from reelmark.llm.frames import LOCAL_BITS, running
from reelmark.session import cut_lineage

SLOTS_IN_A_TASK = 1 << 18


def shuffle(rows: DataFrame, shards: int, *, seed: int = 29) -> DataFrame:
    """doc (struct), shard int, slot long: every row once."""
    packed = rows.select(F.struct("*").alias("doc"))
    local = (
        packed.withColumn("key", F.xxhash64(F.lit(seed), "doc"))
        .sortWithinPartitions("key", "doc")
        .withColumn("id", F.monotonically_increasing_id())
    )
    local = cut_lineage(local).withColumns(
        {"part": F.shiftright("id", LOCAL_BITS), "at": F.col("id").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))}
    )
    in_order = Window.orderBy("part")  # a row per input partition
    parts = cut_lineage(
        local.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("pos", F.row_number().over(in_order).cast("bigint"))
        .withColumn("sum", F.sum("rows").over(in_order))
    )
    leaves, total = parts.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    sums = parts.select("pos", "sum").unionByName(
        rows.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("sum"))
    )
    bounds = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")),
        lambda k: F.floor((k + 1) * F.lit(total) / shards).cast("bigint") - F.floor(k * F.lit(total) / shards).cast("bigint"),
    )
    vector = rows.sparkSession.range(1).select(bounds.alias("vec"))
    matrix = contingency.split_tree(vector, sums, int(leaves), seed)
    ends = matrix.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("entry", "n"))).alias("row"))  # an entry per shard
    ends = ends.select(
        (F.col("leaf") + 1).alias("pos"),
        F.aggregate(
            "row",
            F.array(F.lit(0).cast("bigint")),
            lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["n"])),
        ).alias("ends"),
    )
    runs = cut_lineage(parts.select("part", "pos").join(ends, "pos").select("part", F.expr("slice(ends, 2, size(ends))").alias("ends")))
    # The run a row's place lies in names its shard.
    dealt = local.join(runs, "part").select(
        "doc", F.size(F.filter("ends", lambda e: e <= F.col("at"))).alias("shard"), F.xxhash64(F.lit(seed + 1), "key", "id").alias("order"), "id"
    )
    buckets = max(1, total // max(1, shards) // SLOTS_IN_A_TASK)
    half = F.shiftrightunsigned("order", 1).cast("double") / float(1 << 63)  # follows the order of the unsigned key
    dealt = dealt.withColumn("order", F.shiftrightunsigned("order", 1)).withColumn(
        "bucket", F.least(F.floor(half * buckets), F.lit(buckets - 1)).cast("bigint")
    )
    sizes = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    offsets = running(sizes, "shard", "bucket", "rows", "before").select("shard", "bucket", "before")
    inside = Window.partitionBy("shard", "bucket").orderBy("order", "id")
    return dealt.join(offsets, ["shard", "bucket"]).select(
        "doc", F.col("shard").cast("int").alias("shard"), (F.col("before") + F.row_number().over(inside) - 1).alias("slot")
    )
