"""Small DataFrame helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelmark.session import cut_lineage, scratch_path

LOCAL_BITS = 33  # monotonically_increasing_id puts the partition above these bits
CHUNK = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that follows from the values of ``parts``."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)


def running(df: DataFrame, group: str, position: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over smaller positions of the group.

    Two levels, so that no window holds a whole group: positions in chunks, then chunk totals.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(position) / CHUNK))
    totals = chunked.groupBy(group, "_chunk").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "_chunk", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_chunk").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return (
        chunked.join(offsets, [group, "_chunk"])
        .withColumn(name, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_chunk", "_offset")
    )


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds 0, 1, 2 ... in a global order: ranges are sorted side by side, then shifted by what lies before."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = cut_lineage(
        df.repartitionByRange(partitions, *order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_id", LOCAL_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).select(  # a row per partition
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    local = F.col("_id").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    return marked.join(offsets, "_part").withColumn(name, F.col("_offset") + local).drop("_id", "_part", "_offset")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As `cut_lineage`, with the path, for steps that `removed` drops once they are used up."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
