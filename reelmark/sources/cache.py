"""Read-through Parquet cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _committed(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def sink_encoded_cache(encoded: DataFrame, path: str) -> None:
    encoded.write.mode("overwrite").option("compression", "zstd").parquet(path)


def encoded_cache(
    spark: SparkSession, path: str, compute: Callable[[], DataFrame], refresh: bool = False
) -> DataFrame:
    """The cached frame if it is complete and no refresh is asked for, else compute, save and read back."""
    if refresh or not _committed(spark, path):
        sink_encoded_cache(compute(), path)
    return spark.read.parquet(path)
