"""Parquet tables under one root, each write of a table being a new version folder.

A table that is being read can thus be rewritten, and a version counts only once Spark's job commit
has put its ``_SUCCESS`` marker there, so a lost job leaves the previous version in force. An append is
a folder of its own beside the version, which counts by the same rule.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reelmark.schemas import TABLES
from reelmark.session import cut_lineage


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- files

    def _fs(self, path: str):
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop_path

    def _versions(self, name: str) -> list[int]:
        fs, pattern = self._fs(f"{self.root}/{name}/version=*/_SUCCESS")
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in fs.globStatus(pattern) or [])

    def location(self, name: str) -> str | None:
        """Folder of the version in force."""
        versions = self._versions(name)
        return f"{self.root}/{name}/version={versions[-1]}" if versions else None

    def appended(self, name: str, version: int) -> list[str]:
        """Folders of the rows added to a version since it was written."""
        fs, pattern = self._fs(f"{self.root}/{name}/added={version}.*/_SUCCESS")
        return sorted(s.getPath().getParent().toString() for s in fs.globStatus(pattern) or [])

    def exists(self, name: str) -> bool:
        return self.location(name) is not None

    def in_one_folder(self, name: str) -> bool:
        versions = self._versions(name)
        return bool(versions) and not self.appended(name, versions[-1])

    # -- reading and writing

    def read(self, name: str) -> DataFrame:
        """The table; one that was never written is empty."""
        versions = self._versions(name)
        if not versions:
            return empty(self.spark, TABLES[name].schema)
        paths = [f"{self.root}/{name}/version={versions[-1]}", *self.appended(name, versions[-1])]
        reader = self.spark.read
        return (reader.schema(TABLES[name].schema) if name in TABLES else reader).parquet(*paths)

    def _typed(self, name: str, rows: DataFrame) -> DataFrame:
        if name not in TABLES:
            return rows
        schema = TABLES[name].schema
        return rows.select(
            *[
                (F.col(c.name) if c.name in rows.columns else F.lit(None)).cast(c.dataType).alias(c.name)
                for c in schema
            ]
        )

    def _write(self, name: str, rows: DataFrame, location: str, compression: str, cluster: bool) -> dict:
        """Write and count in one pass; ``rows`` is worked out once."""
        typed = self._typed(name, rows)
        sort_by = TABLES[name].sort_by if cluster and name in TABLES else ()
        if sort_by:
            # Ranges over all sort columns: a hot user or item still spans several files, and row-group
            # statistics do the work of an index. Choosing the ranges reads the rows a first time, hence written ones.
            typed = cut_lineage(typed).repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
        seen = Observation(f"write-{name}")
        started = time.perf_counter()
        typed.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option(
            "compression", compression
        ).parquet(location)
        return {"table_name": name, "rows": seen.get["rows"], "seconds": time.perf_counter() - started}

    def overwrite(self, name: str, rows: DataFrame, compression: str = "zstd", cluster: bool = True) -> dict:
        """Replace the table; returns table_name, rows and seconds.

        ``cluster=False`` keeps the rows where they are, for rows that already lie in table order.
        """
        versions = self._versions(name)
        target = f"{self.root}/{name}/version={(versions[-1] if versions else 0) + 1}"
        return self._write(name, rows, target, compression, cluster)

    def append(self, name: str, rows: DataFrame, compression: str = "zstd") -> dict:
        """Add rows to the version in force; all of them are seen, or none."""
        versions = self._versions(name)
        if not versions:
            return self.overwrite(name, rows, compression)
        target = f"{self.root}/{name}/added={versions[-1]}.{uuid.uuid4().hex}"
        return self._write(name, rows, target, compression, cluster=True)

    def truncate(self, name: str) -> dict:
        return self.overwrite(name, empty(self.spark, self.read(name).schema))

    def drop(self, name: str) -> None:
        fs, path = self._fs(f"{self.root}/{name}")
        fs.delete(path, True)

    def vacuum(self, name: str) -> None:
        """Remove versions no longer in force; call when nothing reads them any more."""
        for version in self._versions(name)[:-1]:
            for folder in [*self.appended(name, version), f"{self.root}/{name}/version={version}"]:
                fs, path = self._fs(folder)
                fs.delete(path, True)


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    """No rows, and Catalyst knows it; an empty local list would count as of unknown size."""
    return spark.range(0).select(*[F.lit(None).cast(c.dataType).alias(c.name) for c in schema])


def with_row_ids(rows: DataFrame, column: str, after: int = 0) -> DataFrame:
    """Increasing ids above ``after``, unique within the load but not consecutive.

    ``rows`` must come from files without a shuffle in between: only then does a task that is run
    again see the same rows in the same order and give them the same ids.
    """
    return rows.withColumn(column, F.monotonically_increasing_id() + F.lit(after + 1))
