"""Session settings and the shared scratch folder."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Joins go by measured sizes: no broadcast on an estimate, and hot keys are split even if that costs a shuffle.
JOINS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "16MB",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

SETTINGS = {
    **JOINS,
    # Timestamps are wall-clock text in the inputs; UTC keeps every second distinct (no DST fold).
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording a Python call site for every expression slows down building a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


#: Folder of the job that is running, within the application's.
_JOB_FOLDER: ContextVar[str] = ContextVar("job_folder", default="")


def build_session(app_name: str = "reelmark", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune_joins(spark: SparkSession) -> None:
    """`JOINS` for a session that `build_session` did not make."""
    for key, value in JOINS.items():
        spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may fall back to a
    temporary folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="reelmark-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own part of the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{_JOB_FOLDER.get()}{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote there; call when no frame made from it is needed any more."""
    _delete(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def job(run: Callable) -> Callable:
    """For a job, a function of (spark, ...) whose result needs none of its steps: they go when it ends."""

    @functools.wraps(run)
    def cleaned(spark: SparkSession, *args, **options):
        folder = f"{_JOB_FOLDER.get()}job-{uuid.uuid4().hex}/"
        token = _JOB_FOLDER.set(folder)
        try:
            return run(spark, *args, **options)
        finally:
            _JOB_FOLDER.reset(token)
            _delete(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{folder}")

    return cleaned


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back.

    Reuse then costs a pruned Parquet read, a lost executor costs no recomputation, and the size of
    the result, which join choices look at, is known rather than estimated.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
