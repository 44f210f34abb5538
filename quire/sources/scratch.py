"""Tables that cut the lineage of iterative jobs, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def scratch_path(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir.

    Where that is unset, a local session (a test, a notebook) gets a temporary folder. On a
    cluster no machine's own folder is seen by the others, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/quire-scratch"
    path = f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written below the shared folder and read again, which cuts its lineage.

    A lost executor then costs only the tasks that it ran; no copy lives on one machine.
    """
    path = path or scratch_path(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Spark's own file systems."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _MADE:
        _MADE.remove(path)


def clear(spark: SparkSession) -> None:
    """Delete every scratch folder that this process has made: to be called once results are consumed."""
    for path in list(_MADE):
        drop(spark, path)
