"""Stored intermediate tables: where an iterative operator cuts its lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where nothing is set."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        of = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = of.get() if of.isDefined() else ""
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return "file:///tmp/checkpoints"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stored"


_paths: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends here, and no executor's loss costs it."""
    path = f"{shared_dir(df.sparkSession)}/skein-{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    df.write.options(**(options or {})).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._skein_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Deletes tables of stored() that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_skein_path", None):
            _delete(df.sparkSession, path)
            if path in _paths:
                _paths.remove(path)


def held(df: DataFrame) -> bool:
    """Whether a table of stored() is still there."""
    return getattr(df, "_skein_path", None) in _paths


def release(spark: SparkSession) -> None:
    """Deletes all tables that this process stored. Results that were not written or collected yet are lost with them."""
    while _paths:
        _delete(spark, _paths.pop())
