"""Session defaults and table loading."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def session(app: str = "skein", cores: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; a cluster's own settings win where spark-submit gives them."""
    cores = cores or min(8, os.cpu_count() or 1)
    return (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the star schema; Spark reads only the columns and row groups that a query needs."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
