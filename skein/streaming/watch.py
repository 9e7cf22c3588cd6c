"""Structured Streaming over a folder of programs: each batch of new files is parsed once, linted and appended.

Files are known by their whole paths, so equal names in two folders stay apart. The checkpoint folder makes it exactly-once per file: a batch that failed is run again and its rows replace the former.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.frontend.program import Program
from skein.operators.queries import QUERIES


def findings(spark: SparkSession, folder: str, out: str, checkpoint: str, rules: Sequence[str] | None = None, once: bool = True) -> StreamingQuery:
    """Lint findings of the folder's files, as Parquet by batch under `out`; with once, until all present files are done."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(folder)
    files = files.select(F.regexp_replace("path", "^[a-z]+:/*(?=/)", "").alias("file_id"), F.col("content").cast("string").alias("content"))

    def each(batch: DataFrame, number: int) -> None:
        QUERIES["linter"](Program(batch), rules).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
