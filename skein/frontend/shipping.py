"""Sends this package to Python workers that cannot import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if getattr(sc, "_skein_sent", False):
        return
    top = Path(__file__).resolve().parent.parent
    at = Path(tempfile.mkdtemp(prefix="skein-")) / "skein.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(at))
    sc._skein_sent = True
