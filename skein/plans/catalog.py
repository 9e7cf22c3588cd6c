"""Queries over the star schema and their DuckDB equivalents, gathered from the query modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from skein.plans.registry import ORACLES, QUERIES

MODULES = ("graphs", "searches", "verbs", "scalars", "history", "lints", "sinks", "shapes", "programs", "analysis", "processors", "rules", "frames", "formats", "packages")


def _load() -> None:
    for name in MODULES:
        import_module(f"skein.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
