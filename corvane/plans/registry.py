"""The registered queries and their SQL twins, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("core", "text", "nesting", "metrics", "ranking", "geometry", "state", "records", "studies", "files", "shapes", "volumes")

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    return [import_module(f"corvane.plans.{m}") for m in MODULES]


def queries() -> dict[str, Query]:
    """All queries of the plan modules."""
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """The SQL twins of the plan modules."""
    return {k: s for m in _modules() for k, s in m.ORACLE_SQL.items()}
