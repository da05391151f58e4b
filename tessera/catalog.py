"""The queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import registry

PLANS = ("cleaning", "relational", "statistics", "matrices", "partitions", "models", "secondary", "suites", "consensus", "files", "review", "images", "extra")
for _name in PLANS:
    import_module(f"tessera.plans.{_name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
