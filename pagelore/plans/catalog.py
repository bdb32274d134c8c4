"""All registered queries and their check statements."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from pagelore.session import ship_package, tune

FAMILIES = ("pages", "text", "retrieval", "answers", "analytics", "tables", "requests", "streams")


def _pinned(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Pin the session settings (naive UTC timestamps among them) before the plan is made.

    The workers get the package here, so a query runs from any folder.
    """
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        ship_package(spark)
        return run(spark, sf_dir)

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for family in FAMILIES:
        found.update(import_module(f"pagelore.plans.{family}_plan").QUERIES)
    return {key: _pinned(run) for key, run in found.items()}


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for family in FAMILIES:
        found.update(import_module(f"pagelore.oracles.{family}_sql").SQL)
    return found
