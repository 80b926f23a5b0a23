"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import catalogue, flows, indexed  # noqa: F401  the latter two add to the first one's queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact search under a role's access, hard filters and numeric constraints."""
    return catalogue.QUERIES["plan_search"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalogue.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalogue.SQL)
