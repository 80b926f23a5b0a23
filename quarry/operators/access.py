"""Access levels: which rows a role may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: roles and the levels that they see; a row without a level is internal
ROLES = {
    "partner": ["public"],
    "researcher": ["public", "internal"],
    "analyst": ["public", "internal"],
    "manager": ["public", "internal", "confidential"],
    "admin": ["public", "internal", "confidential"],
}


def levels(role: str) -> list[str]:
    return ROLES.get(role, ["public"])


def visible(role: str, level: str = "access_level") -> Column:
    return F.coalesce(F.col(level), F.lit("internal")).isin(levels(role))


def by_role(sources: DataFrame) -> DataFrame:
    """Each row once for every role that sees it."""
    roles = F.array(*(F.lit(r) for r in ROLES))
    sees = F.filter(roles, lambda r: _any_level(r))
    return sources.withColumn("role", F.explode(sees))


def _any_level(role: Column) -> Column:
    level = F.coalesce(F.col("access_level"), F.lit("internal"))
    found = F.lit(False)
    for name, seen in ROLES.items():
        found = found | ((role == name) & level.isin(seen))
    return found
