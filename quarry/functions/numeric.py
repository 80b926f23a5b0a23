"""Numeric constraints over measured values: a value, or a range with either end open."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what an open end of a stored range counts as
LOWEST, HIGHEST = -1e18, 1e18


@dataclass(frozen=True)
class Constraint:
    """A request: operator (between, <, <=, >, >=, =) and its value or ends; unit None asks for any unit."""

    parameter: str
    operator: str = "between"
    value: float | None = None
    value_min: float | None = None
    value_max: float | None = None
    unit: str | None = None

    @property
    def low(self) -> float | None:
        return self.value if self.value_min is None else self.value_min

    @property
    def high(self) -> float | None:
        return self.value if self.value_max is None else self.value_max


def compare(value: Column, c: Constraint) -> Column:
    """Whether one number satisfies a constraint; a side that the request leaves open is satisfied."""
    if c.operator == "between":
        sides = [value >= c.low] * (c.low is not None) + [value <= c.high] * (c.high is not None)
        return sides[0] & sides[1] if len(sides) == 2 else sides[0] if sides else F.lit(True)
    if c.operator in ("<", "<="):
        return F.lit(True) if c.high is None else value < c.high if c.operator == "<" else value <= c.high
    if c.operator in (">", ">="):
        return F.lit(True) if c.low is None else value > c.low if c.operator == ">" else value >= c.low
    return F.lit(True) if c.low is None else F.abs(value - F.lit(c.low)) <= 1e-9


def holds(value: float, c: Constraint) -> bool:
    """The same for a number in Python."""
    low, high = c.low, c.high
    if c.operator == "=":
        return low is None or abs(value - low) <= 1e-9
    above = {">": lambda: value > low, ">=": lambda: value >= low, "between": lambda: value >= low}.get(c.operator)
    below = {"<": lambda: value < high, "<=": lambda: value <= high, "between": lambda: value <= high}.get(c.operator)
    return (above is None or low is None or above()) and (below is None or high is None or below())


def numeric_predicate(c: Constraint, mode: str = "range", value: str = "value", low: str = "value_min", high: str = "value_max") -> Column:
    """Whether a stored value satisfies a constraint.

    range: the stored range as a whole (for between: it overlaps the request; for =: it holds the value).
    point: any of value, value_min and value_max by itself.
    """
    if mode == "point":
        known = F.filter(F.array(value, low, high), lambda v: v.isNotNull())
        return F.exists(known, lambda v: compare(v, c))
    bottom, top = F.coalesce(low, value, F.lit(LOWEST)), F.coalesce(high, value, F.lit(HIGHEST))
    first, last = (c.low, c.high) if c.operator == "between" else (c.high if c.low is None else c.low, c.low if c.high is None else c.high)
    checks: dict[str, list[Column]] = {
        "between": [top >= first] * (first is not None) + [bottom <= last] * (last is not None),
        "<": [top < last] if last is not None else [],
        "<=": [top <= last] if last is not None else [],
        ">": [bottom > first] if first is not None else [],
        ">=": [bottom >= first] if first is not None else [],
    }
    at = next((x for x in (c.value, first, last) if x is not None), None)
    found = checks.get(c.operator, [bottom <= at, top >= at] if at is not None else [])
    result = F.lit(True)
    for check in found:
        result = result & check
    return result
