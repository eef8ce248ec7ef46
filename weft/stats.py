"""Statistics of tables and limits on them (an extension: all from one aggregate)."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.model import Model


@dataclasses.dataclass(frozen=True, kw_only=True)
class Statistic(Model):
    field: str | None = None
    name: ClassVar[str] = "statistic"

    @property
    def key(self) -> str:
        return f"{self.name}_{self.field}" if self.field else self.name

    def column(self) -> Column:
        raise NotImplementedError


def _statistic(title: str, make: Any) -> type[Statistic]:
    return dataclasses.dataclass(frozen=True, kw_only=True)(type(title, (Statistic,), {"name": title.lower(), "column": lambda self: make(self.field), "__module__": __name__, "__annotations__": {}}))


Count = _statistic("Count", lambda c: F.count(F.lit(1) if c is None else F.col(c)))
CountDistinct = _statistic("CountDistinct", lambda c: F.count_distinct(F.col(c)))
Max = _statistic("Max", lambda c: F.max(c))
Min = _statistic("Min", lambda c: F.min(c))
Sum = _statistic("Sum", lambda c: F.sum(c))


def frame(df: DataFrame, wanted: Iterable[Statistic]) -> DataFrame:
    return df.agg(*(s.column().alias(s.key) for s in wanted))


def compute(df: DataFrame, wanted: Iterable[Statistic]) -> dict[str, Any]:
    return frame(df, list(wanted)).head().asDict()


@dataclasses.dataclass(frozen=True, kw_only=True)
class Threshold(Model):
    """Limits of a statistic."""

    statistic: Statistic
    low: Any = None
    high: Any = None

    def check(self, value: Any) -> bool:
        return value is not None and (self.low is None or value >= self.low) and (self.high is None or value <= self.high)


def broken(df: DataFrame, limits: Iterable[Threshold]) -> list[str]:
    """What is out of its limits; for a producer's validation."""
    limits = list(limits)
    found = compute(df, dict.fromkeys(t.statistic for t in limits))
    return [f"{t.statistic.key} is {found[t.statistic.key]}, not from {t.low} to {t.high}" for t in limits if not t.check(found[t.statistic.key])]
