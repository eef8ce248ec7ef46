"""File formats."""

from __future__ import annotations

import dataclasses
from typing import ClassVar

from weft import types
from weft.model import Model

#: Types that Python's own values can't stand for.
_NOT_PYTHON = (types.UInt8, types.UInt16, types.UInt32, types.UInt64, types.Time, types.DateTime, types.Geography)


@dataclasses.dataclass(frozen=True, kw_only=True)
class Format(Model):
    extension: str = ""
    #: Spark's name of the format; None if Spark doesn't read it.
    spark_name: ClassVar[str | None] = None

    def check(self, t: types.Type) -> None:
        """Fail for a type that the format can't hold."""


class _PythonFormat(Format):
    def check(self, t: types.Type) -> None:
        if isinstance(t, _NOT_PYTHON):
            raise TypeError(f"{type(self).__name__} can't hold a {t.friendly_key}")
        for inner in _inner(t):
            self.check(inner)


@dataclasses.dataclass(frozen=True, kw_only=True)
class JSON(_PythonFormat):
    extension: str = ".json"
    spark_name = "json"


@dataclasses.dataclass(frozen=True, kw_only=True)
class Pickle(_PythonFormat):
    """Of our own data only: reading a pickle runs what is in it."""

    extension: str = ".pickle"


@dataclasses.dataclass(frozen=True, kw_only=True)
class Parquet(Format):
    """An extension: the columnar format for tables."""

    extension: str = ".parquet"
    spark_name = "parquet"

    def check(self, t: types.Type) -> None:
        if not isinstance(t, (types.Collection, types.Struct)):
            raise TypeError(f"Parquet holds tables, not a {t.friendly_key}")


@dataclasses.dataclass(frozen=True, kw_only=True)
class CSV(Format):
    """An extension: flat tables with a header line."""

    extension: str = ".csv"
    spark_name = "csv"

    def check(self, t: types.Type) -> None:
        if not isinstance(t, types.Collection) or any(isinstance(f, (types.List, types.Map, types.Struct, types.Binary)) for f in t.fields.values()):
            raise TypeError(f"CSV holds flat tables, not a {t.friendly_key}")


def _inner(t: types.Type) -> list[types.Type]:
    if isinstance(t, types.Struct):
        return list(t.fields.values())
    if isinstance(t, types.List):
        return [t.element]
    if isinstance(t, types.Map):
        return [t.key, t.value]
    if isinstance(t, types.Enum):
        return [t.type]
    return []
