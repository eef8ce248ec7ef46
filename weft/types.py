"""Logical types and their Spark counterparts.

Spark forgets some of what a logical type says: nullability on reading files, unsigned ranges,
enumerations, sizes. So `to_spark` keeps the logical type in the fields' metadata, which Parquet
holds, `from_spark` restores it, and `violations` counts the rows that break it in one aggregate.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterable, Mapping
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.model import Model, frozendict, skipped

PRECISIONS = ("second", "millisecond", "microsecond", "nanosecond")
_KEY = "weft.type"
REGISTRY: dict[str, type[Type]] = {}


@dataclasses.dataclass(frozen=True, kw_only=True)
class Type(Model):
    description: str | None = skipped(default=None)
    nullable: bool = False

    def __init_subclass__(cls, **kwargs: Any) -> None:
        super().__init_subclass__(**kwargs)
        REGISTRY[cls.__name__] = cls

    @property
    def friendly_key(self) -> str:
        return type(self).__name__

    def spark(self) -> T.DataType:
        raise TypeError(f"{type(self).__name__} is abstract")

    def breaks(self, x: Column) -> Column | None:
        """True where a value that isn't null doesn't belong to the type; None if Spark's own type sees to it."""
        return None

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"kind": type(self).__name__}
        for f in dataclasses.fields(self):
            value = getattr(self, f.name)
            if value == f.default:
                continue
            if isinstance(value, Type):
                value = value.to_dict()
            elif isinstance(value, Mapping):
                value = {k: v.to_dict() for k, v in value.items()}
            elif isinstance(value, frozenset):
                value = sorted(value, key=repr)
            out[f.name] = list(value) if isinstance(value, tuple) else value
        return out

    @staticmethod
    def from_dict(found: Mapping[str, Any]) -> Type:
        kwargs = {}
        for k, v in found.items():
            if k == "kind":
                continue
            if isinstance(v, Mapping):
                v = Type.from_dict(v) if isinstance(v.get("kind"), str) else {n: Type.from_dict(t) for n, t in v.items()}
            kwargs[k] = tuple(v) if isinstance(v, list) else v
        return REGISTRY[found["kind"]](**kwargs)


def _simple(name: str, spark: T.DataType, low: int | None = None, high: int | None = None) -> type[Type]:
    def breaks(self: Type, x: Column) -> Column | None:
        return None if low is None else (x < F.lit(str(low)).cast(spark)) | (x > F.lit(str(high)).cast(spark))

    made = dataclasses.dataclass(frozen=True, kw_only=True)(type(name, (Type,), {"spark": lambda self: spark, "breaks": breaks, "__module__": __name__, "__annotations__": {}}))
    return made


Boolean = _simple("Boolean", T.BooleanType())
Date = _simple("Date", T.DateType())
Float16 = _simple("Float16", T.FloatType())
Float32 = _simple("Float32", T.FloatType())
Float64 = _simple("Float64", T.DoubleType())
Int8 = _simple("Int8", T.ByteType())
Int16 = _simple("Int16", T.ShortType())
Int32 = _simple("Int32", T.IntegerType())
Int64 = _simple("Int64", T.LongType())
UInt8 = _simple("UInt8", T.ShortType(), 0, (1 << 8) - 1)
UInt16 = _simple("UInt16", T.IntegerType(), 0, (1 << 16) - 1)
UInt32 = _simple("UInt32", T.LongType(), 0, (1 << 32) - 1)
UInt64 = _simple("UInt64", T.DecimalType(20, 0), 0, (1 << 64) - 1)
Null = _simple("Null", T.NullType())
String = _simple("String", T.StringType())


@dataclasses.dataclass(frozen=True, kw_only=True)
class Binary(Type):
    byte_size: int | None = None

    def spark(self) -> T.DataType:
        return T.BinaryType()

    def breaks(self, x: Column) -> Column | None:
        return None if self.byte_size is None else F.octet_length(x) != self.byte_size


@dataclasses.dataclass(frozen=True, kw_only=True)
class _Precise(Type):
    precision: str = "microsecond"

    def __post_init__(self) -> None:
        if self.precision not in PRECISIONS:
            raise ValueError(f"precision must be one of {PRECISIONS}, got {self.precision!r}")

    @property
    def friendly_key(self) -> str:
        return self.precision.capitalize() + type(self).__name__


@dataclasses.dataclass(frozen=True, kw_only=True)
class DateTime(_Precise):
    """A point in time without a zone."""

    def spark(self) -> T.DataType:
        return T.TimestampNTZType()


@dataclasses.dataclass(frozen=True, kw_only=True)
class Timestamp(_Precise):
    """A point in time in UTC."""

    def spark(self) -> T.DataType:
        return T.TimestampType()


@dataclasses.dataclass(frozen=True, kw_only=True)
class Time(_Precise):
    """A time of day, held as the number of its units since midnight."""

    _units: ClassVar[tuple[int, ...]] = (1, 10**3, 10**6, 10**9)

    def spark(self) -> T.DataType:
        return T.LongType()

    def breaks(self, x: Column) -> Column | None:
        return (x < 0) | (x >= F.lit(86_400 * self._units[PRECISIONS.index(self.precision)]))


_SCALARS: dict[str, tuple[type, ...]] = {"String": (str,), "Boolean": (bool,), **{f"{k}{n}": (int,) for k in ("Int", "UInt") for n in (8, 16, 32, 64)}, **{f"Float{n}": (float,) for n in (16, 32, 64)}}


@dataclasses.dataclass(frozen=True, kw_only=True)
class Enum(Type):
    type: Type
    items: Iterable[Any]

    def __post_init__(self) -> None:
        items = frozenset(self.items)
        if not items:
            raise ValueError("an Enum needs items")
        kinds = _SCALARS.get(type(self.type).__name__)
        if kinds and (wrong := [x for x in items if type(x) not in kinds]):
            raise ValueError(f"items of an Enum of {self.type.friendly_key} can't be {wrong}")
        object.__setattr__(self, "items", items)

    @property
    def friendly_key(self) -> str:
        return f"{self.type.friendly_key}Enum"

    def spark(self) -> T.DataType:
        return self.type.spark()

    def breaks(self, x: Column) -> Column | None:
        return ~x.isin(*sorted(self.items, key=repr))


@dataclasses.dataclass(frozen=True, kw_only=True)
class Geography(Type):
    format: str = "WKT"
    srid: int | None = None

    def spark(self) -> T.DataType:
        return T.BinaryType() if self.format.upper() == "WKB" else T.StringType()


@dataclasses.dataclass(frozen=True, kw_only=True)
class List(Type):
    element: Type

    @property
    def friendly_key(self) -> str:
        return f"{self.element.friendly_key}{type(self).__name__}"

    def spark(self) -> T.DataType:
        return T.ArrayType(self.element.spark(), self.element.nullable)

    def breaks(self, x: Column) -> Column | None:
        return _any(self.element, lambda f: F.exists(x, f))


@dataclasses.dataclass(frozen=True, kw_only=True)
class Set(List):
    def breaks(self, x: Column) -> Column | None:
        twice = F.size(F.array_distinct(x)) != F.size(x)
        inner = super().breaks(x)
        return twice if inner is None else twice | inner


@dataclasses.dataclass(frozen=True, kw_only=True)
class Map(Type):
    key: Type
    value: Type

    @property
    def friendly_key(self) -> str:
        return f"{self.key.friendly_key}To{self.value.friendly_key}"

    def spark(self) -> T.DataType:
        return T.MapType(self.key.spark(), self.value.spark(), self.value.nullable)

    def breaks(self, x: Column) -> Column | None:
        found = [b for b in (_any(self.key, lambda f: F.exists(F.map_keys(x), f)), _any(self.value, lambda f: F.exists(F.map_values(x), f))) if b is not None]
        return found[0] if len(found) == 1 else found[0] | found[1] if found else None


@dataclasses.dataclass(frozen=True, kw_only=True)
class Struct(Type):
    fields: Mapping[str, Type]
    name: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "fields", frozendict(self.fields))

    @property
    def friendly_key(self) -> str:
        return self.name or type(self).__name__

    def spark(self) -> T.StructType:
        return T.StructType([field(k, t) for k, t in self.fields.items()])

    def breaks(self, x: Column) -> Column | None:
        out = None
        for k, t in self.fields.items():
            b = bad(t, x[k])
            if b is not None:
                out = b if out is None else out | b
        return out


@dataclasses.dataclass(frozen=True, kw_only=True)
class Collection(List):
    """A table: a list of structs with partition and cluster fields."""

    element: Struct
    name: str | None = None
    partition_by: tuple[str, ...] = ()
    cluster_by: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for what in ("partition_by", "cluster_by"):
            object.__setattr__(self, what, tuple(getattr(self, what)))
            if unknown := [k for k in getattr(self, what) if not isinstance(self.element, Struct) or k not in self.element.fields]:
                raise ValueError(f"{what} names unknown fields: {unknown}")
        if both := set(self.partition_by) & set(self.cluster_by):
            raise ValueError(f"partition_by and cluster_by overlap: {sorted(both)}")

    @property
    def friendly_key(self) -> str:
        return self.name or super().friendly_key

    @property
    def is_partitioned(self) -> bool:
        return bool(self.partition_by)

    @property
    def fields(self) -> Mapping[str, Type]:
        return self.element.fields

    @property
    def partition_fields(self) -> frozendict:
        return frozendict({k: self.fields[k] for k in self.partition_by})

    def schema(self) -> T.StructType:
        return self.element.spark()


def bad(t: Type, x: Column) -> Column | None:
    """True where x breaks t, nulls included; None if nothing can."""
    own = t.breaks(x)
    inner = None if own is None else x.isNotNull() & F.coalesce(own, F.lit(False))
    if t.nullable or isinstance(t, Null):
        return inner
    return x.isNull() if inner is None else x.isNull() | inner


def _any(t: Type, exists: Any) -> Column | None:
    return None if bad(t, F.lit(None).cast(t.spark())) is None else exists(lambda x: bad(t, x))


def field(name: str, t: Type) -> T.StructField:
    return T.StructField(name, t.spark(), t.nullable or isinstance(t, Null), {_KEY: json.dumps(t.to_dict())})


def to_spark(t: Type) -> T.DataType:
    return t.schema() if isinstance(t, Collection) else t.spark()


def from_spark(found: T.DataType, nullable: bool = False, metadata: Mapping[str, Any] | None = None) -> Type:
    """The logical type of a Spark type: the one in its metadata, or the plainest that fits."""
    if metadata and _KEY in metadata:
        return Type.from_dict(json.loads(metadata[_KEY]))
    plain = {T.BooleanType: Boolean, T.DateType: Date, T.FloatType: Float32, T.DoubleType: Float64, T.ByteType: Int8, T.ShortType: Int16, T.IntegerType: Int32, T.LongType: Int64, T.NullType: Null, T.StringType: String, T.BinaryType: Binary, T.TimestampNTZType: DateTime, T.TimestampType: Timestamp}
    if type(found) in plain:
        return plain[type(found)](nullable=nullable)
    if isinstance(found, T.DecimalType) and (found.precision, found.scale) == (20, 0):
        return UInt64(nullable=nullable)
    if isinstance(found, T.ArrayType):
        return List(element=from_spark(found.elementType, found.containsNull), nullable=nullable)
    if isinstance(found, T.MapType):
        return Map(key=from_spark(found.keyType), value=from_spark(found.valueType, found.valueContainsNull), nullable=nullable)
    if isinstance(found, T.StructType):
        return Struct(fields={f.name: from_spark(f.dataType, f.nullable, f.metadata) for f in found.fields}, nullable=nullable)
    raise TypeError(f"no logical type for {found.simpleString()}")


def collection_of(df: DataFrame, **kwargs: Any) -> Collection:
    return Collection(element=from_spark(df.schema), **kwargs)


def conform(df: DataFrame, t: Collection) -> DataFrame:
    """The fields of t in order, cast to its Spark types, with its metadata."""
    return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name, metadata=f.metadata) for f in t.schema().fields))


def violations(df: DataFrame, t: Collection) -> dict[str, int]:
    """How many rows break each field's type; fields that none breaks are left out. One aggregate."""
    checks = {k: b for k, f in t.fields.items() if (b := bad(f, F.col(f"`{k}`"))) is not None}
    if not checks:
        return {}
    row = df.agg(*(F.count_if(b).alias(k) for k, b in checks.items())).head()
    return {k: row[k] for k in checks if row[k]}
