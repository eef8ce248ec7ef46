"""Arrow, NumPy and pandas types."""

from __future__ import annotations

import json
from typing import Any

import numpy as np
import pyarrow as pa

from weft import types as t
from weft.adapters import TypeSystem
from weft.adapters.python import python

arrow = TypeSystem("arrow")

for _a, _k in ((pa.bool_(), t.Boolean), (pa.date32(), t.Date), (pa.float16(), t.Float16), (pa.float32(), t.Float32), (pa.float64(), t.Float64), (pa.null(), t.Null), (pa.string(), t.String)):
    arrow.scalar(_a, _k)
arrow.scalar(pa.date64(), t.Date, back=False)
arrow.scalar(pa.large_string(), t.String, back=False)
arrow.scalar(pa.large_binary(), t.Binary, back=False)
for _n in (8, 16, 32, 64):
    arrow.scalar(getattr(pa, f"int{_n}")(), getattr(t, f"Int{_n}"))
    arrow.scalar(getattr(pa, f"uint{_n}")(), getattr(t, f"UInt{_n}"))

_UNITS = dict(zip(("s", "ms", "us", "ns"), t.PRECISIONS, strict=True))
_SHORT = {v: k for k, v in _UNITS.items()}


def _is(kind: Any) -> Any:
    return lambda x: isinstance(x, pa.DataType) and kind(x)


def _moment(x: Any, s: TypeSystem) -> t.Type:
    if x.tz is None:
        return t.DateTime(precision=_UNITS[x.unit])
    if x.tz.upper() != "UTC":
        raise ValueError(f"timestamps must be in UTC, got {x.tz}")
    return t.Timestamp(precision=_UNITS[x.unit])


def _time(x: t.Time, s: TypeSystem) -> Any:
    short = _SHORT[x.precision]
    return pa.time32(short) if short in ("s", "ms") else pa.time64(short)


def _field(name: str, x: t.Type, s: TypeSystem) -> pa.Field:
    return pa.field(name, s.from_type(x), nullable=x.nullable)


def _typed(f: pa.Field, s: TypeSystem) -> t.Type:
    import dataclasses

    return dataclasses.replace(s.to_type(f.type), nullable=f.nullable)


arrow.register(_is(lambda x: pa.types.is_binary(x) or pa.types.is_fixed_size_binary(x)), lambda x, s: t.Binary(byte_size=x.byte_width if pa.types.is_fixed_size_binary(x) else None), lambda x: type(x) is t.Binary, lambda x, s: pa.binary(x.byte_size if x.byte_size is not None else -1))
arrow.register(_is(pa.types.is_timestamp), _moment, lambda x: type(x) in (t.DateTime, t.Timestamp), lambda x, s: pa.timestamp(_SHORT[x.precision], tz="UTC" if type(x) is t.Timestamp else None))
arrow.register(_is(pa.types.is_time), lambda x, s: t.Time(precision=_UNITS[x.unit]), lambda x: type(x) is t.Time, _time)
arrow.register(lambda x: False, lambda x, s: None, lambda x: type(x) is t.Geography, lambda x, s: pa.binary() if x.format.upper() == "WKB" else pa.string())
arrow.register(lambda x: False, lambda x, s: None, lambda x: type(x) is t.Enum, lambda x, s: s.from_type(x.type))
arrow.register(_is(pa.types.is_list), lambda x, s: t.List(element=_typed(x.value_field, s)), lambda x: type(x) in (t.List, t.Set), lambda x, s: pa.list_(_field("item", x.element, s)))
arrow.register(_is(pa.types.is_map), lambda x, s: t.Map(key=s.to_type(x.key_type), value=_typed(x.item_field, s)), lambda x: type(x) is t.Map, lambda x, s: pa.map_(s.from_type(x.key), _field("value", x.value, s)))
arrow.register(_is(pa.types.is_struct), lambda x, s: t.Struct(fields={f.name: _typed(f, s) for f in x}), lambda x: type(x) is t.Struct, lambda x, s: pa.struct([_field(k, f, s) for k, f in x.fields.items()]))


def _schema(x: t.Collection, s: TypeSystem) -> pa.Schema:
    notes = {"name": x.name or "", "partition_by": json.dumps(x.partition_by), "cluster_by": json.dumps(x.cluster_by)}
    return pa.schema([_field(k, f, s) for k, f in x.fields.items()], metadata=notes)


def _collection(x: pa.Schema, s: TypeSystem) -> t.Type:
    notes = {k.decode(): v.decode() for k, v in (x.metadata or {}).items()}
    return t.Collection(name=notes.get("name") or None, element=t.Struct(fields={f.name: _typed(f, s) for f in x}), **{k: tuple(json.loads(notes.get(k, "[]"))) for k in ("partition_by", "cluster_by")})


arrow.register(lambda x: isinstance(x, pa.Schema), _collection, lambda x: type(x) is t.Collection, _schema)

#: NumPy's scalar types; an array with so many dimensions is a list of lists.
numpy = TypeSystem("numpy", extends=python)
for _c, _k in ((np.bool_, t.Boolean), (np.bytes_, t.Binary), (np.float16, t.Float16), (np.float32, t.Float32), (np.float64, t.Float64), (np.str_, t.String), *((getattr(np, f"{p.lower()}{n}"), getattr(t, f"{p}{n}")) for p in ("Int", "UInt") for n in (8, 16, 32, 64))):
    numpy.register(lambda x, c=_c: x is c or (isinstance(x, np.dtype) and x.type is c), lambda x, s, k=_k: k(), lambda x, k=_k: type(x) is k and not x.nullable, lambda x, s, c=_c: c, priority=7)


def _array(x: np.ndarray, s: TypeSystem) -> t.Type:
    out = s.to_type(x.dtype)
    for _ in range(x.ndim):
        out = t.List(element=out)
    return out


def _empty(x: t.List, s: TypeSystem) -> np.ndarray:
    depth, inner = 0, x
    while isinstance(inner, t.List):
        depth, inner = depth + 1, inner.element
    return np.empty((0,) * depth, dtype=s.from_type(inner))


numpy.register(lambda x: isinstance(x, np.ndarray), _array, lambda x: type(x) is t.List, _empty, priority=7)

try:
    import pandas as pd
except ImportError:
    pandas = None
else:
    pandas = TypeSystem("pandas", extends=numpy)

    def _series(x: pd.Series, s: TypeSystem) -> t.Type:
        if x.dtype == object or isinstance(x.dtype, pd.StringDtype):
            if not all(isinstance(v, str) for v in x):
                raise NotImplementedError("a column of objects must hold strings only")
            return t.List(element=t.String())
        return t.List(element=s.to_type(x.dtype))

    def _dtype(x: t.Type, s: TypeSystem) -> Any:
        return object if type(x) is t.String else s.from_type(x)

    pandas.register(lambda x: isinstance(x, pd.Series), _series, lambda x: type(x) is t.List and not isinstance(x.element, (t.Struct, t.List)), lambda x, s: pd.Series([], dtype=_dtype(x.element, s)), priority=8)
    pandas.register(
        lambda x: isinstance(x, pd.DataFrame),
        lambda x, s: t.List(element=t.Struct(fields={str(c): s.to_type(x[c]).element for c in x.columns})),
        lambda x: isinstance(x, t.List) and isinstance(x.element, t.Struct),
        lambda x, s: pd.DataFrame({k: pd.Series([], dtype=_dtype(f, s)) for k, f in x.element.fields.items()}),
        priority=8,
    )
