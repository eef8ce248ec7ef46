"""Python hints, dataclasses and models with annotated fields."""

from __future__ import annotations

import dataclasses
import datetime
import types as py
from collections.abc import Mapping
from typing import Annotated, Any, Literal, Optional, TypedDict, Union, get_args, get_origin, get_type_hints, is_typeddict

from weft import types as t
from weft.adapters import TypeSystem

python = TypeSystem("python")

_SCALARS = {bool: t.Boolean, bytes: t.Binary, datetime.date: t.Date, int: t.Int64, float: t.Float64, str: t.String}
for _hint, _kind in _SCALARS.items():
    python.register(lambda x, h=_hint: x is h, lambda x, s, k=_kind: k(), lambda x, k=_kind: type(x) is k, lambda x, s, h=_hint: h)
python.register(lambda x: x is datetime.datetime, lambda x, s: t.Timestamp(precision="microsecond"), lambda x: type(x) is t.Timestamp, lambda x, s: datetime.datetime)
for _hint, _kinds in ((int, (t.Int8, t.Int16, t.Int32)), (float, (t.Float16, t.Float32))):
    python.register(lambda x: False, lambda x, s: None, lambda x, k=_kinds: type(x) in k, lambda x, s, h=_hint: h)
python.register(lambda x: x is None or x is type(None), lambda x, s: t.Null(), lambda x: type(x) is t.Null, lambda x, s: type(None))


def _args(x: Any, origin: Any) -> bool:
    return get_origin(x) is origin


def _is_union(x: Any) -> bool:
    return get_origin(x) in (Union, py.UnionType)


def _union(x: Any, s: TypeSystem) -> t.Type:
    inner = [a for a in get_args(x) if a is not type(None)]
    nullable = len(inner) < len(get_args(x))
    if all(get_origin(a) is Literal for a in inner):
        found = _literal(Literal[tuple(v for a in inner for v in get_args(a))], s)
    elif len(inner) == 1:
        found = s.to_type(inner[0])
    else:
        raise NotImplementedError(f"only unions with None or of literals have a type, not {x}")
    return dataclasses.replace(found, nullable=nullable or found.nullable)


def _literal(x: Any, s: TypeSystem) -> t.Type:
    items = get_args(x)
    kinds = {type(v) for v in items}
    if len(kinds) != 1:
        raise ValueError(f"values of a Literal must be of one type, got {sorted(k.__name__ for k in kinds)}")
    return t.Enum(type=s.to_type(kinds.pop()), items=frozenset(items))


python.register(_is_union, _union, lambda x: x.nullable and type(x) is not t.Null, lambda x, s: Optional[s.from_type(dataclasses.replace(x, nullable=False))], priority=5)
python.register(lambda x: _args(x, Literal), _literal, lambda x: type(x) is t.Enum, lambda x, s: Literal[tuple(sorted(x.items, key=repr))])
python.register(lambda x: _args(x, Annotated), lambda x, s: next((n for n in get_args(x)[1:] if isinstance(n, t.Type)), None) or s.to_type(get_args(x)[0]), lambda x: False, lambda x, s: None, priority=6)
python.register(lambda x: _args(x, list), lambda x, s: t.List(element=s.to_type(get_args(x)[0])), lambda x: type(x) in (t.List, t.Collection), lambda x, s: list[s.from_type(x.element)])
python.register(lambda x: _args(x, tuple) and len(get_args(x)) == 2 and get_args(x)[1] is Ellipsis, lambda x, s: t.List(element=s.to_type(get_args(x)[0])), lambda x: False, lambda x, s: None)
python.register(lambda x: get_origin(x) in (set, frozenset), lambda x, s: t.Set(element=s.to_type(get_args(x)[0])), lambda x: type(x) is t.Set, lambda x, s: frozenset[s.from_type(x.element)], priority=1)
python.register(lambda x: isinstance(get_origin(x), type) and issubclass(get_origin(x), Mapping), lambda x, s: t.Map(key=s.to_type(get_args(x)[0]), value=s.to_type(get_args(x)[1])), lambda x: type(x) is t.Map, lambda x, s: dict[s.from_type(x.key), s.from_type(x.value)])


def _fields(x: Any, s: TypeSystem) -> t.Type:
    return t.Struct(name=x.__name__, fields={k: s.to_type(h) for k, h in get_type_hints(x, include_extras=True).items()})


python.register(is_typeddict, _fields, lambda x: type(x) is t.Struct, lambda x, s: TypedDict(x.name or "Struct", {k: s.from_type(f) for k, f in x.fields.items()}))  # type: ignore[misc]

#: Dataclasses, and models with `model_fields` (as pydantic's): structs; a named subtype of a scalar is the scalar.
models = TypeSystem("models", extends=python)


def _is_model(x: Any) -> bool:
    return isinstance(x, type) and (dataclasses.is_dataclass(x) or hasattr(x, "model_fields"))


def _model(x: Any, s: TypeSystem) -> t.Type:
    if hasattr(x, "model_fields"):
        return t.Struct(name=x.__name__, fields={k: s.to_type(f.annotation) for k, f in x.model_fields.items()})
    return _fields(x, s)


models.register(_is_model, _model, lambda x: type(x) is t.Struct, lambda x, s: dataclasses.make_dataclass(x.name or "Struct", [(k, s.from_type(f)) for k, f in x.fields.items()], frozen=True))
models.register(lambda x: isinstance(x, type) and x not in _SCALARS and not is_typeddict(x) and issubclass(x, (bytes, int, float, str)), lambda x, s: s.to_type(next(b for b in x.__mro__ if b in _SCALARS)), lambda x: False, lambda x, s: None, priority=-1)


def to_type(hint: Any) -> t.Type:
    return models.to_type(hint)


def from_type(found: t.Type) -> Any:
    return python.from_type(found)
