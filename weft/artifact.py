"""Artifacts: typed, stored data sets."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping
from typing import TYPE_CHECKING, Any

from weft import types
from weft.formats import JSON, Format
from weft.model import Model
from weft.sources import Storage, StringLiteral

if TYPE_CHECKING:
    from weft.producer import Producer


@dataclasses.dataclass(frozen=True, kw_only=True)
class Annotation(Model):
    """What people should know about an artifact."""


@dataclasses.dataclass(frozen=True)
class Output:
    """The producer of an artifact and its place among the producer's outputs."""

    producer: Producer
    position: int


class Artifact:
    """A data set's type, format and storage. Subclasses set defaults as class attributes.

    Two artifacts with the same class, type, format, storage and notes are equal, whatever produces them:
    so a change upstream doesn't by itself touch what lies below.
    """

    type: types.Type
    format: Format = JSON()
    storage: Storage = StringLiteral()
    annotations: tuple[Annotation, ...] = ()
    statistics: tuple[Any, ...] = ()

    def __init__(self, *, output: Output | None = None, **given: Any) -> None:
        if unknown := set(given) - {"type", "format", "storage", "annotations", "statistics"}:
            raise TypeError(f"{type(self).__name__} has no {sorted(unknown)}")
        cls = self.__class__
        own = {k: given.get(k, getattr(cls, k, None)) for k in ("type", "format", "storage")}
        if own["type"] is None:
            raise ValueError(f"{cls.__name__} needs a type")
        for k, base in (("type", types.Type), ("format", Format), ("storage", Storage)):
            if not isinstance(own[k], base):
                raise TypeError(f"{k} must be a {base.__name__}, got {own[k]!r}")
        own["format"].check(own["type"])
        own["storage"] = own["storage"].bind(type=own["type"], format=own["format"])
        # A class's notes come first, an instance's after them.
        for k in ("annotations", "statistics"):
            own[k] = tuple(getattr(cls, k)) + tuple(given.get(k, ()))
        self.__dict__.update(own, output=output)

    def __setattr__(self, name: str, value: Any) -> None:
        raise AttributeError(f"{self.__class__.__name__} can't be changed")

    def _with(self, **changes: Any) -> Artifact:
        out = object.__new__(self.__class__)
        out.__dict__.update({k: v for k, v in self.__dict__.items() if k not in ("fingerprint",)} | changes)
        return out

    @property
    def fingerprint(self) -> Any:
        from weft.model import Fingerprint

        return Fingerprint.of(self.__class__.__name__, self.type, self.format, self.storage, list(self.annotations))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Artifact) and self.fingerprint == other.fingerprint

    def __hash__(self) -> int:
        return hash(self.fingerprint)

    def __repr__(self) -> str:
        return f"{self.__class__.__name__}({self.type.friendly_key}, {self.storage})"

    @staticmethod
    def cast(value: Any) -> Artifact:
        """An artifact itself, the only output of a producer, or a literal."""
        from weft.producer import Producer

        if isinstance(value, Artifact):
            return value
        if isinstance(value, Producer):
            outputs = value.out() if not value.outputs else value.outputs
            outputs = outputs if isinstance(outputs, tuple) else (outputs,)
            if len(outputs) != 1:
                raise ValueError(f"{type(value).__name__} has {len(outputs)} outputs: name the one that is meant")
            return outputs[0]
        return literal(value)


def literal(value: Any) -> Artifact:
    from weft.io import dumps

    return Artifact(type=infer(value), format=JSON(), storage=StringLiteral(value=dumps(value)))


def infer(value: Any) -> types.Type:
    """The type of a plain value; elements of a container must be of one type."""
    import datetime

    for kind, t in ((bool, types.Boolean), (int, types.Int64), (float, types.Float64), (str, types.String), (datetime.datetime, types.Timestamp), (datetime.date, types.Date)):
        if type(value) is kind:
            return t()
    if value is None:
        return types.Null()
    if isinstance(value, (list, tuple, set, frozenset)):
        return (types.Set if isinstance(value, (set, frozenset)) else types.List)(element=_one(value))
    if isinstance(value, Mapping):
        return types.Map(key=_one(value.keys()), value=_one(value.values()))
    raise NotImplementedError(f"no type for {value!r}")


def _one(values: Any) -> types.Type:
    found = list(dict.fromkeys(map(infer, values)))
    if len(found) != 1:
        raise NotImplementedError(f"elements of {len(found)} types: {[t.friendly_key for t in found]}")
    return found[0]
