"""Identities: 64-bit fingerprints and frozen values that have one."""

from __future__ import annotations

import dataclasses
import datetime
import hashlib
import json
from collections.abc import Iterable, Mapping
from functools import cached_property
from typing import Any

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


class int64(int):
    """A signed 64-bit number; arithmetic stays in range or fails."""

    low, high = _LOW, _HIGH

    def __new__(cls, value: Any = 0) -> int64:
        if isinstance(value, uint64):
            value = int(value) - (1 << 64) if int(value) > _HIGH else int(value)
        number = int(value)
        if not cls.low <= number <= cls.high:
            raise ValueError(f"{number} is out of the range of {cls.__name__}")
        return super().__new__(cls, number)


class uint64(int):
    """An unsigned 64-bit number; arithmetic stays in range or fails."""

    low, high = 0, (1 << 64) - 1

    def __new__(cls, value: Any = 0) -> uint64:
        if isinstance(value, int64) and value < 0:
            value = int(value) + (1 << 64)
        number = int(value)
        if not cls.low <= number <= cls.high:
            raise ValueError(f"{number} is out of the range of {cls.__name__}")
        return super().__new__(cls, number)


def _closed(kind: type, name: str) -> None:
    plain = getattr(int, name)

    def method(self: Any, *others: Any) -> Any:
        out = plain(self, *others)
        return out if out is NotImplemented else kind(out)

    setattr(kind, name, method)


for _kind in (int64, uint64):
    for _name in ("add", "radd", "sub", "rsub", "mul", "rmul", "floordiv", "rfloordiv", "mod", "rmod", "and", "rand", "or", "ror", "xor", "rxor", "lshift", "rshift", "neg", "pos", "abs", "invert"):
        if not (_kind is uint64 and _name == "invert"):
            _closed(_kind, f"__{_name}__")


@dataclasses.dataclass(frozen=True, order=True)
class Fingerprint:
    """A signed 64-bit identity. `combine` is symmetric: zero is its identity, and equal ones cancel.

    Where order or repetition matters, as for a producer's inputs, use `of`.
    """

    key: int64

    @classmethod
    def from_int(cls, value: int) -> Fingerprint:
        return cls(int64(value))

    @classmethod
    def from_string(cls, value: str) -> Fingerprint:
        return cls(int64(int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big", signed=True)))

    @classmethod
    def of(cls, *parts: Any) -> Fingerprint:
        """Of an ordered list of plain values."""
        return cls.from_string(json.dumps(parts, sort_keys=True, separators=(",", ":"), default=_plain))

    @classmethod
    def identity(cls) -> Fingerprint:
        return cls(int64(0))

    def combine(self, *others: Fingerprint) -> Fingerprint:
        out = int(self.key)
        for other in others:
            out ^= int(other.key)
        return Fingerprint.from_int(out)

    @property
    def is_identity(self) -> bool:
        return self.key == 0

    def __str__(self) -> str:
        return str(int(self.key))


def _plain(value: Any) -> Any:
    if isinstance(value, Fingerprint):
        return int(value.key)
    if isinstance(value, Model):
        return int(value.fingerprint.key)
    if isinstance(value, (frozenset, set)):
        return sorted((json.dumps(x, default=_plain) for x in value))
    if isinstance(value, Mapping):
        return dict(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, bytes):
        return value.hex()
    if isinstance(value, type):
        return value.__qualname__
    raise TypeError(f"{value!r} has no fingerprint")


class frozendict(dict):
    """An immutable, hashable mapping; the hash doesn't depend on the order."""

    def __hash__(self) -> int:  # type: ignore[override]
        return hash(frozenset(self.items()))

    def __or__(self, other: Mapping) -> frozendict:  # type: ignore[override]
        return frozendict({**self, **other})

    def __ror__(self, other: Mapping) -> frozendict:  # type: ignore[override]
        return frozendict({**other, **self})

    def __reduce__(self) -> tuple:
        return type(self), (dict(self),)

    def _closed(self, *_: Any, **__: Any) -> Any:
        raise TypeError("a frozendict can't be changed")

    __setitem__ = __delitem__ = __ior__ = clear = pop = popitem = setdefault = update = _closed  # type: ignore[assignment]


def skipped(default: Any = dataclasses.MISSING, **kwargs: Any) -> Any:
    """A field that isn't part of the fingerprint."""
    return dataclasses.field(default=default, metadata={"skip": True}, compare=kwargs.pop("compare", False), **kwargs)


@dataclasses.dataclass(frozen=True, kw_only=True)
class Model:
    """A frozen value whose fingerprint is that of its type's name and its fields."""

    @cached_property
    def fingerprint(self) -> Fingerprint:
        fields = {f.name: getattr(self, f.name) for f in dataclasses.fields(self) if not f.metadata.get("skip")}
        return Fingerprint.of(type(self).__name__, fields)

    def with_(self, **changes: Any) -> Any:
        return dataclasses.replace(self, **changes)


def one_or_none(values: Iterable[Any], what: str) -> Any:
    found = list(values)
    if len(found) > 1:
        raise ValueError(f"more than one {what}: {found}")
    return found[0] if found else None
