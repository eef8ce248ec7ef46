"""Other systems' types and how they become logical types.

A `TypeSystem` is a list of adapters in order of priority; what none of its own takes, the system that it
extends is asked for.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from typing import Any

from weft.types import Type


@dataclasses.dataclass
class Adapter:
    takes: Callable[[Any], bool]
    to_type: Callable[[Any, TypeSystem], Type]
    gives: Callable[[Type], bool]
    from_type: Callable[[Type, TypeSystem], Any]
    priority: int = 0


class TypeSystem:
    def __init__(self, name: str, extends: TypeSystem | None = None) -> None:
        self.name, self.extends, self.adapters = name, extends, []

    def register(self, takes: Callable, to_type: Callable, gives: Callable, from_type: Callable, priority: int = 0) -> None:
        self.adapters.append(Adapter(takes, to_type, gives, from_type, priority))
        self.adapters.sort(key=lambda a: -a.priority)

    def scalar(self, foreign: Any, kind: type[Type], back: bool = True, **kwargs: Any) -> None:
        """One foreign type for one logical type."""
        self.register(lambda x: _same(x, foreign), lambda x, s: kind(**kwargs), lambda t: back and type(t) is kind, lambda t, s: foreign)

    def to_type(self, found: Any, top: TypeSystem | None = None) -> Type:
        for a in self.adapters:
            if a.takes(found):
                return a.to_type(found, top or self)
        if self.extends:
            return self.extends.to_type(found, top or self)
        raise NotImplementedError(f"{(top or self).name} has no type for {found!r}")

    def from_type(self, t: Type, top: TypeSystem | None = None) -> Any:
        for a in self.adapters:
            if a.gives(t):
                return a.from_type(t, top or self)
        if self.extends:
            return self.extends.from_type(t, top or self)
        raise NotImplementedError(f"{(top or self).name} can't express a {t.friendly_key}")


def _same(a: Any, b: Any) -> bool:
    try:
        return type(a) is type(b) and bool(a == b)
    except (TypeError, ValueError):
        return a is b
