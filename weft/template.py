"""Path templates with placeholders for names, tags, fingerprints and partition components.

``{date.Y}`` stands for a component of a partition key, ``{date.Y[1970]}`` for that component with a
fixed value, ``{name}`` for a plain value.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator, Mapping
from functools import cached_property

from weft.model import Fingerprint, frozendict
from weft.partitions import PartitionKey

_PLACE = re.compile(r"\{(?P<name>\w+)(?:\.(?P<part>\w+))?(?:\[(?P<fixed>[^\]]*)\])?(?::(?P<spec>[^}]*))?\}")


@dataclasses.dataclass(frozen=True)
class Template:
    text: str
    separator: str = "/"

    @cached_property
    def places(self) -> list[re.Match]:
        return list(_PLACE.finditer(self.text))

    @property
    def names(self) -> set[str]:
        return {m["name"] for m in self.places}

    def resolve(self, **values: str) -> Template:
        """Fill in some plain values. An empty one goes with the separator after it."""
        out = self.text
        for name, value in values.items():
            place = "{" + name + "}"
            if value == "":
                out = out.replace(place + self.separator, "").replace(place, "")
            else:
                out = out.replace(place, value)
        if out != self.text and "" in values.values():
            out = out.rstrip(self.separator)
        if not out:
            raise ValueError(f"nothing is left of {self.text!r} without its unused placeholders")
        return Template(out, self.separator)

    def locate(self, key: Mapping) -> str:
        """The path of a key; fixed components must agree with it."""

        def put(m: re.Match) -> str:
            if m["part"] is None or m["name"] not in key:
                return m[0]
            value = getattr(key[m["name"]], m["part"])
            if m["fixed"] is not None and str(value) != m["fixed"].lstrip("0") and str(value) != m["fixed"]:
                raise ValueError(f"{m[0]} is fixed, but the key has {value}")
            return format(value, m["spec"] or "")

        return _PLACE.sub(put, self.text)

    def _checked(self, key_types: Mapping) -> Iterator[re.Match]:
        for m in self.places:
            if m["name"] == "input_fingerprint":
                yield m
                continue
            if m["name"] not in key_types:
                raise ValueError(f"no partition key {m['name']!r}; there are {tuple(key_types)}")
            if m["part"] is None:
                raise ValueError(f"{m['name']!r} can't stand in a path itself, only one of its components")
            if m["part"] not in key_types[m["name"]].components:
                raise ValueError(f"{key_types[m['name']].__name__} has no component {m['part']!r}")
            yield m

    def wildcard(self, key_types: Mapping) -> str:
        """A glob for all partitions."""
        places = {m[0]: m["fixed"] if m["fixed"] is not None else "*" for m in self._checked(key_types)}
        return _PLACE.sub(lambda m: places[m[0]], self.text)

    def pattern(self, key_types: Mapping) -> re.Pattern:
        out, last, seen = [], 0, {}
        for k, m in enumerate(self._checked(key_types)):
            out.append(re.escape(self.text[last : m.start()]))
            mark = (m["name"], m["part"])
            if mark in seen:
                out.append(f"(?P={seen[mark]})")
            else:
                seen[mark] = f"p{k}"
                inner = r"-?\d+" if m["name"] == "input_fingerprint" else re.escape(m["fixed"]) if m["fixed"] is not None else "[^/]+"
                out.append(f"(?P<p{k}>{inner})")
            last = m.end()
        return re.compile("".join(out) + re.escape(self.text[last:]))

    def parse(self, path: str, key_types: Mapping) -> tuple[Fingerprint | None, PartitionKey]:
        """Input fingerprint and key of a path. Each field is read by its own class."""
        found = self.pattern(key_types).fullmatch(path)
        if not found:
            raise ValueError(f"can't read {path!r} by {self.text!r}")
        fingerprint, parts = None, {}
        for k, m in enumerate(self.places):
            if f"p{k}" not in found.groupdict():
                continue
            if m["name"] == "input_fingerprint":
                fingerprint = Fingerprint.from_int(int(found[f"p{k}"]))
            else:
                parts.setdefault(m["name"], {})[m["part"]] = found[f"p{k}"]
        if missing := set(key_types) - set(parts):
            raise ValueError(f"{self.text!r} has no place for the keys {sorted(missing)}")
        return fingerprint, PartitionKey({name: key_types[name].from_components(**parts[name]) for name in key_types})

    def parse_all(self, paths: list[str], key_types: Mapping) -> frozendict:
        return frozendict({p: self.parse(p, key_types) for p in paths})
