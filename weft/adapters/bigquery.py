"""BigQuery schemas as plain dicts, as its REST interface writes them; no client is needed."""

from __future__ import annotations

import dataclasses
from typing import Any

from weft import types as t

#: BigQuery's names, and the logical types that read as them.
_NAMES = {"BOOL": t.Boolean, "BYTES": t.Binary, "DATE": t.Date, "DATETIME": t.DateTime, "FLOAT64": t.Float64, "GEOGRAPHY": t.Geography, "INT64": t.Int64, "STRING": t.String, "TIME": t.Time, "TIMESTAMP": t.Timestamp}
_ALIASES = {"BOOLEAN": "BOOL", "FLOAT": "FLOAT64", "INTEGER": "INT64", "STRUCT": "RECORD"}
_INTS = (t.Int8, t.Int16, t.Int32, t.Int64)
_FLOATS = (t.Float16, t.Float32, t.Float64)


def to_field(name: str, found: t.Type) -> dict[str, Any]:
    """A column's schema."""
    if isinstance(found, t.List):
        if isinstance(found.element, t.List):
            raise ValueError(f"{name}: BigQuery has no arrays of arrays")
        return to_field(name, dataclasses.replace(found.element, nullable=False)) | {"mode": "REPEATED"}
    out: dict[str, Any] = {"name": name, "mode": "NULLABLE" if found.nullable else "REQUIRED"}
    if found.description:
        out["description"] = found.description
    if isinstance(found, t.Struct):
        return out | {"type": "RECORD", "fields": [to_field(k, f) for k, f in found.fields.items()]}
    if isinstance(found, _INTS):
        return out | {"type": "INT64"}
    if isinstance(found, _FLOATS):
        return out | {"type": "FLOAT64"}
    for title, kind in _NAMES.items():
        if type(found) is kind:
            if isinstance(found, t.Binary) and found.byte_size is not None:
                out["maxLength"] = found.byte_size
            return out | {"type": title}
    raise NotImplementedError(f"{name}: BigQuery can't express a {found.friendly_key}")


def from_field(found: dict[str, Any]) -> t.Type:
    title, mode = _ALIASES.get(found["type"], found["type"]), found.get("mode", "NULLABLE")
    note = {"description": found.get("description")}
    if title == "RECORD":
        inner: t.Type = t.Struct(fields={f["name"]: from_field(f) for f in found["fields"]}, **note)
    elif title == "BYTES":
        inner = t.Binary(byte_size=found.get("maxLength"), **note)
    elif title in _NAMES:
        inner = _NAMES[title](**note)
    else:
        raise NotImplementedError(f"no type for BigQuery's {found['type']}")
    return t.List(element=inner) if mode == "REPEATED" else dataclasses.replace(inner, nullable=mode == "NULLABLE")


def to_table(found: t.Collection) -> dict[str, Any]:
    """A table. One date field parts it by day; further partition fields come first in the clustering."""
    out: dict[str, Any] = {"tableReference": {"tableId": found.name}, "schema": {"fields": [to_field(k, f) for k, f in found.fields.items()]}}
    first, *more = found.partition_by or (None,)
    if first is not None:
        if not isinstance(found.fields[first], (t.Date, t.DateTime, t.Timestamp)):
            raise ValueError(f"{first}: BigQuery parts tables by days only")
        out["timePartitioning"] = {"type": "DAY", "field": first}
    if clustering := [*more, *found.cluster_by]:
        out["clustering"] = {"fields": clustering}
    return out


def from_table(found: dict[str, Any]) -> t.Collection:
    part = found.get("timePartitioning")
    if part and part["type"] != "DAY":
        raise NotImplementedError(f"tables parted by {part['type']}")
    return t.Collection(
        name=found.get("tableReference", {}).get("tableId"),
        element=t.Struct(fields={f["name"]: from_field(f) for f in found["schema"]["fields"]}),
        partition_by=(part["field"],) if part else (),
        cluster_by=tuple(found.get("clustering", {}).get("fields", ())),
    )
