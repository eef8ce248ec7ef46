"""Readers and writers, found by the kinds of format, storage and view."""

from __future__ import annotations

import datetime
import json
import os
import pickle
import re
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weft import types
from weft.formats import CSV, JSON, Format, Parquet, Pickle
from weft.model import Fingerprint
from weft.session import current as session
from weft.sources import LocalFile, Partition, Snapshot, SparkFile, Storage, StringLiteral
from weft.sources.files import FileStorage
from weft.views import FrameView, PythonView, View

Reader = Callable[[types.Type, Format, Sequence[Partition]], Any]
Writer = Callable[[Any, types.Type, Format, Partition], "Fingerprint | None"]


class Registry[Handler]:
    """Handlers by the classes of what they take; the most special fitting one answers."""

    def __init__(self, what: str) -> None:
        self.what, self.found = what, {}

    def register(self, format: type[Format], storage: type[Storage], view: type[View]) -> Callable[[Handler], Handler]:
        for kind, base in ((format, Format), (storage, Storage), (view, View)):
            if not (isinstance(kind, type) and issubclass(kind, base)):
                raise TypeError(f"a {self.what} needs a subclass of {base.__name__}, got {kind!r}")

        def keep(handler: Handler) -> Handler:
            self.found[(format, storage, view)] = handler
            return handler

        return keep

    def lookup(self, format: type[Format], storage: type[Storage], view: type[View]) -> Handler:
        asked = (format, storage, view)
        fitting = [k for k in self.found if all(issubclass(a, b) for a, b in zip(asked, k, strict=True))]
        if not fitting:
            raise NotImplementedError(f"no {self.what} for {format.__name__}, {storage.__name__} and {view.__name__}")
        return self.found[min(fitting, key=lambda k: sum(a.__mro__.index(b) for a, b in zip(asked, k, strict=True)))]


readers: Registry[Reader] = Registry("reader")
writers: Registry[Writer] = Registry("writer")
register_reader, register_writer = readers.register, writers.register


def read(t: types.Type, format: Format, partitions: Sequence[Partition | Snapshot], view: type[View]) -> Any:
    found = [p.partition if isinstance(p, Snapshot) else p for p in partitions]
    if not found:
        raise FileNotFoundError("No data")
    if len(found) > 1 and not (isinstance(t, types.Collection) and t.is_partitioned):
        raise ValueError(f"{len(found)} partitions of what isn't a partitioned collection")
    found.sort(key=lambda p: repr(sorted(p.key.items())))
    return readers.lookup(type(format), type(found[0].storage), view)(t, format, found)


def write(data: Any, t: types.Type, format: Format, partition: Partition, view: type[View]) -> Snapshot:
    writers.lookup(type(format), type(partition.storage), view)(data, t, format, partition)
    return partition.snapshot()


# Plain values


def _with_key(rows: Any, p: Partition) -> Any:
    """Rows with the partition's key, which the type declares and the files may leave out."""
    if not p.key or not isinstance(rows, list):
        return rows
    return [{**{k: f.value for k, f in p.key.items()}, **row} if isinstance(row, dict) else row for row in rows]


def _values(load: Callable[[Partition], Any]) -> Reader:
    def run(t: types.Type, format: Format, partitions: Sequence[Partition]) -> Any:
        if isinstance(t, types.Collection) and t.is_partitioned:
            return [row for p in partitions for row in _with_key(load(p), p)]
        return load(partitions[0])

    return run


def _json_file(p: Partition) -> Any:
    if os.path.isdir(p.path):  # written from a DataFrame: a row each line
        return [json.loads(line) for name in sorted(os.listdir(p.path)) if name[0] not in "._" for line in open(os.path.join(p.path, name), encoding="utf-8")]
    with open(p.path, encoding="utf-8") as f:
        return json.load(f)


def _pickled(p: Partition) -> Any:
    with open(p.path, "rb") as f:
        return pickle.load(f)


def _default(value: Any) -> Any:
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (set, frozenset)):
        return sorted(value)
    raise TypeError(f"JSON has no {type(value).__name__}")


def dumps(value: Any) -> str:
    return json.dumps(value, default=_default, sort_keys=True)


def _put(partition: Partition, raw: bytes) -> None:
    os.makedirs(os.path.dirname(partition.path), exist_ok=True)
    staged = f"{partition.path}.{uuid.uuid4().hex}"
    with open(staged, "wb") as f:
        f.write(raw)
    os.replace(staged, partition.path)


register_reader(JSON, LocalFile, PythonView)(_values(_json_file))
register_reader(Pickle, LocalFile, PythonView)(_values(_pickled))
register_reader(JSON, StringLiteral, PythonView)(_values(lambda p: json.loads(p.storage.read(p))))  # type: ignore[attr-defined]
register_writer(JSON, LocalFile, PythonView)(lambda data, t, f, p: _put(p, dumps(data).encode()))
register_writer(Pickle, LocalFile, PythonView)(lambda data, t, f, p: _put(p, pickle.dumps(data)))
register_writer(JSON, StringLiteral, PythonView)(lambda data, t, f, p: p.storage.write(p, dumps(data)))  # type: ignore[attr-defined]


def _put_far(partition: Partition, raw: bytes) -> None:
    staged = f"{partition.path}.{uuid.uuid4().hex}"
    partition.storage.put(staged, raw)  # type: ignore[attr-defined]
    partition.storage.publish(staged, partition.path)  # type: ignore[attr-defined]


register_reader(JSON, SparkFile, PythonView)(_values(lambda p: json.loads(p.storage.get(p.path))))  # type: ignore[attr-defined]
register_reader(Pickle, SparkFile, PythonView)(_values(lambda p: pickle.loads(p.storage.get(p.path))))  # type: ignore[attr-defined]
register_writer(JSON, SparkFile, PythonView)(lambda data, t, f, p: _put_far(p, dumps(data).encode()))
register_writer(Pickle, SparkFile, PythonView)(lambda data, t, f, p: _put_far(p, pickle.dumps(data)))


# DataFrames


def _frame(t: types.Type, format: Format, partitions: Sequence[Partition]) -> DataFrame:
    """All partitions in one scan of exactly their paths; the key's fields come from the paths."""
    if not isinstance(t, types.Collection):
        raise TypeError(f"a {t.friendly_key} is no table")
    reader, inner = session().read, t.schema()
    inside = [f for f in inner.fields if f.name not in t.partition_by]
    plain = format.spark_name == "csv" or format.spark_name == "json"
    if plain:
        reader = reader.schema(type(inner)([type(f)(f.name, f.dataType, True) for f in inside]))
    if format.spark_name == "csv":
        reader = reader.option("header", True)
    if format.spark_name == "json":
        # A file that we didn't write holds one value, an array of rows; in a folder each line is a row.
        reader = reader.option("multiLine", not partitions[0].path or not _is_folder(partitions[0]))
    df = reader.format(format.spark_name).load([p.path for p in partitions])
    if t.partition_by:
        template, key_types = partitions[0].storage.templates["path"], partitions[0].storage.keys()
        pattern = template.pattern(key_types)
        numbered = [f"p{k}" for k in range(len(template.places)) if f"p{k}" in pattern.groupindex]
        java = _unnamed(pattern.pattern)
        parts: dict[str, dict[str, Any]] = {}
        for k, m in enumerate(template.places):
            if f"p{k}" in numbered and m["name"] in key_types:
                parts.setdefault(m["name"], {})[m["part"]] = F.regexp_extract("_metadata.file_path", f"{java}(?:/[^/]*)?$", pattern.groupindex[f"p{k}"])
        df = df.withColumns({name: key_types[name].column(parts[name]) for name in key_types})
    return types.conform(df, t)


def _is_folder(p: Partition) -> bool:
    if isinstance(p.storage, LocalFile):
        return os.path.isdir(p.path)
    system, where = p.storage._system(p.path)  # type: ignore[attr-defined]
    return system.getFileStatus(where).isDirectory()


def _unnamed(pattern: str) -> str:
    """A path pattern for Spark: groups by number; a component that comes again is taken as it is."""
    return re.sub(r"\(\?P=p\d+\)", "[^/]+", re.sub(r"\(\?P<p\d+>", "(", pattern))


def rows_digest(df: DataFrame) -> list:
    """Aggregates that tell a bag of rows, in any order and partitioning: its size and two sums of hashes."""
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})
    return [F.count(F.lit(1)).alias("n"), *(F.sum(F.xxhash64(F.lit(k), row).cast("decimal(20,0)")).alias(f"h{k}") for k in (1, 2))]


def stage(df: DataFrame, t: types.Collection, format: Format, partition: Partition) -> tuple[str, Fingerprint]:
    """Write beside the partition's place; the rows' fingerprint comes from the same job."""
    staged = f"{partition.path}.{uuid.uuid4().hex}"
    kept = types.conform(df, t)
    kept = kept.drop(*t.partition_by) if t.partition_by else kept
    if t.cluster_by:
        kept = kept.repartition(*t.cluster_by).sortWithinPartitions(*t.cluster_by)
    seen = Observation()
    writer = kept.observe(seen, *rows_digest(kept)).write
    if format.spark_name == "csv":
        writer = writer.option("header", True)
    writer.format(format.spark_name).save(staged)
    found = seen.get
    return staged, Fingerprint.of(found["n"], str(found["h1"]), str(found["h2"]))


def _write_frame(data: DataFrame, t: types.Type, format: Format, partition: Partition) -> None:
    staged, rows = stage(data, t, format, partition)  # type: ignore[arg-type]
    partition.storage.publish(staged, partition.path, rows)  # type: ignore[attr-defined]


for _format in (JSON, Parquet, CSV):
    register_reader(_format, FileStorage, FrameView)(_frame)
    register_writer(_format, FileStorage, FrameView)(_write_frame)


def _literal_frame(t: types.Type, format: Format, partitions: Sequence[Partition]) -> DataFrame:
    rows = _values(lambda p: json.loads(p.storage.read(p)))(t, format, partitions)  # type: ignore[attr-defined]
    plain = t.schema()  # type: ignore[attr-defined]
    raw = session().createDataFrame([(json.dumps(r, default=_default),) for r in rows], "row string")
    return types.conform(raw.select(F.from_json("row", plain).alias("r")).select("r.*"), t)  # type: ignore[arg-type]


register_reader(JSON, StringLiteral, FrameView)(_literal_frame)

try:
    from weft.views import PandasView
except ImportError:
    pass
else:

    def _pandas(t: types.Type, format: Format, partitions: Sequence[Partition]) -> Any:
        return readers.lookup(type(format), type(partitions[0].storage), FrameView)(t, format, partitions).toPandas()

    def _write_pandas(data: Any, t: types.Type, format: Format, partition: Partition) -> None:
        _write_frame(session().createDataFrame(data), t, format, partition)

    for _format in (JSON, Parquet, CSV):
        register_reader(_format, FileStorage, PandasView)(_pandas)
        register_writer(_format, FileStorage, PandasView)(_write_pandas)
    register_reader(JSON, StringLiteral, PandasView)(_pandas)


@register_reader(Parquet, FileStorage, PythonView)
@register_reader(CSV, FileStorage, PythonView)
def _rows(t: types.Type, format: Format, partitions: Sequence[Partition]) -> list:
    """A small table's rows as dicts on the driver."""
    return [r.asDict(recursive=True) for r in _frame(t, format, partitions).collect()]


@register_writer(Parquet, FileStorage, PythonView)
def _write_rows(data: list, t: types.Type, format: Format, partition: Partition) -> None:
    _write_frame(session().createDataFrame([tuple(r.get(k) for k in t.fields) for r in data], t.schema()), t, format, partition)  # type: ignore[attr-defined]
