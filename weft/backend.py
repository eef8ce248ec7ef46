"""Where graphs, snapshots, tags and partitions are recorded."""

from __future__ import annotations

import io
import json
import sys
import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager
from typing import TYPE_CHECKING, Any, Self
from urllib.parse import quote

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.model import Fingerprint, frozendict
from weft.partitions import InputFingerprints, PartitionField, PartitionKey
from weft.producer import Producer
from weft.session import current
from weft.sources import Partition, Snapshot, SparkFile, Storage

if TYPE_CHECKING:
    from weft.artifact import Artifact
    from weft.graph import Graph, GraphSnapshot


class Connection(ABC):
    """What can be asked of a backend. A connection connects to itself, so ``(connection or backend).connect()`` takes either."""

    @contextmanager
    def connect(self) -> Iterator[Self]:
        yield self

    # Partitions of a storage

    @abstractmethod
    def partitions(self, artifact: Artifact, wanted: Mapping = InputFingerprints()) -> frozenset[Snapshot]:
        """What is known of an artifact's storage; `wanted` keeps the keys that it has, with those input fingerprints."""

    @abstractmethod
    def record(self, artifact: Artifact, snapshots: Iterable[Snapshot]) -> None: ...

    # Graphs and snapshots

    @abstractmethod
    def write_graph(self, graph: Graph) -> None: ...

    @abstractmethod
    def read_graph(self, name: str, fingerprint: Fingerprint) -> Graph: ...

    @abstractmethod
    def write_snapshot(self, snapshot: GraphSnapshot) -> None: ...

    @abstractmethod
    def read_snapshot(self, name: str, id: Fingerprint) -> GraphSnapshot: ...

    @abstractmethod
    def link(self, snapshot: GraphSnapshot, key: str, found: Iterable[Snapshot]) -> None:
        """Make partitions those of a snapshot's artifact, beside the ones that are already."""

    @abstractmethod
    def linked(self, snapshot: GraphSnapshot, key: str) -> frozenset[Snapshot]: ...

    # Tags

    @abstractmethod
    def write_tag(self, snapshot: GraphSnapshot, tag: str, overwrite: bool = False) -> None:
        """ValueError if the tag is another snapshot's and mustn't be overwritten."""

    @abstractmethod
    def read_tag(self, name: str, tag: str) -> GraphSnapshot:
        """ValueError if there is no such tag."""


class Backend(ABC):
    """A place of records, to which connections are made."""

    @abstractmethod
    def connect(self) -> Any:
        """A context manager that gives a `Connection`."""


class MemoryBackend(Connection, Backend):
    """A process's memory. A copy is the same backend."""

    def __init__(self) -> None:
        self._partitions: dict[Storage, set[Snapshot]] = {}
        self._looked: dict[Storage, set] = {}  # keys with input fingerprints that were looked for, or None for all
        self._graphs: dict[str, dict[Fingerprint, Graph]] = {}
        self._snapshots: dict[str, dict[Fingerprint, GraphSnapshot]] = {}
        self._tags: dict[str, dict[str, Fingerprint]] = {}
        self._linked: dict[tuple[Fingerprint, str], set[Snapshot]] = {}

    def __copy__(self) -> Self:
        return self

    def __deepcopy__(self, memo: dict) -> Self:
        return self

    def partitions(self, artifact: Artifact, wanted: Mapping = InputFingerprints()) -> frozenset[Snapshot]:
        """What is known. A storage that wasn't looked through yet is, for what is wanted only: earlier versions aren't digested."""
        storage = artifact.storage
        found, looked = self._partitions.setdefault(storage, set()), self._looked.setdefault(storage, set())
        if None not in looked:
            new = set(wanted.items()) - looked - {(s.key, s.input_fingerprint) for s in found}
            if new or not wanted:
                found.update(storage.discover(InputFingerprints(new)))
                looked.update(new or {None})
        return frozenset(s for s in found if not wanted or (s.key in wanted and wanted[s.key] == s.input_fingerprint))

    def record(self, artifact: Artifact, snapshots: Iterable[Snapshot]) -> None:
        self._partitions.setdefault(artifact.storage, set()).update(snapshots)

    def write_graph(self, graph: Graph) -> None:
        self._graphs.setdefault(graph.name, {})[graph.fingerprint] = graph

    def read_graph(self, name: str, fingerprint: Fingerprint) -> Graph:
        return self._graphs[name][fingerprint]

    def write_snapshot(self, snapshot: GraphSnapshot) -> None:
        self._snapshots.setdefault(snapshot.name, {})[snapshot.id] = snapshot

    def read_snapshot(self, name: str, id: Fingerprint) -> GraphSnapshot:
        return self._snapshots[name][id]

    def link(self, snapshot: GraphSnapshot, key: str, found: Iterable[Snapshot]) -> None:
        self._linked.setdefault((snapshot.id, key), set()).update(found)

    def linked(self, snapshot: GraphSnapshot, key: str) -> frozenset[Snapshot]:
        return frozenset(self._linked.get((snapshot.id, key), ()))

    def write_tag(self, snapshot: GraphSnapshot, tag: str, overwrite: bool = False) -> None:
        tags = self._tags.setdefault(snapshot.name, {})
        if tag in tags and not overwrite and tags[tag] != snapshot.id:
            raise ValueError(f"{snapshot.name} has the tag {tag!r} already")
        tags[tag] = snapshot.id

    def read_tag(self, name: str, tag: str) -> GraphSnapshot:
        if tag not in self._tags.get(name, {}):
            raise ValueError(f"{name} has no tag {tag!r}")
        return self.read_snapshot(name, self._tags[name][tag])


class FolderBackend(Backend):
    """A folder of any store that Spark reaches; it outlives the process, and several drivers may write to it.

    Partitions and links are JSON tables, to which every write adds one file; a file gets its name when it is whole.
    Graphs are pickled with their producers' code, so read only folders that are trusted. Values of produced
    `StringLiteral`s live in a process's memory, so another process builds them again.
    """

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    @contextmanager
    def connect(self) -> Iterator[FolderConnection]:
        yield FolderConnection(self)


_ROW = T.StructType([T.StructField("key", T.StringType()), T.StructField("input_fingerprint", T.LongType()), T.StructField("content", T.LongType()), T.StructField("location", T.StringType())])


class FolderConnection(Connection):
    def __init__(self, backend: FolderBackend) -> None:
        self.backend = backend

    def _at(self, *names: Any) -> str:
        return "/".join((self.backend.path, *(quote(str(n), safe="") for n in names)))

    def _put(self, path: str, raw: bytes, overwrite: bool = True) -> bool:
        """Write beside the place, then rename. Whether the place took it."""
        system, target = SparkFile._system(path)
        folder, name = path.rsplit("/", 1)
        _, staged = SparkFile._system(f"{folder}/_{name}.{uuid.uuid4().hex}")
        SparkFile().put(staged.toString(), raw)
        if overwrite:
            system.delete(target, False)
        elif system.exists(target):
            system.delete(staged, False)
            return False
        return system.rename(staged, target)

    def _get(self, path: str) -> bytes | None:
        system, where = SparkFile._system(path)
        return SparkFile().get(path) if system.exists(where) else None

    # A table of partitions

    def _add(self, folder: str, snapshots: Iterable[Snapshot]) -> None:
        lines = []
        for s in snapshots:
            key = {k: {c: str(getattr(f, c)) for c in f.default_components} for k, f in s.key.items()}
            made = s.input_fingerprint
            lines.append(json.dumps({"key": json.dumps(key), "input_fingerprint": None if made is None else int(made.key), "content": int(s.content.key), "location": json.dumps(s.partition.location)}))
        if lines:
            self._put(f"{folder}/{uuid.uuid4().hex}.json", "\n".join(lines).encode())

    def _rows(self, folder: str, storage: Storage, wanted: Mapping = InputFingerprints()) -> frozenset[Snapshot]:
        system, where = SparkFile._system(folder)
        if not system.exists(where):
            return frozenset()
        rows: DataFrame = current().read.schema(_ROW).json(folder)
        if wanted:  # other versions don't come to the driver
            prints = sorted({None if f is None else int(f.key) for f in wanted.values()}, key=str)
            few = current().createDataFrame([(p,) for p in prints], "wanted long")
            rows = rows.join(few, F.col("input_fingerprint").eqNullSafe(F.col("wanted")), "left_semi")
        out = set()
        for r in rows.distinct().collect():  # a row for each partition, as the driver's loop over them needs
            key = PartitionKey({k: storage.keys()[k].from_components(**found) for k, found in json.loads(r.key).items()})
            made = None if r.input_fingerprint is None else Fingerprint.from_int(r.input_fingerprint)
            if not wanted or (key in wanted and wanted[key] == made):
                place = Partition(storage=storage, key=key, input_fingerprint=made, location=frozendict(json.loads(r.location)))
                out.add(Snapshot(partition=place, content=Fingerprint.from_int(r.content)))
        return frozenset(out)

    def partitions(self, artifact: Artifact, wanted: Mapping = InputFingerprints()) -> frozenset[Snapshot]:
        return self._rows(self._at("partitions", artifact.storage.fingerprint), artifact.storage, wanted)

    def record(self, artifact: Artifact, snapshots: Iterable[Snapshot]) -> None:
        self._add(self._at("partitions", artifact.storage.fingerprint), snapshots)

    def link(self, snapshot: GraphSnapshot, key: str, found: Iterable[Snapshot]) -> None:
        self._add(self._at("links", snapshot.id, key), found)

    def linked(self, snapshot: GraphSnapshot, key: str) -> frozenset[Snapshot]:
        storage = dict(snapshot.graph.artifacts.walk())[key].storage
        return self._rows(self._at("links", snapshot.id, key), storage)

    # Graphs, snapshots and tags

    def write_graph(self, graph: Graph) -> None:
        path = self._at("graphs", graph.name, graph.fingerprint)
        system, where = SparkFile._system(path)
        if not system.exists(where):
            raw = io.BytesIO()
            _Pickler(raw).dump(graph)
            self._put(path, raw.getvalue(), overwrite=False)

    def read_graph(self, name: str, fingerprint: Fingerprint) -> Graph:
        raw = self._get(self._at("graphs", name, fingerprint))
        if raw is None:
            raise KeyError(f"no graph {name} {fingerprint}")
        graph = cloudpickle.loads(raw)
        graph.backend = self.backend
        return graph

    def write_snapshot(self, snapshot: GraphSnapshot) -> None:
        self._put(self._at("snapshots", snapshot.name, snapshot.id), str(snapshot.graph.fingerprint).encode(), overwrite=False)

    def read_snapshot(self, name: str, id: Fingerprint) -> GraphSnapshot:
        from weft.graph import GraphSnapshot

        found = self._get(self._at("snapshots", name, id))
        if found is None:
            raise KeyError(f"no snapshot {name} {id}")
        return GraphSnapshot(self.read_graph(name, Fingerprint.from_int(int(found))), id)

    def write_tag(self, snapshot: GraphSnapshot, tag: str, overwrite: bool = False) -> None:
        path = self._at("tags", snapshot.name, tag)
        if not self._put(path, str(snapshot.id).encode(), overwrite) and self._get(path) != str(snapshot.id).encode():
            raise ValueError(f"{snapshot.name} has the tag {tag!r} already")

    def read_tag(self, name: str, tag: str) -> GraphSnapshot:
        found = self._get(self._at("tags", name, tag))
        if found is None:
            raise ValueError(f"{name} has no tag {tag!r}")
        return self.read_snapshot(name, Fingerprint.from_int(int(found)))


def _found_by_name(kind: type) -> bool:
    found: Any = sys.modules.get(kind.__module__) if kind.__module__ != "__main__" else None
    for name in kind.__qualname__.split("."):
        found = getattr(found, name, None)
    return found is kind


def _whole_class(name: str, bases: tuple[type, ...], body: dict[str, Any]) -> type:
    return type(name, bases, body)


class _Pickler(cloudpickle.Pickler):
    """A session that a producer's code holds becomes the session of whoever reads. Classes that are checked when they are
    made come with all that they hold at once."""

    def reducer_override(self, obj: Any) -> Any:
        if isinstance(obj, SparkSession):
            return current, ()
        if isinstance(obj, type) and issubclass(obj, (Producer, PartitionField)) and not _found_by_name(obj):
            return _whole_class, (obj.__name__, obj.__bases__, {k: v for k, v in obj.__dict__.items() if k not in ("__dict__", "__weakref__")})
        return super().reducer_override(obj)
