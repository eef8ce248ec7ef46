"""Graphs of artifacts and producers, and snapshots of them."""

from __future__ import annotations

import threading
from collections.abc import Iterator, Mapping
from functools import cached_property
from graphlib import TopologicalSorter
from typing import Any

from weft import io
from weft.artifact import Artifact
from weft.backend import Backend, Connection, MemoryBackend
from weft.model import Fingerprint, frozendict
from weft.partitions import NotPartitioned, PartitionKey
from weft.producer import Producer
from weft.sources import Snapshot
from weft.views import check, view_for

_open = threading.local()


class ArtifactBox:
    """A namespace of artifacts. While it is open, a missing name makes a box; names are set once."""

    def __init__(self, graph: Graph, path: tuple[str, ...] = ()) -> None:
        self.__dict__.update(_graph=graph, _path=path, _found={})

    def _check(self, name: str) -> None:
        if name.startswith("_"):
            raise ValueError(f"{name!r} can't name an artifact")

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__"):
            raise AttributeError(name)
        self._check(name)
        if name not in self._found:
            if self._graph.sealed:
                raise AttributeError(f"no artifact {'.'.join((*self._path, name))!r}")
            self._found[name] = ArtifactBox(self._graph, (*self._path, name))
        return self._found[name]

    __getitem__ = __getattr__

    def __setattr__(self, name: str, value: Any) -> None:
        self._check(name)
        if self._graph.sealed:
            raise ValueError(f"{self._graph.name} is closed")
        if name in self._found:
            raise ValueError(f"{'.'.join((*self._path, name))!r} is set already")
        self._found[name] = self._graph._bind(Artifact.cast(value), (*self._path, name))

    __setitem__ = __setattr__

    def __contains__(self, name: str) -> bool:
        return name in self._found

    def walk(self) -> Iterator[tuple[str, Artifact]]:
        for name, found in self._found.items():
            if isinstance(found, ArtifactBox):
                yield from ((f"{name}.{k}", a) for k, a in found.walk())
            else:
                yield name, found


class Graph:
    """A named graph. Artifacts are set in a ``with`` block, at whose end the graph is checked and closed."""

    def __init__(self, name: str, backend: Backend | None = None, path_tags: Mapping[str, str] = frozendict()) -> None:
        self.name, self.backend, self.path_tags = name, backend or MemoryBackend(), frozendict(path_tags)
        self.sealed = True
        self.artifacts = ArtifactBox(self)

    def __enter__(self) -> Graph:
        if getattr(_open, "graph", None) is not None:
            raise ValueError(f"{_open.graph.name} is open; graphs can't be nested")
        _open.graph, self.sealed = self, False
        return self

    def __exit__(self, kind: Any, *_: Any) -> None:
        _open.graph = None
        self.sealed = True
        for cached in ("keys", "dependencies", "producers"):
            self.__dict__.pop(cached, None)
        if kind is not None:
            return
        TopologicalSorter(self.dependencies).prepare()
        for p in self.producers:
            for name, a in p.inputs.items():
                if a not in self.keys:
                    raise ValueError(f"{type(p).__name__}.{name} isn't an artifact of {self.name}")

    def _bind(self, a: Artifact, names: tuple[str, ...]) -> Artifact:
        """An artifact with its storage placed in the graph; a new version of a produced one has its own place."""
        facts = {"graph": self.name, "tags": self.path_tags, "names": names}
        storage = a.storage.bind(**facts, **({"input_fingerprint": None} if a.output is None else {}))
        if a.output is not None:
            if getattr(storage, "value", None) is not None:
                raise ValueError(f"{'.'.join(names)} is produced, so its literal can't be set")
            if "input_fingerprint" not in storage.placeholders:
                raise ValueError(f"{'.'.join(names)} is produced, so its storage needs {{input_fingerprint}}")
        bound = a._with(storage=storage)
        if a.output is not None:
            made = a.output.producer
            made.outputs = tuple(bound if k == a.output.position else o for k, o in enumerate(made.outputs))
        return bound

    def __getstate__(self) -> dict:
        """For a backend that keeps graphs: without the backend itself, and without what is worked out again."""
        return {k: v for k, v in self.__dict__.items() if k not in ("backend", "keys", "dependencies", "producers")}

    def _closed(self) -> None:
        if not self.sealed:
            raise ValueError(f"{self.name} is still open")

    @cached_property
    def keys(self) -> dict[Artifact, str]:
        self._closed()
        return {a: k for k, a in self.artifacts.walk()}

    def key_of(self, a: Artifact) -> str:
        if a not in self.keys:
            raise KeyError(f"{a!r} isn't an artifact of {self.name}")
        return self.keys[a]

    @cached_property
    def producers(self) -> tuple[Producer, ...]:
        self._closed()
        return tuple(dict.fromkeys(a.output.producer for a in self.keys if a.output is not None))

    @property
    def producer_outputs(self) -> dict[Producer, tuple[Artifact, ...]]:
        out: dict[Producer, list[Artifact]] = {}
        for a in self.keys:
            if a.output is not None:
                out.setdefault(a.output.producer, []).append(a)
        return {p: tuple(sorted(found, key=lambda a: a.output.position)) for p, found in out.items()}

    @cached_property
    def dependencies(self) -> dict[Any, frozenset]:
        self._closed()
        out: dict[Any, frozenset] = {a: frozenset([a.output.producer]) if a.output else frozenset() for a in self.keys}
        return out | {p: frozenset(p.inputs.values()) for p in self.producers}

    @property
    def fingerprint(self) -> Fingerprint:
        self._closed()
        return Fingerprint.of(self.name, self.path_tags, sorted((k, int(a.fingerprint.key), a.output and int(a.output.producer.fingerprint.key), a.output and a.output.position) for a, k in self.keys.items()))

    def snapshot(self, *, connection: Connection | None = None) -> GraphSnapshot:
        """The graph with the content of its raw artifacts as it is now. connection: one that is open, instead of a new one."""
        self._closed()
        raw: dict[str, tuple[Snapshot, ...]] = {}
        for a, k in self.keys.items():
            if a.output is None:
                raw[k] = a.storage.discover()
                if not raw[k]:
                    raise ValueError(f"no data for {k}: {a.storage}")
        contents = sorted((k, int(s.key.fingerprint.key), int(s.content.key)) for k, found in raw.items() for s in found)
        made = GraphSnapshot(self, Fingerprint.of(self.fingerprint, contents))
        with (connection or self.backend).connect() as b:
            b.write_graph(self)
            b.write_snapshot(made)
            for a, k in self.keys.items():
                if k in raw:
                    b.record(a, raw[k])
                    b.link(made, k, raw[k])
        return made

    def build(self, executor: Any = None) -> GraphSnapshot:
        return self.snapshot().build(executor)

    def read(self, a: Artifact, annotation: Any = None, *, view: Any = None, connection: Connection | None = None) -> Any:
        """An artifact's data as the hint or view says. What is produced is read by a snapshot of now."""
        found = _view(annotation, view)
        if a.output is not None:
            return self.snapshot(connection=connection).read(a, view=found, connection=connection)
        self.key_of(a)
        check(found, a.type)
        return io.read(a.type, a.format, a.storage.discover(), found)

    def write(self, data: Any, a: Artifact, *, input_fingerprint: Fingerprint | None = None, key: PartitionKey = NotPartitioned, view: Any = None, snapshot: GraphSnapshot | None = None, connection: Connection | None = None) -> Snapshot:
        """Write one partition and record it."""
        k = self.key_of(a)
        if a.output is None and snapshot is not None:
            raise ValueError(f"{k} is raw: it can't be written to a snapshot")
        found = view_for(view or type(data))
        check(found, a.type)
        made = io.write(data, a.type, a.format, a.storage.partition(key, input_fingerprint), found)
        with (connection or self.backend).connect() as b:
            b.record(a, [made])
            if snapshot is not None:
                b.link(snapshot, k, [made])
        return made


class GraphSnapshot:
    """A graph pinned to the content of its raw data."""

    def __init__(self, graph: Graph, id: Fingerprint) -> None:
        self.graph, self.id = graph, id

    @property
    def name(self) -> str:
        return self.graph.name

    @property
    def artifacts(self) -> ArtifactBox:
        return self.graph.artifacts

    def build(self, executor: Any = None) -> GraphSnapshot:
        from weft.executor import SparkExecutor

        (executor or SparkExecutor()).build(self)
        return self

    def partitions(self, a: Artifact, *, connection: Connection | None = None) -> frozenset[Snapshot]:
        with (connection or self.graph.backend).connect() as b:
            return b.linked(self, self.graph.key_of(a))

    def read(self, a: Artifact, annotation: Any = None, *, view: Any = None, verify: bool = False, connection: Connection | None = None) -> Any:
        """As of the snapshot. verify: fail if the data changed since."""
        found = _view(annotation, view)
        check(found, a.type)
        parts = self.partitions(a, connection=connection)
        if verify:
            for s in parts:
                if s.partition.snapshot().content != s.content:
                    raise ValueError(f"{s.partition.location} isn't what it was at the snapshot")
        return io.read(a.type, a.format, list(parts), found)

    def write(self, data: Any, a: Artifact, **kwargs: Any) -> Snapshot:
        return self.graph.write(data, a, snapshot=self, **kwargs)

    def tag(self, tag: str, overwrite: bool = False, *, connection: Connection | None = None) -> None:
        with (connection or self.graph.backend).connect() as b:
            b.write_tag(self, tag, overwrite)

    @classmethod
    def from_tag(cls, name: str, tag: str, backend: Backend | Connection) -> GraphSnapshot:
        with backend.connect() as b:
            return b.read_tag(name, tag)


def _view(annotation: Any, view: Any) -> Any:
    if (annotation is None) == (view is None):
        raise ValueError("exactly one of annotation and view is needed")
    return view_for(annotation if view is None else view)
