"""Producers: functions from artifacts to artifacts."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Annotated, Any, ClassVar, get_args, get_origin, get_type_hints

from weft import io, types
from weft.artifact import Annotation, Artifact, Output
from weft.model import Fingerprint, frozendict
from weft.partitions import NotPartitioned, PartitionKey
from weft.sources import Snapshot
from weft.versions import SemVer, Version
from weft.views import View, check, view_for

#: Output key -> input name -> the partitions that it needs.
PartitionDependencies = Mapping[PartitionKey, Mapping[str, Sequence[Snapshot]]]


def _plain(hint: Any) -> Any:
    return get_args(hint)[0] if get_origin(hint) is Annotated else hint


def _artifact_of(hint: Any) -> type[Artifact] | None:
    if get_origin(hint) is not Annotated:
        return None
    found = [n for n in get_args(hint)[1:] if isinstance(n, type) and issubclass(n, Artifact)]
    if len(found) > 1:
        raise TypeError(f"{hint} names more than one artifact")
    return found[0] if found else None


def _function(cls: type, name: str) -> tuple[Callable, inspect.Signature, dict[str, Any]] | None:
    raw = inspect.getattr_static(cls, name, None)
    if raw is None:
        return None
    if not isinstance(raw, (staticmethod, classmethod)):
        raise TypeError(f"{cls.__name__}.{name} must be a static or class method")
    bound = getattr(cls, name)
    hints = get_type_hints(raw.__func__, include_extras=True)
    signature = inspect.signature(bound)
    for p in signature.parameters.values():
        where = f"{cls.__name__}.{name} {p.name} param"
        if p.kind in (p.VAR_POSITIONAL, p.VAR_KEYWORD, p.POSITIONAL_ONLY):
            raise TypeError(f"{where} must be usable as a keyword")
        if p.default is not p.empty:
            raise TypeError(f"{where} must not have a default")
    return bound, signature, hints


class Producer:
    """Subclasses declare inputs as fields annotated with artifact classes, and `build`.

    build takes inputs by name in the form its hints ask for, and gives what its return hint says: one
    ``Annotated[form, ArtifactClass]`` or a tuple of them. `map` says which input partitions an output
    partition needs; by default one output needs all. With `one_job`, `build` runs once over all missing output
    partitions together: rows of one output partition must then depend on its own inputs only.
    """

    annotations: ClassVar[tuple[Annotation, ...]] = ()
    version: ClassVar[Version] = SemVer(major=0, minor=0, patch=1)
    one_job: ClassVar[bool] = False

    input_types: ClassVar[dict[str, type[Artifact]]] = {}
    input_views: ClassVar[dict[str, type[View]]] = {}
    map_inputs: ClassVar[tuple[str, ...]] = ()
    output_types: ClassVar[tuple[type[Artifact], ...]] = ()
    output_views: ClassVar[tuple[type[View], ...]] = ()

    def __init_subclass__(cls, abstract: bool = False, **kwargs: Any) -> None:
        super().__init_subclass__(**kwargs)
        if abstract:
            return
        own = {k: v for k, v in get_type_hints(cls, include_extras=True).items() if get_origin(v) is not ClassVar and k not in Producer.__annotations__}
        for name, kind in own.items():
            if not (isinstance(kind, type) and issubclass(kind, Artifact)):
                raise TypeError(f"{cls.__name__}.{name} must be an Artifact class, got {kind!r}")
            if hasattr(cls, name):
                raise TypeError(f"{cls.__name__}.{name} must not have a default")
        cls.input_types = own
        cls._check_build()
        cls._check_map()
        if not isinstance(inspect.getattr_static(cls, "validate_outputs"), (staticmethod, classmethod)):
            raise TypeError(f"{cls.__name__}.validate_outputs must be a static or class method")

    @classmethod
    def _check_build(cls) -> None:
        found = _function(cls, "build")
        if found is None:
            raise TypeError(f"{cls.__name__} must have a build method")
        _, signature, hints = found
        views: dict[str, type[View]] = {}
        for name in signature.parameters:
            if name not in cls.input_types:
                raise TypeError(f"{cls.__name__}.build {name} param isn't a field of the producer")
            if name not in hints:
                raise TypeError(f"{cls.__name__}.build {name} param needs a type hint")
            named = _artifact_of(hints[name])
            if named is not None and not issubclass(cls.input_types[name], named):
                raise TypeError(f"{cls.__name__}.build {name} param names {named.__name__}, the field {cls.input_types[name].__name__}")
            views[name] = view_for(hints[name])
            declared = getattr(cls.input_types[name], "type", None)
            if isinstance(declared, types.Type):
                check(views[name], declared)
        cls.input_views = views
        if "return" not in hints:
            raise TypeError(f"{cls.__name__}.build needs a return type hint")
        given = hints["return"]
        if given is type(None):
            raise TypeError(f"{cls.__name__}.build must return something")
        several = get_origin(given) is tuple and Ellipsis not in get_args(given)
        outputs = get_args(given) if several else (given,)
        cls.output_types = tuple(_artifact_of(h) or _plain_artifact(_plain(h)) for h in outputs)
        cls.output_views = tuple(view_for(h) for h in outputs)
        schemes = set()
        for kind, view in zip(cls.output_types, cls.output_views, strict=True):
            declared = getattr(kind, "type", None)
            if isinstance(declared, types.Type):
                check(view, declared)
                schemes.add(PartitionKey.types_from(declared))
        if len(schemes) > 1:
            raise TypeError(f"{cls.__name__}: all outputs must be partitioned alike")
        if schemes and any(schemes) and _function(cls, "map") is None:
            raise TypeError(f"{cls.__name__} needs a map, as its outputs are partitioned")

    @classmethod
    def _check_map(cls) -> None:
        found = _function(cls, "map")
        if found is not None:
            for name in found[1].parameters:
                if name not in cls.input_types:
                    raise TypeError(f"{cls.__name__}.map {name} param isn't a field of the producer")
            cls.map_inputs = tuple(found[1].parameters)
        if unused := set(cls.input_types) - set(cls.input_views) - set(cls.map_inputs):
            raise TypeError(f"{cls.__name__} doesn't use its fields {sorted(unused)}")

    def __init__(self, **given: Any) -> None:
        if set(given) != set(self.input_types):
            raise TypeError(f"{type(self).__name__} takes {sorted(self.input_types)}, got {sorted(given)}")
        inputs = {}
        for name, value in given.items():
            found, wanted = Artifact.cast(value), self.input_types[name]
            if not isinstance(found, wanted):
                raise TypeError(f"{type(self).__name__}.{name} must be a {wanted.__name__}, got {found!r}")
            if name in self.input_views:
                check(self.input_views[name], found.type)
                io.readers.lookup(type(found.format), type(found.storage), self.input_views[name])
            inputs[name] = found
        self.inputs = frozendict(inputs)
        self.outputs: tuple[Artifact, ...] = ()

    @property
    def fingerprint(self) -> Fingerprint:
        return Fingerprint.of(type(self).__name__, self.version.fingerprint, {k: a.fingerprint for k, a in self.inputs.items()})

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Producer) and self.fingerprint == other.fingerprint

    def __hash__(self) -> int:
        return hash(self.fingerprint)

    def out(self, *artifacts: Artifact) -> Any:
        """Bind outputs by position; without any, those of the declared classes."""
        if not artifacts:
            artifacts = tuple(kind() for kind in self.output_types)
        if len(artifacts) != len(self.output_types):
            raise ValueError(f"{type(self).__name__} has {len(self.output_types)} outputs, got {len(artifacts)}")
        bound = []
        for k, (a, kind, view) in enumerate(zip(artifacts, self.output_types, self.output_views, strict=True)):
            if not isinstance(a, kind):
                raise TypeError(f"output {k} of {type(self).__name__} must be a {kind.__name__}, got {a!r}")
            if a.output is not None:
                raise ValueError(f"{a!r} is produced by {type(a.output.producer).__name__} already")
            check(view, a.type)
            io.writers.lookup(type(a.format), type(a.storage), view)
            bound.append(a._with(output=Output(self, k)))
        self.outputs = tuple(bound)
        return self.outputs[0] if len(bound) == 1 else self.outputs

    def __iter__(self) -> Iterator[Artifact]:
        found = self.outputs or self.out()
        return iter(found if isinstance(found, tuple) else (found,))

    # What a build needs

    def dependencies(self, inputs: Mapping[str, Sequence[Snapshot]]) -> dict[PartitionKey, dict[str, tuple[Snapshot, ...]]]:
        mapper = getattr(type(self), "map", None)
        if mapper is None:
            return {NotPartitioned: {k: tuple(v) for k, v in inputs.items()}}
        found = mapper(**{k: tuple(inputs[k]) for k in self.map_inputs})
        return {key: {k: tuple(v) for k, v in needs.items()} for key, needs in found.items()}

    def input_fingerprint(self, needs: Mapping[str, Sequence[Snapshot]]) -> Fingerprint:
        """Of the class, its version and every input by name, key and content, so that nothing cancels or is swapped."""
        if set(needs) != set(self.input_types):
            raise ValueError(f"{type(self).__name__} depends on {sorted(self.input_types)}, map gave {sorted(needs)}")
        parts = sorted((name, int(s.key.fingerprint.key), int(s.content.key)) for name, found in needs.items() for s in found)
        return Fingerprint.of(type(self).__name__, self.version.fingerprint, parts)

    @classmethod
    def validate_outputs(cls, *outputs: Any) -> tuple[bool, str]:
        return True, ""


def _plain_artifact(hint: Any) -> type[Artifact]:
    from weft.adapters.python import to_type

    return type("Artifact", (Artifact,), {"type": to_type(hint)}) if hint is not None else Artifact


def producer(
    *, annotations: Sequence[Annotation] = (), map: Callable | None = None, name: str | None = None, validate_outputs: Callable | None = None, version: Version | None = None, one_job: bool = False
) -> Callable[[Callable], type[Producer]]:
    """Make a producer class of a function; its parameters' hints give the inputs."""

    def make(build: Callable) -> type[Producer]:
        hints = get_type_hints(build, include_extras=True)
        fields = {p: _artifact_of(hints[p]) or Artifact for p in inspect.signature(build).parameters if p in hints}
        if map is not None:
            map_hints = get_type_hints(map, include_extras=True)
            for p in inspect.signature(map).parameters:
                fields.setdefault(p, _artifact_of(map_hints.get(p)) or Artifact)
        body: dict[str, Any] = {"__annotations__": fields, "build": staticmethod(build), "annotations": tuple(annotations), "one_job": one_job, "__module__": build.__module__, "__doc__": build.__doc__}
        if map is not None:
            body["map"] = staticmethod(map)
        if validate_outputs is not None:
            body["validate_outputs"] = staticmethod(validate_outputs)
        if version is not None:
            body["version"] = version
        return type(name or build.__name__, (Producer,), body)

    return make
