"""Builds of what is missing."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from graphlib import TopologicalSorter
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from weft import io, types
from weft.artifact import Artifact
from weft.graph import GraphSnapshot
from weft.model import Fingerprint
from weft.partitions import PartitionKey
from weft.producer import Producer
from weft.sources import Partition, Snapshot
from weft.sources.files import FileStorage
from weft.views import FrameView


class SparkExecutor:
    """A driver loop in topological order; the work of each partition is Spark's.

    threads: output partitions of a producer that are built at a time, as jobs side by side.
    """

    def __init__(self, threads: int = 4) -> None:
        self.threads = threads

    def build(self, snapshot: GraphSnapshot) -> None:
        graph = snapshot.graph
        outputs = graph.producer_outputs
        for node in TopologicalSorter(graph.dependencies).static_order():
            if isinstance(node, Producer):
                self.run(snapshot, node, outputs[node])

    def run(self, snapshot: GraphSnapshot, made: Producer, outputs: tuple[Artifact, ...]) -> None:
        if len(outputs) != len(made.output_types):
            raise ValueError(f"{type(made).__name__} has {len(made.output_types)} outputs, of which {len(outputs)} are in {snapshot.name}")
        inputs = {k: snapshot.partitions(a) for k, a in made.inputs.items()}
        for name, found in inputs.items():
            if not found:
                raise ValueError(f"{type(made).__name__}.{name} has no data")
        needs = made.dependencies(inputs)
        prints = {key: made.input_fingerprint(n) for key, n in needs.items()}
        missing = self.link_existing(snapshot, outputs, prints)
        if made.one_job and len(missing) > 1:
            self.build_together(snapshot, made, outputs, {k: needs[k] for k in missing}, prints)
        elif len(missing) == 1:
            self.build_one(snapshot, made, outputs, missing[0], needs[missing[0]], prints[missing[0]])
        elif missing:
            with ThreadPoolExecutor(max_workers=max(1, min(self.threads, len(missing)))) as pool:
                for done in [pool.submit(self.build_one, snapshot, made, outputs, key, needs[key], prints[key]) for key in missing]:
                    done.result()

    def link_existing(self, snapshot: GraphSnapshot, outputs: tuple[Artifact, ...], prints: Mapping[PartitionKey, Fingerprint]) -> list[PartitionKey]:
        """Link what is there already; a key counts as built only if every output has it."""
        with snapshot.graph.backend.connect() as b:
            known = [{s.key: s for s in b.partitions(a, prints)} for a in outputs]
            whole = {k for k in prints if all(k in found and a.storage.exists(found[k].partition) for a, found in zip(outputs, known, strict=True))}
            for a, found in zip(outputs, known, strict=True):
                b.link(snapshot, snapshot.graph.key_of(a), [found[k] for k in whole])
        return [k for k in prints if k not in whole]

    def read_inputs(self, made: Producer, needs: Mapping[str, tuple[Snapshot, ...]]) -> dict[str, Any]:
        return {k: io.read(made.inputs[k].type, made.inputs[k].format, list(needs[k]), view) for k, view in made.input_views.items()}

    def call(self, made: Producer, needs: Mapping[str, tuple[Snapshot, ...]]) -> tuple[Any, ...]:
        found = type(made).build(**self.read_inputs(made, needs))  # type: ignore[attr-defined]
        found = found if len(made.output_types) > 1 else (found,)
        if len(found) != len(made.output_types):
            raise ValueError(f"{type(made).__name__}.build gave {len(found)} outputs, not {len(made.output_types)}")
        return tuple(found)

    def build_one(self, snapshot: GraphSnapshot, made: Producer, outputs: tuple[Artifact, ...], key: PartitionKey, needs: Mapping[str, tuple[Snapshot, ...]], input_fingerprint: Fingerprint) -> None:
        """Write every output beside its place, check all, then put all in place and record them.

        Outputs that are made together share their computation, so it is kept until all are written.
        """
        found = self.call(made, needs)
        kept = [d.persist(StorageLevel.MEMORY_AND_DISK) for d in found if isinstance(d, DataFrame)] if len(found) > 1 else []
        try:
            self.place(snapshot, made, outputs, key, found, input_fingerprint)
        finally:
            for d in kept:
                d.unpersist()

    def place(self, snapshot: GraphSnapshot, made: Producer, outputs: tuple[Artifact, ...], key: PartitionKey, found: tuple[Any, ...], input_fingerprint: Fingerprint) -> None:
        places = [a.storage.partition(key, input_fingerprint) for a in outputs]
        staged: list[tuple[str, Fingerprint] | None] = []
        try:
            seen = []
            for data, a, place, view in zip(found, outputs, places, made.output_views, strict=True):
                if view is FrameView and isinstance(a.storage, FileStorage):
                    staged.append(io.stage(data, a.type, a.format, place))
                    # Validation reads what was written, so nothing is computed twice.
                    there = Partition(storage=a.storage, key=key, input_fingerprint=input_fingerprint, location=place.location | {"path": staged[-1][0]})
                    seen.append(_staged_frame(a, there, key))
                else:
                    staged.append(None)
                    seen.append(data)
            good, message = type(made).validate_outputs(*seen)
            if not good:
                raise ValueError(f"{type(made).__name__}: outputs aren't valid: {message}")
        except BaseException:
            for s, place in zip(staged, places, strict=False):
                if s is not None:
                    place.storage.drop(s[0])  # type: ignore[attr-defined]
            raise
        done = []
        for data, a, place, view, s in zip(found, outputs, places, made.output_views, staged, strict=True):
            if s is None:
                done.append(io.write(data, a.type, a.format, place, view))
            else:
                place.storage.publish(s[0], place.path, s[1])  # type: ignore[attr-defined]
                done.append(place.snapshot())
        self.record(snapshot, outputs, [[d] for d in done])

    def record(self, snapshot: GraphSnapshot, outputs: tuple[Artifact, ...], done: list[list[Snapshot]]) -> None:
        with snapshot.graph.backend.connect() as b:
            for a, found in zip(outputs, done, strict=True):
                b.record(a, found)
                b.link(snapshot, snapshot.graph.key_of(a), found)

    def build_together(self, snapshot: GraphSnapshot, made: Producer, outputs: tuple[Artifact, ...], needs: Mapping[PartitionKey, Mapping[str, tuple[Snapshot, ...]]], prints: Mapping[PartitionKey, Fingerprint]) -> None:
        """One job for all missing keys: one `build` over all their inputs, one partitioned write for each output.

        Checks and digests read what was written, so a single output is computed once and nothing is held;
        only outputs that share their computation are kept for it.
        """
        together = {name: tuple(dict.fromkeys(s for n in needs.values() for s in n[name])) for name in made.input_types}
        found = self.call(made, together)
        if not all(isinstance(d, DataFrame) for d in found):
            raise TypeError(f"{type(made).__name__} builds in one job, so its outputs must be DataFrames")
        kept = found if len(found) == 1 else tuple(d.persist(StorageLevel.MEMORY_AND_DISK) for d in found)
        places = [{k: a.storage.partition(k, prints[k]) for k in needs} for a in outputs]
        roots = [f"{next(iter(p.values())).path}.{uuid.uuid4().hex}" for p in places]
        try:
            written = [_write_parts(d, a, root) for d, a, root in zip(kept, outputs, roots, strict=True)]
            good, message = type(made).validate_outputs(*(types.conform(w, a.type) for w, a in zip(written, outputs, strict=True)))
            if not good:
                raise ValueError(f"{type(made).__name__}: outputs aren't valid: {message}")
            digests = [_part_digests(w, a, p) for w, a, p in zip(written, outputs, places, strict=True)]
            done = [self.publish_parts(a, p, root, rows) for a, p, root, rows in zip(outputs, places, roots, digests, strict=True)]
        finally:
            if kept is not found:
                for d in kept:
                    d.unpersist()
            for a, root in zip(outputs, roots, strict=True):
                a.storage.drop(root)  # type: ignore[attr-defined]
        self.record(snapshot, outputs, done)

    def publish_parts(self, a: Artifact, places: Mapping[PartitionKey, Partition], root: str, digests: Mapping[PartitionKey, Fingerprint]) -> list[Snapshot]:
        t: types.Collection = a.type  # type: ignore[assignment]
        out = []
        for key, place in places.items():
            if key in digests:
                staged, rows = root + "".join(f"/__{c}={key[c].value}" for c in t.partition_by), digests[key]
            else:  # a key without rows is a partition all the same
                empty = io.session().createDataFrame([], t.schema())
                staged, rows = io.stage(empty, t, a.format, place)
            place.storage.publish(staged, place.path, rows)  # type: ignore[attr-defined]
            out.append(place.snapshot())
        return out


def _write_parts(df: DataFrame, a: Artifact, root: str) -> DataFrame:
    """Write by key, and read that back. A key's rows meet in as many tasks as Spark finds right for their size."""
    t: types.Collection = a.type  # type: ignore[assignment]
    parts = {f"__{c}": F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None")) for c in t.partition_by}
    rows = types.conform(df, t).withColumns(parts).drop(*t.partition_by).hint("rebalance", *parts)
    writer = rows.write.partitionBy(*parts).format(a.format.spark_name)
    (writer.option("header", True) if a.format.spark_name == "csv" else writer).save(root)
    reader = io.session().read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields]))
    found = (reader.option("header", True) if a.format.spark_name == "csv" else reader).format(a.format.spark_name).load(root)
    fields = {c: f.spark() for c, f in t.partition_fields.items()}
    return found.withColumns({c: F.when(F.col(f"__{c}") != "None", F.col(f"__{c}")).cast(kind) for c, kind in fields.items()})


def _part_digests(written: DataFrame, a: Artifact, places: Mapping[PartitionKey, Partition]) -> dict[PartitionKey, Fingerprint]:
    t: types.Collection = a.type  # type: ignore[assignment]
    names = [f"__{c}" for c in t.partition_by]
    inner = written.select(*(c for c in t.fields if c not in t.partition_by))
    known = {tuple(str(k[c].value) for c in t.partition_by): k for k in places}
    out = {}
    for r in written.groupBy(*names).agg(*io.rows_digest(inner)).collect():  # a row for each output partition
        key = tuple(r[c] for c in names)
        if key not in known:
            raise ValueError(f"rows of a key that map doesn't name: {key}")
        out[known[key]] = Fingerprint.of(r["n"], str(r["h1"]), str(r["h2"]))
    return out


def _staged_frame(a: Artifact, there: Partition, key: PartitionKey) -> DataFrame:
    t: types.Collection = a.type  # type: ignore[assignment]
    inner = [f for f in t.schema().fields if f.name not in t.partition_by]
    reader = io.session().read.schema(type(t.schema())([type(f)(f.name, f.dataType, True) for f in inner]))
    if a.format.spark_name == "csv":
        reader = reader.option("header", True)
    df = reader.format(a.format.spark_name).load(there.path)
    return types.conform(df.withColumns({k: f.literal() for k, f in key.items()}), t)
