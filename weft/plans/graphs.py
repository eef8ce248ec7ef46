"""Small graphs around one producer or a few."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from typing import Annotated, Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft import types
from weft.artifact import Artifact
from weft.formats import Parquet
from weft.graph import Graph, GraphSnapshot
from weft.partitions import FIELDS, PartitionKey
from weft.producer import Producer, producer
from weft.session import fresh_dir
from weft.sources import SparkFile
from weft.sources.base import DEFAULT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str, name: str) -> Artifact:
    """A table of the folder as a raw artifact."""
    return Artifact(type=types.collection_of(table(spark, sf_dir, name)), format=Parquet(), storage=SparkFile(path=f"{sf_dir}/{name}.parquet"))


def made(name: str, build: Callable, inputs: list[str], outputs: int = 1, **kwargs: Any) -> type[Producer]:
    """A producer class of a function over DataFrames by name."""

    def run(**frames: Any) -> Any:
        return build(**frames)

    hint: Any = Annotated[DataFrame, Artifact] if outputs == 1 else tuple[(Annotated[DataFrame, Artifact],) * outputs]
    run.__signature__ = inspect.Signature([inspect.Parameter(k, inspect.Parameter.KEYWORD_ONLY) for k in inputs])  # type: ignore[attr-defined]
    run.__annotations__ = {k: Annotated[DataFrame, Artifact] for k in inputs} | {"return": hint}
    return producer(name=name, **kwargs)(run)


def output(spark: SparkSession, root: str, schema: Any, **kwargs: Any) -> Artifact:
    t = types.Collection(element=types.from_spark(schema), **kwargs)
    return Artifact(type=t, format=Parquet(), storage=SparkFile(path=f"{root}/{DEFAULT}"))


def built(spark: SparkSession, sf_dir: str, name: str, tables: list[str], build: Callable, **kwargs: Any) -> DataFrame:
    """The one output of a graph with one producer over whole tables."""
    snapshot = build_one(spark, sf_dir, name, tables, build, **kwargs)
    return snapshot.read(snapshot.artifacts.out, DataFrame)


def build_one(spark: SparkSession, sf_dir: str, name: str, tables: list[str], build: Callable, **kwargs: Any) -> GraphSnapshot:
    root = fresh_dir(spark)
    schema = build(**{t: table(spark, sf_dir, t) for t in tables}).schema
    with Graph(name) as g:
        inputs = {}
        for t in tables:
            setattr(g.artifacts.raw, t, raw(spark, sf_dir, t))
            inputs[t] = getattr(g.artifacts.raw, t)
        g.artifacts.out = made(name, build, tables, **kwargs)(**inputs).out(output(spark, root, schema))
    return g.build()


def parting(spark: SparkSession, sf_dir: str, source: str, keys: Mapping[str, Any], t: types.Collection) -> Callable:
    """A map that parts one raw table by the keys that are in it: one small job finds them."""

    def run(**snapshots: Any) -> dict:
        (found,) = snapshots.values()
        rows = table(spark, sf_dir, source).select(*(c.alias(k) for k, c in keys.items())).distinct().collect()
        return {PartitionKey({k: FIELDS[type(t.fields[k])](value=r[k]) for k in keys}): {source: found} for r in rows}

    run.__signature__ = inspect.Signature([inspect.Parameter(source, inspect.Parameter.KEYWORD_ONLY)])  # type: ignore[attr-defined]
    return run


def each(name: str) -> Callable:
    """A map of one output partition for each input partition."""

    def run(**snapshots: Any) -> dict:
        return {s.key: {name: [s]} for s in snapshots[name]}

    run.__signature__ = inspect.Signature([inspect.Parameter(name, inspect.Parameter.KEYWORD_ONLY)])  # type: ignore[attr-defined]
    return run


def event_keys() -> dict[str, Any]:
    return {"day": F.to_date("ts")}


def events_by(spark: SparkSession, sf_dir: str, g: Graph, keys: Mapping[str, Any], kinds: Mapping[str, types.Type], root: str) -> None:
    """In an open graph: the events as raw, and parted by the keys, in one job."""
    g.artifacts.raw.events = raw(spark, sf_dir, "events")
    cut = lambda events: events.withColumns(dict(keys))
    inner = {**types.collection_of(table(spark, sf_dir, "events")).fields, **kinds}
    t = types.Collection(element=types.Struct(fields=inner), partition_by=tuple(keys))
    part = made("part_events", cut, ["events"], map=parting(spark, sf_dir, "events", keys, t), one_job=True)
    g.artifacts.events = part(events=g.artifacts.raw.events).out(Artifact(type=t, format=Parquet(), storage=SparkFile(path=f"{root}/{DEFAULT}")))
