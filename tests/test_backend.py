"""Backends: the same contract for memory and for a folder that outlives the process."""

import dataclasses
import subprocess
import sys
import textwrap
from typing import Annotated, ClassVar

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft import JSON, Artifact, Backend, Connection, FolderBackend, Graph, GraphSnapshot, LocalFile, MemoryBackend, SparkFile, Storage, StringLiteral, producer, types
from weft.sources.base import DEFAULT

ROWS = types.Collection(element=types.Struct(fields={"date": types.Date(), "n": types.Int64()}), partition_by=("date",))


def graph(root, backend, calls, spark=None):
    @producer(map=lambda rows: {s.key: {"rows": [s]} for s in rows})
    def doubled(rows: Annotated[DataFrame, Artifact]) -> Annotated[DataFrame, Artifact]:
        calls.append((spark is not None) and spark.version)
        return rows.withColumn("n", F.col("n") * 2)

    with Graph("doubles", backend=backend) as g:
        g.artifacts.deep.rows = Artifact(type=ROWS, format=JSON(), storage=LocalFile(path=f"{root}/in/{{date.iso}}.json"))
        g.artifacts.out = doubled(rows=g.artifacts.deep.rows).out(Artifact(type=ROWS, format=JSON(), storage=SparkFile(path=f"{root}/out/{DEFAULT}")))
    return g


def put(root, day, n):
    (root / "in").mkdir(exist_ok=True)
    (root / "in" / f"{day}.json").write_text(f'[{{"n": {n}}}]')


def numbers(snapshot):
    return sorted(r.n for r in snapshot.read(snapshot.artifacts.out, DataFrame).collect())


@pytest.mark.parametrize("kind", ["memory", "folder"])
def test_the_contract(spark, tmp_path, kind):
    backend = MemoryBackend() if kind == "memory" else FolderBackend(f"{tmp_path}/records")
    calls = []
    put(tmp_path, "2020-01-01", 1)
    put(tmp_path, "2020-01-02", 2)
    g = graph(tmp_path, backend, calls)
    first = g.build()
    assert len(calls) == 2 and numbers(first) == [2, 4]
    first.tag("v 1/a")
    first.tag("v 1/a")  # the same again
    put(tmp_path, "2020-01-02", 5)
    second = g.build()
    assert len(calls) == 3 and numbers(second) == [2, 10] and numbers(first) == [2, 4]
    with pytest.raises(ValueError, match="already"):
        second.tag("v 1/a")
    with pytest.raises(ValueError, match="no tag"):
        GraphSnapshot.from_tag("doubles", "other", backend)
    old = GraphSnapshot.from_tag("doubles", "v 1/a", backend)
    assert old.id == first.id and numbers(old) == [2, 4]
    second.tag("v 1/a", overwrite=True)
    assert GraphSnapshot.from_tag("doubles", "v 1/a", backend).id == second.id
    with backend.connect() as c:
        assert len(c.partitions(g.artifacts.out)) == 3
        wanted = {s.key: s.input_fingerprint for s in first.partitions(g.artifacts.out)}
        assert c.partitions(g.artifacts.out, wanted) == first.partitions(g.artifacts.out)
        assert c.linked(first, "nothing.here" if kind == "memory" else "out") == (frozenset() if kind == "memory" else first.partitions(g.artifacts.out))


@pytest.mark.parametrize("kind", ["memory", "folder"])
def test_connections_are_passed_on(spark, tmp_path, kind):
    """With a connection, nothing goes through the graph's own backend."""

    class Closed(Backend):
        def connect(self):
            raise AssertionError("not this one")

    backend = MemoryBackend() if kind == "memory" else FolderBackend(f"{tmp_path}/records")
    put(tmp_path, "2020-01-01", 1)
    g = graph(tmp_path, backend, [])
    g.build()
    with backend.connect() as c, c.connect() as same:
        assert isinstance(c, Connection) and same is c
        g.backend = Closed()
        s = g.snapshot(connection=c)
        s.tag("t", connection=c)
        assert GraphSnapshot.from_tag("doubles", "t", c).id == s.id
        assert g.read(g.artifacts.deep.rows, list, connection=c)[0]["n"] == 1
        assert s.read(g.artifacts.deep.rows, list, connection=c)[0]["n"] == 1
        assert len(s.partitions(g.artifacts.deep.rows, connection=c)) == 1
        with pytest.raises(AssertionError, match="not this one"):
            g.snapshot()


def test_a_folder_outlives_the_graph(spark, tmp_path):
    """A second graph of the same code finds what was built, even with a session in its producers' code."""
    calls = []
    put(tmp_path, "2020-01-01", 1)
    graph(tmp_path, FolderBackend(f"{tmp_path}/records"), calls, spark).build().tag("kept")
    again = graph(tmp_path, FolderBackend(f"{tmp_path}/records"), calls, spark).build()
    assert len(calls) == 1 and numbers(again) == [2]
    kept = GraphSnapshot.from_tag("doubles", "kept", FolderBackend(f"{tmp_path}/records"))
    assert kept.id == again.id and kept.graph is not again.graph and kept.graph.fingerprint == again.graph.fingerprint
    put(tmp_path, "2020-01-01", 7)
    assert numbers(kept) == [2] and numbers(kept.graph.build()) == [14]


def test_a_folder_outlives_the_process(spark, tmp_path):
    put(tmp_path, "2020-01-01", 3)
    graph(tmp_path, FolderBackend(f"{tmp_path}/records"), []).build().tag("kept")
    code = f"""
        from pyspark.sql import DataFrame, SparkSession
        SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        from weft import FolderBackend, GraphSnapshot
        s = GraphSnapshot.from_tag("doubles", "kept", FolderBackend({f"{tmp_path}/records"!r}))
        print("found", [r.n for r in s.read(s.artifacts.out, DataFrame).collect()])
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=300)
    assert "found [6]" in done.stdout, done.stderr[-3000:]


def test_memory_looks_only_for_what_is_wanted(spark, tmp_path, monkeypatch):
    calls, digests = [], []
    plain = SparkFile.content_fingerprint
    monkeypatch.setattr(SparkFile, "content_fingerprint", lambda self, p: digests.append(p) or plain(self, p))
    for n in (1, 2, 3):  # three versions of one day
        put(tmp_path, "2020-01-01", n)
        graph(tmp_path, MemoryBackend(), calls).build()
    assert len(calls) == 3
    digests.clear()
    graph(tmp_path, MemoryBackend(), calls).build()
    assert len(calls) == 3 and len(digests) == 1


def test_storage_fields_are_their_partitions_fields():
    assert SparkFile.located == LocalFile.located == ("path",) and StringLiteral.located == ("id",)

    @dataclasses.dataclass(frozen=True, kw_only=True)
    class Table(Storage):
        located: ClassVar[tuple[str, ...]] = ("dataset", "name")
        plain_fields: ClassVar[tuple[str, ...]] = ("project",)
        project: str = "p"
        dataset: str = "d"
        name: str = "{name}"

    assert set(Table().templates) == {"dataset", "name"}
    with pytest.raises(TypeError, match=r"Odd has the fields \['name'\], but its partitions \['path'\]"):

        class Odd(Storage):
            located: ClassVar[tuple[str, ...]] = ("path",)
            name: str = "{name}"

    with pytest.raises(TypeError, match="More has the fields"):

        class More(SparkFile):
            table: str = "t"
