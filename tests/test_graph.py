import datetime
import json
import os
from typing import Annotated

import pandas as pd
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft import CSV, JSON, Annotation, Artifact, Fingerprint, Graph, GraphSnapshot, LocalFile, MemoryBackend, Parquet, PartitionKey, Pickle, Producer, SparkExecutor, SparkFile, StringLiteral, producer
from weft import types as t
from weft.artifact import infer, literal
from weft.partitions import DateField, Int64Field
from weft.versions import GitCommit, SemVer, Source, String, Timestamp
from weft.views import DateTimes, FrameView, ListOf, View, check, register, view_for

DAYS = {"1970-01-01": [(1, 9.95), (2, 7.5)], "1970-01-02": [(3, 5.0), (4, 12.0), (4, 7.55)]}


class Num(Artifact):
    type = t.Int64()
    format = JSON()
    storage = StringLiteral()


class Transactions(Artifact):
    type = t.Collection(element=t.Struct(fields={"id": t.Int64(), "date": t.Date(), "amount": t.Float64()}), partition_by=("date",))
    format = JSON()


class Total(Artifact):
    type = t.Float64()
    format = JSON()
    storage = LocalFile()


class ByDay(Artifact):
    type = t.Collection(element=t.Struct(fields={"date": t.Date(), "n": t.Int64(), "amount": t.Float64()}), partition_by=("date",))
    format = Parquet()


def put(root, day, rows):
    os.makedirs(root, exist_ok=True)
    (root / f"{day}.json").write_text(json.dumps([{"id": i, "amount": a} for i, a in rows]))


@pytest.fixture
def spend(tmp_path):
    """A counted graph over two days of transactions, with a total and a table by day."""
    calls = []

    @producer(version=SemVer(major=1, minor=0, patch=0))
    def total(transactions: Annotated[list[dict], Transactions]) -> Annotated[float, Total]:
        calls.append("total")
        return sum(x["amount"] for x in transactions)

    def days(transactions):
        return {s.key: {"transactions": [s]} for s in transactions}

    @producer(map=days)
    def by_day(transactions: Annotated[DataFrame, Transactions]) -> Annotated[DataFrame, ByDay]:
        calls.append("day")
        return transactions.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))

    for day, rows in DAYS.items():
        put(tmp_path / "in", day, rows)

    def graph(name="spend", backend=None, one_job=False):
        by_day.one_job = one_job
        with Graph(name, backend=backend) as g:
            g.artifacts.vendor.transactions = Transactions(storage=LocalFile(path=f"{tmp_path}/in/{{date.iso}}.json"))
            g.artifacts.total = total(transactions=g.artifacts.vendor.transactions).out(Total(storage=LocalFile.rooted_at(tmp_path / "out")))
            g.artifacts.days = by_day(transactions=g.artifacts.vendor.transactions).out(ByDay(storage=LocalFile.rooted_at(tmp_path / "out")))
        return g

    return graph, calls, tmp_path


def test_the_sample_total(spark, spend):
    graph, _, _ = spend
    s = graph().build()
    assert s.read(s.artifacts.total, float) == 42.0
    rows = s.read(s.artifacts.vendor.transactions, list)
    assert rows[0] == {"date": datetime.date(1970, 1, 1), "id": 1, "amount": 9.95} and len(rows) == 5
    assert s.read(s.artifacts.vendor.transactions, DataFrame).where("date = date'1970-01-02'").count() == 3
    assert s.read(s.artifacts.vendor.transactions, pd.DataFrame).amount.sum() == pytest.approx(42.0)


@pytest.mark.parametrize("one_job", [False, True])
def test_only_what_is_missing_is_built(spark, spend, one_job):
    graph, calls, root = spend
    g = graph(one_job=one_job)
    days = 1 if one_job else 2

    def built():
        found = (calls.count("total"), calls.count("day"))
        calls.clear()
        return found

    first = g.build()
    assert built() == (1, days)
    g.build()
    assert built() == (0, 0)
    put(root / "in", "1970-01-01", [(1, 1.0)])
    changed = g.build()
    assert built() == (1, 1) and changed.id != first.id
    assert changed.read(g.artifacts.total, float) == pytest.approx(25.55)
    put(root / "in", "1970-01-01", DAYS["1970-01-01"])
    back = g.build()
    assert built() == (0, 0) and back.id == first.id
    put(root / "in", "1970-01-03", [(9, 1.0)])
    g.build()
    assert built() == (1, 1)
    # A new backend finds the files that are there.
    again = graph(backend=MemoryBackend(), one_job=one_job).build()
    assert built() == (0, 0)
    assert {r.date.day: (r.n, r.amount) for r in again.read(again.artifacts.days, DataFrame).collect()} == {1: (2, 17.45), 2: (3, 24.55), 3: (1, 1.0)}


def test_tags_and_snapshots(spark, spend):
    graph, _, root = spend
    g = graph()
    first = g.build()
    first.tag("v1")
    put(root / "in", "1970-01-02", [(3, 1.0)])
    second = g.build()
    with pytest.raises(ValueError, match="already"):
        second.tag("v1")
    old = GraphSnapshot.from_tag("spend", "v1", g.backend)
    assert old.read(old.artifacts.total, float) == 42.0 and second.read(g.artifacts.total, float) == pytest.approx(18.45)
    second.tag("v1", overwrite=True)
    assert GraphSnapshot.from_tag("spend", "v1", g.backend).id == second.id
    with pytest.raises(ValueError, match="no tag"):
        GraphSnapshot.from_tag("spend", "v9", g.backend)
    assert g.read(g.artifacts.total, float) == pytest.approx(18.45)
    with pytest.raises(ValueError, match="isn't what it was"):
        first.read(g.artifacts.vendor.transactions, list, verify=True)


def test_one_output_missing_is_built_again(spark, tmp_path):
    calls = []

    class A(Artifact):
        type, format = t.Int64(), JSON()

    @producer()
    def both(x: Annotated[int, Num]) -> tuple[Annotated[int, A], Annotated[int, A]]:
        calls.append(1)
        return x + 1, x + 2

    with Graph("both") as g:
        g.artifacts.num = Num(storage=StringLiteral(value="5"))
        a, b = both(x=g.artifacts.num).out(A(storage=LocalFile.rooted_at(tmp_path)), A(storage=LocalFile.rooted_at(tmp_path)))
        g.artifacts.a, g.artifacts.b = a, b
    s = g.build()
    assert (s.read(g.artifacts.a, int), s.read(g.artifacts.b, int)) == (6, 7) and len(calls) == 1
    (part,) = s.partitions(g.artifacts.b)
    os.remove(part.partition.path)
    g.build()
    assert len(calls) == 2


def test_swapped_and_equal_inputs_are_told_apart(spark):
    class Out(Artifact):
        type, format = t.Int64(), JSON()

    @producer()
    def div(a: Annotated[int, Num], b: Annotated[int, Num]) -> Annotated[int, Out]:
        return a // b

    def prints(a, b):
        p = div(a=Num(storage=StringLiteral(value=str(a))), b=Num(storage=StringLiteral(value=str(b))))
        return p.input_fingerprint({k: x.storage.discover() for k, x in p.inputs.items()})

    assert prints(10, 5) != prints(5, 10) and prints(1, 1) != prints(2, 2)


def test_validation_leaves_nothing(spark, tmp_path):
    def valid(out):
        return (False, "never") if isinstance(out, int) or out.count() else (True, "")

    class Out(Artifact):
        type, format = t.Collection(element=t.Struct(fields={"id": t.Int64()})), Parquet()

    @producer(validate_outputs=valid)
    def build(x: Annotated[int, Num]) -> Annotated[DataFrame, Out]:
        return spark.range(x)

    with Graph("valid") as g:
        g.artifacts.x = Num(storage=StringLiteral(value="3"))
        g.artifacts.out = build(x=g.artifacts.x).out(Out(storage=LocalFile.rooted_at(tmp_path)))
    with pytest.raises(ValueError, match="never"):
        g.build()
    assert not [f for _, _, fs in os.walk(tmp_path) for f in fs]
    assert g.read(g.artifacts.x, int) == 3


def test_graph_rules(spark):
    with Graph("a") as g:
        with pytest.raises(ValueError, match="nested"), Graph("b"):
            pass
        with pytest.raises(ValueError, match="open"):
            g.snapshot()
        g.artifacts.x.y = 5
        assert "y" in g.artifacts.x and "z" not in g.artifacts.x
        with pytest.raises(ValueError, match="already"):
            g.artifacts.x.y = 6
        with pytest.raises(ValueError, match="can't name"):
            g.artifacts._x = 1
    with pytest.raises(ValueError, match="closed"):
        g.artifacts.z = 1
    with pytest.raises(AttributeError, match="no artifact"):
        _ = g.artifacts.q
    with pytest.raises(KeyError):
        g.key_of(Num(storage=StringLiteral(value="99")))
    assert g.key_of(g.artifacts.x.y) == "x.y" and g.read(g.artifacts.x.y, int) == 5
    with pytest.raises(ValueError, match="exactly one"):
        g.read(g.artifacts.x.y)
    with Graph("empty") as e:
        e.artifacts.x = Num(storage=LocalFile(path="/nowhere/x.json"))
    with pytest.raises(ValueError, match="no data"):
        e.build()


def test_graphs_share_artifacts_and_check_inputs(spark):
    class Out(Artifact):
        type, format = t.Int64(), JSON()

    @producer()
    def more(x: Annotated[int, Num]) -> Annotated[int, Out]:
        return x + 1

    with Graph("one") as one:
        one.artifacts.x = Num(storage=StringLiteral(id="fixed", value="1"))
    with Graph("two") as two:
        two.artifacts.x = one.artifacts.x
        two.artifacts.y = more(x=two.artifacts.x)
    assert one.artifacts.x == two.artifacts.x
    assert two.build().read(two.artifacts.y, int) == 2
    assert two.dependencies[two.artifacts.y] == {two.producers[0]} and two.producer_outputs == {two.producers[0]: (two.artifacts.y,)}
    with pytest.raises(ValueError, match="isn't an artifact of"), Graph("three") as three:
        three.artifacts.y = more(x=Num(storage=StringLiteral(value="7")))
    with pytest.raises(ValueError, match="input_fingerprint"), Graph("four") as four:
        four.artifacts.x = one.artifacts.x
        four.artifacts.y = more(x=four.artifacts.x).out(Out(storage=LocalFile(path="/x/y.json")))


@pytest.mark.parametrize("kind", [LocalFile, SparkFile])
def test_writing(spark, tmp_path, kind):
    with Graph("write") as g:
        g.artifacts.raw = Num(storage=kind(path=str(tmp_path / "n.json")))
        g.artifacts.table = Artifact(type=t.Collection(element=t.Struct(fields={"i": t.Int64(), "x": t.String(nullable=True)}), partition_by=("i",)), format=CSV(), storage=kind(path=f"{tmp_path}/t/{{i.value}}.csv"))
        g.artifacts.pickled = Artifact(type=t.List(element=t.Int64()), format=Pickle(), storage=kind(path=str(tmp_path / "p.pickle")))
    g.write(7, g.artifacts.raw)
    g.write([1, 2], g.artifacts.pickled)
    for k in (1, 2):
        g.write(spark.createDataFrame([(k, "a")], "i long, x string"), g.artifacts.table, key=PartitionKey(i=Int64Field(value=k)))
    assert g.read(g.artifacts.raw, int) == 7 and g.read(g.artifacts.pickled, list) == [1, 2]
    assert sorted(tuple(r) for r in g.read(g.artifacts.table, DataFrame).collect()) == [(1, "a"), (2, "a")]
    with pytest.raises(ValueError, match="raw"):
        g.snapshot().write(8, g.artifacts.raw)
    with pytest.raises(TypeError, match="can't represent"):
        g.read(g.artifacts.raw, str)


# Producers


def test_class_rules():
    class Out(Artifact):
        type, format = t.Int64(), JSON()

    def made(fields=None, **body):
        return type("P", (Producer,), {"__annotations__": {"x": Num} if fields is None else fields, **body})

    good = staticmethod(lambda: None)
    cases = [
        (lambda: made(), "must have a build"),
        (lambda: made({"x": int}, build=good), "must be an Artifact class"),
        (lambda: made(x=Num(storage=StringLiteral(value="1")), build=good), "must not have a default"),
    ]

    def plain(self, x: int) -> Annotated[int, Out]: ...
    def positional(x: int, /) -> Annotated[int, Out]: ...
    def starred(*x: int) -> Annotated[int, Out]: ...
    def default(x: int = 1) -> Annotated[int, Out]: ...
    def unknown(y: int) -> Annotated[int, Out]: ...
    def unhinted(x) -> Annotated[int, Out]: ...
    def nothing(x: int): ...
    def none(x: int) -> None: ...
    def unfit(x: str) -> Annotated[int, Out]: ...
    def unused() -> Annotated[int, Out]: ...
    def parted(x: int) -> Annotated[DataFrame, ByDay]: ...

    cases.append((lambda: made(build=plain), "static or class method"))
    for f, why in ((positional, "keyword"), (starred, "keyword"), (default, "default"), (unknown, "isn't a field"), (unhinted, "type hint"), (nothing, "return type hint"), (none, "must return"), (unfit, "can't represent"), (unused, "doesn't use"), (parted, "needs a map")):
        cases.append((lambda f=f: made(build=staticmethod(f)), why))
    for make, why in cases:
        with pytest.raises(TypeError, match=why):
            make()


def test_binding_outputs():
    class A(Artifact):
        type, format = t.Int64(), JSON()

    class B(A):
        pass

    class P(Producer):
        x: Num

        @classmethod
        def build(cls, x: int) -> tuple[Annotated[int, A], Annotated[int, B]]:
            return x, x

    p = P(x=Num(storage=StringLiteral(value="1")))
    with pytest.raises(ValueError, match="2 outputs"):
        p.out(A())
    with pytest.raises(TypeError, match="must be a B"):
        p.out(A(), A())
    a, b = p
    assert (a.output.position, b.output.position) == (0, 1)
    with pytest.raises(ValueError, match="already"):
        P(x=Num(storage=StringLiteral(value="2"))).out(a, B())
    with pytest.raises(ValueError, match="name the one"):
        Artifact.cast(p)
    with pytest.raises(TypeError, match="takes"):
        P()
    with pytest.raises(TypeError, match="must be a Num"):
        P(x="text")


def test_versions():
    assert SemVer(major=1, minor=2, patch=3).fingerprint == SemVer(major=1, minor=0, patch=0).fingerprint
    assert SemVer(major=0, minor=2, patch=3).fingerprint != SemVer(major=0, minor=2, patch=4).fingerprint
    assert String(value="a").fingerprint != String(value="b").fingerprint
    with pytest.raises(ValueError, match="zone"):
        Timestamp(dt=datetime.datetime(2020, 1, 1))
    assert Timestamp().dt.tzinfo is not None
    os.environ["GIT_SHA"] = "abc"
    assert GitCommit().sha == "abc"
    del os.environ["GIT_SHA"]
    assert "def test_versions" in Source.of(test_versions).text


# Artifacts and views


def test_artifacts():
    class Note(Annotation):
        def __init__(self, text=""):
            object.__setattr__(self, "text", text)

    class Noted(Num):
        annotations = (Note(),)

    x = Noted(annotations=(Note(),), storage=StringLiteral(value="1"))
    assert len(x.annotations) == 2
    with pytest.raises(AttributeError):
        x.type = t.String()
    with pytest.raises(ValueError, match="needs a type"):
        Artifact()
    with pytest.raises(TypeError, match="no"):
        Num(junk=1)
    with pytest.raises(TypeError, match="can't hold"):
        Artifact(type=t.UInt8(), format=JSON())


@pytest.mark.parametrize("value, want", [("hi", t.String()), (5, t.Int64()), (5.0, t.Float64()), (None, t.Null()), (True, t.Boolean()), ((1, 2, 3), t.List(element=t.Int64())), ([1, 2, 3], t.List(element=t.Int64())), ({"a": 1, "b": 2}, t.Map(key=t.String(), value=t.Int64())), ({1, 2}, t.Set(element=t.Int64())), (datetime.date(2020, 1, 1), t.Date())])
def test_literals(value, want):
    assert infer(value) == want and literal(value).storage.value is not None


@pytest.mark.parametrize("value", [(1, "a"), {"a": "b", 1: 2}, object()])
def test_no_literals(value):
    with pytest.raises(NotImplementedError):
        infer(value)


def test_views(spark):
    assert view_for(list[dict]) is ListOf and view_for(Annotated[int, FrameView]) is FrameView and view_for(datetime.datetime) is DateTimes
    with pytest.raises(TypeError):
        view_for(complex)
    with pytest.raises(TypeError):
        check(ListOf, t.Int64())

    class Mine(View):
        python = complex

    register(complex, Mine, 1)
    register(complex, Mine, 0)
    assert view_for(complex) is Mine
    with pytest.raises(ValueError, match="priority"):
        register(complex, FrameView, 1)


def test_threads_and_errors(spark, spend):
    graph, _, root = spend
    put(root / "in", "1970-01-04", [])
    s = graph().snapshot()
    SparkExecutor(threads=1).build(s)
    assert s.read(s.artifacts.total, float) == 42.0
    assert {p.key["date"].value.day for p in s.partitions(s.artifacts.days)} == {1, 2, 4}
    assert s.partitions(s.artifacts.days) and DateField(value=datetime.date(1970, 1, 1)) in {p.key["date"] for p in s.partitions(s.artifacts.days)}
    assert Fingerprint.identity().is_identity
