import datetime
import os

import pytest
from pyspark.sql import functions as F

from weft import types as t
from weft.formats import CSV, JSON, Parquet, Pickle
from weft.functions import components
from weft.model import Fingerprint, frozendict
from weft.partitions import DateField, Int8Field, Int64Field, NullField, PartitionField, PartitionKey, StringField
from weft.sources import CloudFile, LocalFile, SparkFile, StringLiteral
from weft.sources.base import Storage
from weft.template import Template

DAY = datetime.date(1970, 1, 2)


def table(*by, **fields):
    return t.Collection(element=t.Struct(fields=fields), partition_by=by)


@pytest.mark.parametrize("spec, values, want", [("/{graph_name}/{path_tags}/junk", {"graph_name": "test", "path_tags": ""}, "/test/junk"), ("/{input_fingerprint}/junk", {"input_fingerprint": ""}, "/junk"), ("/{names}/junk/{name}", {"names": "", "name": ""}, "/junk"), ("/{a}/{b}", {"a": "x"}, "/x/{b}"), ("base", {}, "base")])
def test_filling_in(spec, values, want):
    assert Template(spec).resolve(**values).text == want


def test_nothing_left():
    with pytest.raises(ValueError, match="nothing is left"):
        Template("/{name}").resolve(name="")


@pytest.mark.parametrize(
    "of, want",
    [
        (table(a=t.Int8()), "/tmp/test"),
        (table("date", date=t.Date()), "/tmp/test/date_Y={date.Y}/date_m={date.m:02}/date_d={date.d:02}"),
        (table("a", "b", a=t.Int8(), b=t.Int8()), "/tmp/test/a_value={a.value}/b_value={b.value}"),
    ],
)
def test_partition_specs(of, want):
    assert LocalFile(path="/tmp/test/{partition_key_spec}").of_type(of).path == want


def test_what_an_artifact_fills_in():
    s = LocalFile(path="/{graph_name}/{path_tags}/{names}/{input_fingerprint}/{name}{extension}")
    s = s.of_format(JSON()).of_graph("g", {"a": "b"}).of_names(("x", "y"))
    assert s.path == "/g/a=b/x/y/{input_fingerprint}/y.json"
    assert s.of_input_fingerprint(Fingerprint.from_int(10)).path == "/g/a=b/x/y/10/y.json"
    assert s.of_input_fingerprint(None).path == "/g/a=b/x/y/y.json"


def test_other_separators():
    class Table(Storage):
        key_value_sep, component_sep, segment_sep = "_", "_", "__"
        name: str = "{partition_key_spec}"

    import dataclasses

    Table = dataclasses.dataclass(frozen=True, kw_only=True)(Table)
    assert Table().of_type(table("a", "b", a=t.Int8(), b=t.Int8())).name == "a_value_{a.value}__b_value_{b.value}"


KEYS = frozendict(date=DateField, i=Int8Field)


def test_keys_of_mixed_types_are_read_by_their_own_classes():
    spec = Template("/p/{date.Y}/{date.m:02}/{date.d:02}/{i.hex}/{input_fingerprint}/x")
    key = PartitionKey(date=DateField(value=DAY), i=Int8Field(value=-5))
    path = spec.resolve(input_fingerprint="-7").locate(key)
    assert path == "/p/1970/01/02/-0x5/-7/x"
    assert spec.parse(path, KEYS) == (Fingerprint.from_int(-7), key)
    assert spec.wildcard(KEYS) == "/p/*/*/*/*/*/x"
    assert Template("/p/{i.value[5]}/{date.iso}").wildcard(KEYS) == "/p/5/*"
    assert Template("/p/{i.value}/{i.value}").parse("/p/3/3", {"i": Int8Field})[1] == PartitionKey(i=Int8Field(value=3))


@pytest.mark.parametrize("spec, path, why", [("/p/{i.value}/{date.iso}", "fake", "can't read"), ("/p/{i.value}/", "/p/1/", "no place"), ("/p/{x.value}", "/p/1", "no partition key"), ("/p/{i}", "/p/1", "only one of its components"), ("/p/{i.junk}", "/p/1", "no component"), ("/p/{i.value}/{i.value}/{date.iso}", "/p/1/2/1970-01-01", "can't read")])
def test_unreadable_paths(spec, path, why):
    with pytest.raises(ValueError, match=why):
        Template(spec).parse(path, KEYS)


@pytest.mark.parametrize("kind, found, value", [(DateField, {"iso": "1970-01-02"}, DAY), (DateField, {"value": "1970-01-02"}, DAY), (DateField, {"Y": "1970", "m": "01", "d": "02"}, DAY), (Int64Field, {"hex": "0x1f"}, 31), (Int64Field, {"value": "-4"}, -4), (NullField, {"value": "None"}, None), (StringField, {"value": "a"}, "a")])
def test_components(kind, found, value):
    assert kind.from_components(**found).value == value


@pytest.mark.parametrize("kind, found", [(DateField, {"Y": "1970"}), (Int8Field, {"junk": "1"}), (NullField, {"value": "x"}), (Int8Field, {"value": "300"}), (StringField, {"value": "a/b"})])
def test_bad_components(kind, found):
    with pytest.raises(ValueError):
        kind.from_components(**found)


def test_field_classes_are_checked():
    with pytest.raises(TypeError, match="matching_type"):

        class Bad(PartitionField):
            pass

    with pytest.raises(TypeError, match="can't part"):
        PartitionKey.types_from(table("x", x=t.Float64()))
    assert PartitionKey.types_from(t.Int8()) == {}


def test_components_as_columns(spark):
    df = spark.createDataFrame([(DAY, -31), (datetime.date(2021, 12, 31), 5)], "d date, i long")
    got = df.select(*(c.alias(f"d_{k}") for k, c in components(F.col("d"), t.Date()).items()), *(c.alias(f"i_{k}") for k, c in components(F.col("i"), t.Int64()).items())).collect()
    for row, (d, i) in zip(got, ((DAY, -31), (datetime.date(2021, 12, 31), 5)), strict=True):
        f, g = DateField(value=d), Int64Field(value=i)
        assert (row.d_Y, row.d_m, row.d_d, row.d_iso) == (f.Y, f.m, f.d, f.iso) and (row.i_value, row.i_hex) == (str(i), g.hex)


def test_local_discovery(tmp_path):
    s = LocalFile.rooted_at(tmp_path, "{date.Y}/{date.m}/{date.d}/{input_fingerprint}/x").of_type(table("date", date=t.Date()))
    for d, fp in ((DAY, 1), (DAY, 2), (datetime.date(1970, 1, 3), 1)):
        p = s.partition(PartitionKey(date=DateField(value=d)), Fingerprint.from_int(fp))
        os.makedirs(os.path.dirname(p.path))
        with open(p.path, "w") as f:
            f.write(f"{d}{fp}")
    assert len(s.discover()) == 3
    key = PartitionKey(date=DateField(value=DAY))
    (only,) = s.discover({key: Fingerprint.from_int(2)})
    assert only.key == key and only.input_fingerprint == Fingerprint.from_int(2)
    with pytest.raises(ValueError, match="input fingerprint"):
        s.partition(key)
    with pytest.raises(ValueError, match="parted by"):
        s.partition(PartitionKey(), Fingerprint.from_int(1))
    with pytest.raises(ValueError, match="no type"):
        LocalFile(path="x").keys()
    with pytest.raises(ValueError, match="no place"):
        LocalFile(path="x").of_type(t.Int8()).partition(input_fingerprint=Fingerprint.from_int(1))


def test_contents(tmp_path, spark):
    a = tmp_path / "a"
    a.write_text("one")
    local, far = LocalFile(path=str(a)).of_type(t.String()), SparkFile(path=str(a)).of_type(t.String())
    first = local.partition().snapshot().content, far.partition().snapshot().content
    a.write_text("other")
    assert local.partition().snapshot().content != first[0] and far.partition().snapshot().content != first[1]
    a.write_text("one")
    assert local.partition().snapshot().content == first[0]
    for kind in (LocalFile, SparkFile):
        gone = kind(path=str(tmp_path / "gone")).of_type(t.String())
        assert gone.discover() == () and not gone.exists(gone.partition())
        with pytest.raises(FileNotFoundError):
            gone.partition().snapshot()
    assert CloudFile(bucket="b", path="x{extension}").of_format(JSON()).path == "gs://b/x.json"


def test_literals():
    s = StringLiteral(value="5").of_type(t.Int64())
    assert s.discover()[0].content == Fingerprint.from_string("5")
    with pytest.raises(ValueError, match="again"):
        s.write(s.discover()[0].partition, "6")
    open_ = StringLiteral(id="x/{input_fingerprint}").of_type(t.Int64())
    p = open_.partition(input_fingerprint=Fingerprint.from_int(3))
    assert open_.discover() == ()
    with pytest.raises(FileNotFoundError):
        p.snapshot()
    open_.write(p, "7")
    assert [x.partition for x in open_.discover()] == [p]
    with pytest.raises(ValueError, match="partitioned"):
        StringLiteral(value="5").of_type(table("a", a=t.Int8())).discover()


def test_formats_refuse_what_they_cannot_hold():
    for kind in (JSON(), Pickle()):
        for bad in (t.UInt8(), t.Time(), t.DateTime(), t.Geography(), t.List(element=t.UInt64()), t.Struct(fields={"x": t.Time()})):
            with pytest.raises(TypeError):
                kind.check(bad)
    with pytest.raises(TypeError):
        Parquet().check(t.Int8())
    with pytest.raises(TypeError):
        CSV().check(table(x=t.List(element=t.Int8())))


def test_files_of_others_by_content(spark, tmp_path):
    """Files that weft didn't write: an equal copy is the same content, and an equally long rewrite within one tick isn't."""
    import os

    one = tmp_path / "x.json"
    one.write_text("12345")
    os.utime(one, (1, 1))
    by_content = SparkFile(path=str(one), by_content=True).of_type(t.String())
    by_time = SparkFile(path=str(one)).of_type(t.String())
    first, plain = by_content.discover()[0].content, by_time.discover()[0].content
    os.utime(one, (2, 2))
    assert by_content.discover()[0].content == first and by_time.discover()[0].content != plain
    one.write_text("54321")
    os.utime(one, (1, 1))
    assert by_content.discover()[0].content != first


def test_facts_are_bound_at_once():
    s = LocalFile.rooted_at("/r").bind(type=table("date", date=t.Date()), format=JSON(), graph="g", tags={"a": "b"}, names=("x", "y"))
    assert s.path == "/r/g/a=b/x/y/date_Y={date.Y}/date_m={date.m:02}/date_d={date.d:02}/{input_fingerprint}/y.json" and s.placeholders == {"date", "input_fingerprint"}
