import dataclasses
import datetime
from typing import Annotated, Literal, Optional, TypedDict, Union

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from weft import types as t
from weft.adapters import bigquery
from weft.adapters.arrow import arrow, numpy, pandas
from weft.adapters.python import from_type, models, python


class Point(TypedDict):
    x: int
    tags: list[str]


@pytest.mark.parametrize(
    "hint, want",
    [
        (bool, t.Boolean()), (bytes, t.Binary()), (datetime.date, t.Date()), (datetime.datetime, t.Timestamp()), (float, t.Float64()), (int, t.Int64()), (str, t.String()), (type(None), t.Null()), (None, t.Null()),
        (Optional[int], t.Int64(nullable=True)), (int | None, t.Int64(nullable=True)), (Literal["a", "b"], t.Enum(type=t.String(), items=["a", "b"])), (Union[Literal["a"], Literal["b"]], t.Enum(type=t.String(), items=["a", "b"])),
        (list[int], t.List(element=t.Int64())), (tuple[int, ...], t.List(element=t.Int64())), (set[str], t.Set(element=t.String())), (frozenset[str], t.Set(element=t.String())), (dict[str, float], t.Map(key=t.String(), value=t.Float64())),
        (Point, t.Struct(name="Point", fields={"x": t.Int64(), "tags": t.List(element=t.String())})), (Annotated[int, t.Int8()], t.Int8()), (Annotated[int, "note"], t.Int64()),
    ],
)
def test_python_hints(hint, want):
    assert python.to_type(hint) == want


@pytest.mark.parametrize("hint", [int | str, complex, list, Union[Literal["a"], int]])
def test_hints_without_a_type(hint):
    with pytest.raises((NotImplementedError, IndexError)):
        python.to_type(hint)


def test_mixed_literals():
    with pytest.raises(ValueError, match="one type"):
        python.to_type(Literal["a", 1])


def test_back_to_hints():
    for hint in (bool, bytes, int, float, str, datetime.date, datetime.datetime, list[int], frozenset[str], dict[str, float], Optional[int]):
        assert from_type(python.to_type(hint)) == hint
    assert from_type(t.Int8()) is int and from_type(t.Float16()) is float and from_type(t.Null()) is type(None)
    assert python.to_type(from_type(python.to_type(Point))) == python.to_type(Point)
    assert python.to_type(from_type(t.Enum(type=t.Int64(), items=[1, 2]))) == t.Enum(type=t.Int64(), items=[1, 2])
    for none in (t.Time(), t.DateTime(), t.Geography(), t.UInt8()):
        with pytest.raises(NotImplementedError):
            from_type(none)


def test_models():
    class Tag(str):
        pass

    @dataclasses.dataclass
    class Inner:
        tag: Tag

    class Field:
        def __init__(self, annotation):
            self.annotation = annotation

    class Model:
        model_fields = {"x": Field(int), "inner": Field(list[Inner])}

    Inner.__annotations__ = {"tag": Tag}
    assert models.to_type(Inner) == t.Struct(name="Inner", fields={"tag": t.String()})
    assert models.to_type(Model) == t.Struct(name="Model", fields={"x": t.Int64(), "inner": t.List(element=t.Struct(name="Inner", fields={"tag": t.String()}))})
    assert models.to_type(models.from_type(models.to_type(Inner))) == models.to_type(Inner)


WIDE = {
    "binary": t.Binary(), "fixed": t.Binary(byte_size=4), "boolean": t.Boolean(), "date": t.Date(), "datetime": t.DateTime(precision="millisecond"), "float16": t.Float16(), "float32": t.Float32(), "float64": t.Float64(), "int8": t.Int8(), "int64": t.Int64(),
    "uint32": t.UInt32(), "string": t.String(nullable=True), "time": t.Time(precision="second"), "nano": t.Time(precision="nanosecond"), "timestamp": t.Timestamp(precision="microsecond"), "list": t.List(element=t.Int64(nullable=True)), "map": t.Map(key=t.String(), value=t.Float64()),
    "struct": t.Struct(fields={"x": t.Int8()}), "null": t.Null(nullable=True),
}


def test_arrow():
    table = t.Collection(name="wide", element=t.Struct(fields=WIDE), partition_by=("int8",), cluster_by=("date", "string"))
    schema = arrow.from_type(table)
    assert isinstance(schema, pa.Schema) and arrow.to_type(schema) == table
    assert arrow.to_type(pa.date64()) == t.Date() and arrow.from_type(t.Geography()) == pa.string() and arrow.from_type(t.Geography(format="WKB")) == pa.binary()
    with pytest.raises(ValueError, match="UTC"):
        arrow.to_type(pa.timestamp("us", tz="Europe/Berlin"))
    with pytest.raises(NotImplementedError):
        arrow.to_type(pa.decimal128(5))


def test_numpy():
    for kind in (np.bool_, np.float16, np.float32, np.float64, np.int8, np.int64, np.uint8, np.uint64, np.str_, np.bytes_):
        assert numpy.from_type(numpy.to_type(kind)) is kind and numpy.to_type(np.dtype(kind)) == numpy.to_type(kind)
    assert numpy.to_type(np.zeros((2, 3), np.int32)) == t.List(element=t.List(element=t.Int32()))
    empty = numpy.from_type(t.List(element=t.List(element=t.Int32())))
    assert empty.ndim == 2 and empty.dtype == np.int32
    assert numpy.to_type(dict[str, int]) == t.Map(key=t.String(), value=t.Int64())
    with pytest.raises(NotImplementedError):
        numpy.to_type(np.datetime64)


def test_pandas():
    df = pd.DataFrame({"a": [0.0], "b": [0], "c": ["x"]})
    found = pandas.to_type(df)
    assert found == t.List(element=t.Struct(fields={"a": t.Float64(), "b": t.Int64(), "c": t.String()}))
    assert list(pandas.from_type(found).columns) == ["a", "b", "c"] and pandas.to_type(pd.Series([1, 2])) == t.List(element=t.Int64())
    assert pandas.from_type(t.List(element=t.Float32())).dtype == np.float32
    with pytest.raises(NotImplementedError, match="strings"):
        pandas.to_type(pd.Series([object()]))


def test_bigquery():
    wide = t.Collection(
        name="wide",
        element=t.Struct(fields={"binary": t.Binary(byte_size=3), "boolean": t.Boolean(), "date": t.Date(description="a day"), "datetime": t.DateTime(), "float64": t.Float64(), "geography": t.Geography(), "int64": t.Int64(), "string": t.String(nullable=True), "time": t.Time(), "timestamp": t.Timestamp(), "records": t.List(element=t.Struct(fields={"id": t.Int64(), "data": t.Struct(fields={"values": t.List(element=t.Int64())})}))}),
        partition_by=("date",),
        cluster_by=("string",),
    )
    table = bigquery.to_table(wide)
    assert bigquery.from_table(table) == wide and table["timePartitioning"] == {"type": "DAY", "field": "date"}
    assert bigquery.to_field("x", t.Int8())["type"] == "INT64" and bigquery.from_field({"name": "x", "type": "INTEGER"}) == t.Int64(nullable=True)
    two = t.Collection(element=t.Struct(fields={"d": t.Date(), "k": t.Int64(), "s": t.String()}), partition_by=("d", "k"), cluster_by=("s",))
    assert bigquery.to_table(two)["clustering"]["fields"] == ["k", "s"]
    for wrong, why in ((lambda: bigquery.to_field("x", t.List(element=t.List(element=t.Int8()))), "arrays of arrays"), (lambda: bigquery.to_table(t.Collection(element=t.Struct(fields={"k": t.Int64()}), partition_by=("k",))), "days")):
        with pytest.raises(ValueError, match=why):
            wrong()
    for wrong in (lambda: bigquery.to_field("x", t.UInt8()), lambda: bigquery.from_field({"name": "x", "type": "JSON"}), lambda: bigquery.from_table({"timePartitioning": {"type": "HOUR"}})):
        with pytest.raises(NotImplementedError):
            wrong()
