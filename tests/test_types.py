import datetime
import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft import types as t

EVERY = {
    "binary": t.Binary(byte_size=2), "boolean": t.Boolean(), "date": t.Date(), "datetime": t.DateTime(), "timestamp": t.Timestamp(), "time": t.Time(precision="second"), "enum": t.Enum(type=t.String(), items=["a", "b"]),
    "float16": t.Float16(), "float32": t.Float32(), "float64": t.Float64(), "geography": t.Geography(srid=4326), "int8": t.Int8(), "int16": t.Int16(), "int32": t.Int32(), "int64": t.Int64(), "uint8": t.UInt8(),
    "uint16": t.UInt16(), "uint32": t.UInt32(), "uint64": t.UInt64(), "list": t.List(element=t.Int64(nullable=True)), "map": t.Map(key=t.String(), value=t.Float64()), "set": t.Set(element=t.Int32()), "string": t.String(nullable=True, description="a note"),
    "struct": t.Struct(fields={"x": t.Int8()}, name="Point"),
}
VALUES = (b"ab", True, datetime.date(2020, 1, 2), datetime.datetime(2020, 1, 2, 3), datetime.datetime(2020, 1, 2, 3), 5, "a", 1.0, 1.0, 1.0, "POINT(1 1)", 1, 1, 1, 1, 1, 1, 1, decimal.Decimal(2**64 - 1), [1, None], {"a": 1.0}, [1, 2], None, (1,))


def test_every_type_round_trips_through_parquet(spark, tmp_path):
    table = t.Collection(element=t.Struct(fields=EVERY))
    df = spark.createDataFrame([VALUES], table.schema())
    assert t.violations(df, table) == {}
    df.write.parquet(str(tmp_path / "x"))
    back = t.from_spark(spark.read.parquet(str(tmp_path / "x")).schema)
    assert back == table.element
    assert back.fields["string"].nullable and not back.fields["int8"].nullable


@pytest.mark.parametrize("name, value", [("binary", b"abc"), ("enum", "c"), ("uint8", 256), ("uint8", -1), ("uint16", 70_000), ("time", 86_400), ("set", [1, 1]), ("list", None), ("struct", (None,)), ("map", {"a": None}), ("int8", None)])
def test_violations(spark, name, value):
    table = t.Collection(element=t.Struct(fields={name: EVERY[name]}))
    loose = T.StructType([T.StructField(name, _loose(EVERY[name].spark()), True)])
    assert t.violations(spark.createDataFrame([(value,)], loose), table) == {name: 1}


def _loose(x):
    if isinstance(x, T.ArrayType):
        return T.ArrayType(_loose(x.elementType), True)
    if isinstance(x, T.MapType):
        return T.MapType(x.keyType, x.valueType, True)
    if isinstance(x, T.StructType):
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in x.fields])
    return x


def test_friendly_keys():
    assert t.List(element=t.Int32()).friendly_key == "Int32List"
    assert t.Map(key=t.String(), value=t.Int32()).friendly_key == "StringToInt32"
    assert t.Enum(type=t.Float32(), items=[1.0]).friendly_key == "Float32Enum"
    assert t.Timestamp(precision="second").friendly_key == "SecondTimestamp"
    assert t.Struct(fields={}, name="Row").friendly_key == "Row"


def test_bad_types():
    with pytest.raises(ValueError, match="precision"):
        t.Timestamp(precision="hour")
    with pytest.raises(ValueError, match="items"):
        t.Enum(type=t.String(), items=[])
    with pytest.raises(ValueError, match="items"):
        t.Enum(type=t.String(), items=["a", 1])
    point = t.Struct(fields={"a": t.Int8(), "b": t.Int8()})
    with pytest.raises(ValueError, match="unknown"):
        t.Collection(element=point, partition_by=("c",))
    with pytest.raises(ValueError, match="overlap"):
        t.Collection(element=point, partition_by=("a",), cluster_by=("a",))


def test_conform_and_plain_schemas(spark):
    df = spark.range(3).withColumn("b", F.col("id").cast("string"))
    table = t.Collection(element=t.Struct(fields={"b": t.Int8(nullable=True), "id": t.UInt8(nullable=True)}))
    assert [tuple(r) for r in t.conform(df, table).collect()] == [(k, k) for k in range(3)]
    assert t.collection_of(df).fields["id"] == t.Int64()
    with pytest.raises(TypeError):
        t.from_spark(T.DecimalType(10, 2))


def test_identity_of_types():
    a = t.Struct(fields={"x": t.Int8(description="one")})
    assert a.fingerprint == t.Struct(fields={"x": t.Int8(description="two")}).fingerprint
    assert a.fingerprint != t.Struct(fields={"x": t.Int8(nullable=True)}).fingerprint
