"""Every registered query with SQL against DuckDB, and the driver's contract."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from weft import plans

AT = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"create view {t} as select * from '{AT}/{t}.parquet'")
    return found


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", list(plans.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = plans.QUERIES[name](spark, AT)
    cursor = con.execute(plans.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(tuple(plain(v) for _, v in sorted(zip(columns, row, strict=True))) for row in cursor.fetchall())
    got = sorted(tuple(plain(v) for _, v in sorted(r.asDict().items())) for r in df.collect())
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want) and got == want


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_incremental_rebuild_takes_all_days(spark, monkeypatch):
    from weft.plans import queries

    assert [queries.each_of(*x) for x in ((2, 2), (3, 2), (0, 2), (30, 29))] == [1, 3, 0, 30]
    sizes, each_of = [], queries.each_of
    monkeypatch.setattr(queries, "each_of", lambda made, days: sizes.append((made, days)) or each_of(made, days))
    assert [tuple(r) for r in plans.QUERIES["incremental_rebuild"](spark, AT).collect()] == [("first build", 1), ("again", 0), ("changed", 1), ("changed back", 0), ("new day", 1)]
    assert sizes == [(29, 29), (0, 1), (1, 1), (0, 1), (1, 1)]  # 30 days in all
