"""Every query of the subpackage over empty tables and over nulls, repeated rows and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weft.llm import queries

TABLES = {"documents": 12, "embeddings": 12, "pages": 12, "labels": 12}
ROWS = {"op6_ann": None, "pipeline": None, "op1_packing": None}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("edges")
    for t in TABLES:
        d = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        d.limit(0).write.parquet(f"{root}/empty/{t}.parquet")
        nulls = d.limit(6).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in d.schema))
        odd = nulls.union(d.limit(3)).union(d.limit(3)).withColumns({"extra": F.lit("x"), "score": F.lit(1), "k": F.lit(None).cast("int"), "component": F.lit(2), "own": F.lit(1.5)})
        odd.write.parquet(f"{root}/odd/{t}.parquet")
    return root


@pytest.mark.parametrize("name", [*queries.queries(), "pipeline"])
def test_edges(spark, folders, name):
    run = queries.queries().get(name, corpus_pipeline.run)
    assert run(spark, f"{folders}/empty").count() == 0
    rows = run(spark, f"{folders}/odd").collect()
    assert len(rows) == ROWS.get(name, 12) or (name in ROWS and rows)
