import re

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_packing import check as check_packing
from tests.llm.test_simhash import plain_components, plain_print
from tests.llm.test_suffix_dedup import plain as plain_cut
from weft.llm import quality, queries

AT = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, AT).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_lengths(stages):
    for done in stages[1:5]:
        assert done.columns == stages[0].columns and [t for _, t in done.dtypes] == [t for _, t in stages[0].dtypes]
    for r in stages[4].collect():
        assert r.n_chars == len(r.text)


def test_quality_keeps_what_scores_well(spark, stages):
    before, after = rows(stages[0]), rows(stages[1])
    ids = sorted(before)
    scores = queries.quality_model(spark, AT).scores([before[i].text for i in ids])
    assert set(after) == {i for i, s in zip(ids, scores, strict=True) if s >= quality.THRESHOLD}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{AT}/labels.parquet").collect()}
    assert all(i in after for i, q in labels.items() if q == 1)


def test_one_of_each_group_stays(stages):
    before, after = rows(stages[1]), rows(stages[2])
    fps = {i: plain_print(r.text) for i, r in before.items()}
    label = plain_components(list(fps.values()))
    least = {}
    for i in sorted(before):
        least.setdefault(label[fps[i]], i)
    assert set(after) == {i for i in before if least[label[fps[i]]] == i}
    assert len(after) < len(before)


def test_passages_are_cut(stages):
    before, after = rows(stages[2]), rows(stages[3])
    want = {i: new for i, _, new, _ in plain_cut([(i, r.text) for i, r in before.items()])}
    assert {i: r.text for i, r in after.items()} == want


def test_private_data_go(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert before.keys() == after.keys()
    form = re.compile(r"[\w.]+@[\w.]+|\d{16}|AKIA\w{16}|[0-9a-f]{40}|\(\d{3}\) \d{3}-\d{4}")
    olds = {m for r in before.values() for m in form.findall(r.text)}
    news = {m for r in after.values() for m in form.findall(r.text)}
    assert len(olds) == len(news) > 20 and not olds & news


def test_packing_of_what_is_left(stages):
    docs = [(r.doc_id, r.text) for r in stages[4].collect()]
    sequences, least = check_packing(stages[5].collect(), docs)
    assert sequences <= least * 1.01 + 1


def test_run_is_the_stages_one_after_another(spark, stages):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, AT).select(key).collect())) == sorted(map(tuple, stages[5].select(key).collect()))
    assert np.array_equal(sorted(stages[5].columns), sorted([*key, "sequence_id", "offset"]))
