import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import quality, queries


def test_recursion_equals_all_labellings():
    rng = np.random.default_rng(0)
    n_lines = np.array([1, 4, 3, 1, 5])
    unary, pair = rng.standard_normal(n_lines.sum()), rng.standard_normal((2, 2))
    good, moves, total = quality.forward_backward(unary, n_lines, pair)
    at = 0
    for d, n in enumerate(n_lines):
        u = unary[at : at + n]
        every = list(itertools.product((0, 1), repeat=int(n)))
        w = np.exp([sum(x * y for x, y in zip(u, ys, strict=True)) + sum(pair[a, b] for a, b in zip(ys, ys[1:], strict=False)) for ys in every])
        assert total[d] == pytest.approx(np.log(w.sum()))
        for t in range(n):
            assert good[at + t] == pytest.approx(sum(x for x, ys in zip(w, every, strict=True) if ys[t]) / w.sum())
        for a, b in itertools.product((0, 1), repeat=2):
            assert moves[d, a, b] == pytest.approx(sum(x * sum(p == (a, b) for p in zip(ys, ys[1:], strict=False)) for x, ys in zip(w, every, strict=True)) / w.sum())
        at += n


def test_features_are_those_of_each_text_alone():
    texts = ["A b.\n\nc | d!\n", "", None, "é é é\té 12", "\n\n", "same\nsame\nsame", "x\r\ny\x0bz"]
    own, sizes, n_lines = quality.line_features(texts)
    each = [quality.line_features([t]) for t in texts]
    assert np.allclose(own, np.concatenate([e[0] for e in each]))
    assert n_lines.tolist() == [(t or "").count("\n") + 1 for t in texts]
    assert sizes.tolist() == [len(x.encode()) for t in texts for x in (t or "").split("\n")]


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{at}/labels.parquet")
    rows = queries.op9_quality(spark, at).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500
    right = {k: np.mean([r.predicted == k for r in rows if r.quality == k]) for k in (0, 1)}
    assert right[1] >= 0.99 and right[0] >= 0.95, right
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_odd_rows(spark):
    clean, bad = "The one thing and another of it. So it was.\n" * 3, "### $$$ %%%\n!!! ||| ###\n" * 3
    rows = [(k, clean if k % 2 else bad) for k in range(40)] + [(100, None), (101, ""), (None, clean), (102, clean), (102, clean), (103, "word " * 100_000), (104, "x\n" * 30_000)]
    docs = spark.createDataFrame([(*r, "en", 1.0) for r in rows], "doc_id long, text string, row_id string, score double").repartition(3)
    labels = spark.createDataFrame([(k, k % 2, "t") for k in range(40)] + [(None, 1, "t"), (5, None, "t"), (999, 1, "t"), (7, 1, "t")], "doc_id long, quality int, text string")
    model = quality.learn(docs, labels, F.lit(True))
    got = {}
    out = quality.score(docs, model)
    assert out.columns == ["doc_id", "text", "row_id", "score"]
    for r in out.collect():
        assert 0 <= r.score <= 1
        assert got.setdefault(r.doc_id, r.score) == r.score
    assert got[1] > 0.9 and got[102] > 0.9 and got[0] < 0.1 and got[100] == got[101]
    assert quality.score(docs.limit(0), model).count() == 0


def test_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(docs, quality.learn(docs, none, F.lit(True))).collect()] == [0.5, 0.5]
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert [r.score for r in quality.score(docs, quality.learn(docs, ones, F.lit(True))).collect()] == [1.0, 1.0]
