import math

import numpy as np
import pyarrow as pa
import pytest

from weft.llm import embedding_dedup, queries


def plain(rows, threshold=0.93):
    """vec_id -> (n_links, component) by brute force, for unique ids."""
    ok = {i: np.array(v, float) for i, v, l in rows if i is not None and l is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: l for i, _, l in rows}
    ids = sorted(ok)
    links = {i: set() for i, _, _ in rows}
    for l in {label[i] for i in ids}:
        own = [i for i in ids if label[i] == l]
        for n in {len(ok[i]) for i in own}:
            some = [i for i in own if len(ok[i]) == n]
            x = np.stack([ok[i] / np.linalg.norm(ok[i]) for i in some])
            for a, b in zip(*np.nonzero(x @ x.T >= threshold), strict=True):
                if a != b:
                    links[some[a]].add(some[b])
    comp = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for i in links:
            least = min([comp[i], *(comp[j] for j in links[i])], key=lambda x: (x is None, x))
            if least != comp[i]:
                comp[i], changed = least, True
    return {i: (len(links[i]), comp[i]) for i in links}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "w", 1) for r in rows], "vec_id long, embedding array<float>, label int, window string, node int").repartition(3)


def clustered(n, groups, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, 16))
    x = centres[rng.integers(0, groups, n)] + rng.standard_normal((n, 16)) * rng.choice([0.05, 0.2, 1], (n, 1))
    return [(int(k), [float(np.float32(a)) for a in v], int(rng.integers(0, 3))) for k, v in enumerate(x)]


@pytest.mark.parametrize("window, part", [(256, 1024), (16, 1024), (16, 20), (4096, 50)])
def test_links_of_brute_force(spark, monkeypatch, window, part):
    monkeypatch.setattr(embedding_dedup, "WINDOW_ROWS", window)
    monkeypatch.setattr(embedding_dedup, "PART_ROWS", part)
    rows = clustered(900, 25, 3)
    rows += [(1000 + k, rows[k % 3][1], rows[k % 3][2]) for k in range(40)]
    got = {r.row_id: (r.n_links, r.component) for r in embedding_dedup.near_duplicates(frame(spark, rows)).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert 0.998 * there <= found <= there
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, v, None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 2.0], 1), (8, [math.nan, 1.0, 1.0], 1), (9, [math.inf, 1.0, 1.0], 1), (None, v, 1), (10, [1.0, 2.0], 1), (11, [-0.0, 1.0], 2), (12, [0.0, 1.0], 2), (13, [2.0, 4.0, 6.0], 1)]
    got = sorted(((r.row_id or 0, r.n_links, r.component) for r in embedding_dedup.near_duplicates(frame(spark, rows)).collect()), key=lambda r: r[0])
    assert got == [(0, 0, None), (1, 3, 1), (2, 3, 1), (2, 3, 1), *((k, 0, k) for k in range(3, 11)), (11, 1, 11), (12, 1, 11), (13, 3, 1)]
    assert embedding_dedup.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_op7_on_a_whole_table(spark):
    at = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op7_embedding_dedup(spark, at).collect()} == {i: (*x, i == x[1]) for i, x in plain(rows).items()}


def test_recall_on_near_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 64))
    x[:1100] = x[0] + rng.standard_normal((1100, 64)) * rng.choice([0.02, 0.1, 0.25], (1100, 1))
    x[1100:1300] = x[1300:1500] + rng.standard_normal((200, 64)) * 0.2
    rows = [(k, [float(np.float32(a)) for a in v], 1) for k, v in enumerate(x)]
    t = frame(spark, rows)
    got = {r.row_id: (r.n_links, r.component) for r in embedding_dedup.near_duplicates(t).collect()}
    want = plain(rows)
    assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}
    assert sum(n for n, _ in got.values()) >= 0.999 * sum(n for n, _ in want.values())


def test_most_pairs_are_not_compared(spark, monkeypatch):
    """Windows are bounded: of unrelated vectors, only neighbours in the sorted order meet."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 32))
    x[::10] = x[5::10] + 0.1 * rng.standard_normal((300, 32))
    rows = [(k, [float(np.float32(a)) for a in v], 1) for k, v in enumerate(x)]
    classes = frame(spark, rows).selectExpr("vec_id as uid", "cast(label as string) as label", "embedding", "256 as bytes")
    as_bytes = lambda batches: (pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.array(v, float).tobytes() for v in b.column(2).to_pylist()], pa.binary()), b.column(3)], names=["uid", "label", "vector", "bytes"]) for b in batches)
    classes = classes.mapInArrow(as_bytes, "uid long, label string, vector binary, bytes int")
    bits, n = embedding_dedup.passes(3000, 0.93)
    assert bits > 0 and n > 1
    ranked = embedding_dedup.in_order(classes, bits, n, 3000).toPandas()
    assert sorted(ranked["rank"]) == list(range(3000 * n))
    for _, one in ranked.groupby("turn"):
        assert one["rank"].max() - one["rank"].min() == 2999
        assert (one["far"] - one["back"] + 1).sum() < 0.1 * 3000**2
    met = embedding_dedup.neighbours(embedding_dedup.in_order(classes, bits, n, 3000), 3000, n, 0.93).collect()
    assert {r.uid for r in met} >= {k for k in range(3000) if k % 10 in (0, 5)}
    assert len({r.uid for r in met}) < 1500
