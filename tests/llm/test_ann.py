import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weft.llm import ann, queries


def plain(ids, x, asked, k=20):
    out = {}
    for i in asked:
        others = ids != ids[i]
        s = (x[others] * x[i]).sum(axis=1)
        order = np.lexsort((ids[others], -s))[:k]
        out[int(ids[i])] = [(int(a), float(b)) for a, b in zip(ids[others][order], s[order], strict=True)]
    return out


def check(rows, want, least=0.9):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == want.keys()
    hit = 0
    for q, near in want.items():
        assert len(got[q]) == len(near)
        assert [(-s, v) for v, s in got[q]] == sorted((-s, v) for v, s in got[q])
        hit += len({v for v, _ in near} & {v for v, _ in got[q]})
    assert hit >= least * sum(map(len, want.values()))
    return hit / max(1, sum(map(len, want.values())))


def share(x, ids, asked, k=20):
    """(recall, share of the pairs that were verified) of a search of one part."""
    longest = float(np.linalg.norm(x, axis=1).max())
    i, j, _, verified = ann.search(ids, x, longest, ids[asked], x[asked], np.full(len(asked), -np.inf), k)
    want = plain(ids, x, asked, k)
    hit = sum(len({v for v, _ in want[int(ids[a])]} & set(ids[j[i == n]].tolist())) for n, a in enumerate(asked))
    return hit / (k * len(asked)), verified / (len(asked) * len(x))


def test_the_stop_leaves_most_candidates_unverified():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 64))
    x = centres[rng.integers(0, 60, 6000)] + 0.5 * rng.standard_normal((6000, 64))
    recall, seen = share(x, rng.permutation(6000), np.arange(0, 6000, 100))
    assert recall >= 0.9 and seen < 0.1


def test_the_stop_on_a_table_without_clusters():
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = t.column("vec_id").to_numpy(), np.array(t.column("embedding").to_pylist(), float)
    recall, seen = share(x, ids, np.flatnonzero(ids % 20 == 0))
    assert recall >= 0.9 and seen < 0.55


def test_cells_far_away_are_not_visited():
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 64)) * 2
    x = centres[rng.integers(0, 40, 60000)] + 0.3 * rng.standard_normal((60000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    longest = float(np.linalg.norm(x, axis=1).max())
    p = ann.lifted(x, longest)
    cells, asked = ann.Cells(p[:16384], len(x)), np.arange(0, 60000, 1500)
    scores = np.sort(x[asked] @ x.T, axis=1)[:, -21]
    near = np.einsum("ij,ij->i", x[asked], x[asked]) + longest**2 - 2 * scores
    of = cells.of(p)
    low, high = (np.array([f(p[of == c], axis=0) for c in range(len(cells.cell))]) for f in (np.min, np.max))
    seen = ann.far(ann.flat(x[asked]), low, high) <= (ann.chi_square_quantile(ann.CONFIDENCE, ann.DIMENSIONS) * near)[:, None]
    assert len(cells.cell) > 8 and seen.mean() < 0.3


@pytest.mark.parametrize("at", ["sf0.01", "sf0.1"])
def test_op6_recall_on_whole_tables(spark, at):
    t = spark.read.parquet(f"/root/testdata/{at}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in t]), np.array([r.embedding for r in t], float)
    check(queries.op6_ann(spark, f"/root/testdata/{at}").collect(), plain(ids, x, np.flatnonzero(ids % 20 == 0)), 0.95)


def test_many_cells_lengths_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 200)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ann, "LEAF_ROWS", 8)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 12)) * 3
    x = (centres[rng.integers(0, 20, 3000)] + rng.standard_normal((3000, 12)) * 0.4) * rng.uniform(0.5, 1.5, (3000, 1))
    x[1000:2000] = x[7]
    ids = rng.permutation(9000)[:3000]
    df = spark.createDataFrame([(int(i), v.tolist(), "cell") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, cell string")
    got = ann.neighbours(df, F.col("row_id") % 20 == 0, 20).collect()
    check(got, plain(ids, x, np.flatnonzero(ids % 20 == 0)), 0.93)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, None), (40, [0.0, 0.0]), (3, [math.nan, 1.0]), (60, [math.inf, 1.0]), (4, [1.0, None]), (None, [1.0, 1.0]), (5, [1.0]), (80, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, part int")
    got = sorted(tuple(r) for r in ann.neighbours(df, F.col("row_id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 0.0), (0, 3, 20, 0.0), (20, 1, 1, 2.0), (20, 2, 0, 0.0)]
    assert ann.neighbours(df.limit(0), F.col("row_id") % 20 == 0).count() == 0


def test_quantile():
    assert ann.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert ann.chi_square_quantile(0.5, 2) == pytest.approx(1.386, abs=1e-3)
