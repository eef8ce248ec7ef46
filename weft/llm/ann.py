"""Approximate nearest neighbours by stable projections in a kd-tree, with a chi-square stop.

Largest inner product is made nearest distance: every candidate gets one more coordinate that lifts it to
the length M of the longest in its range of lengths (each a factor of 2^0.25 wide), queries get a zero there; then |q - x|^2 = |q|^2 + M^2 - 2 q.x.
Vectors are projected to `DIMENSIONS` coordinates by normal (2-stable) random directions, made orthogonal where
the width allows, in which squared distances are the true ones times a chi-square variable of that many degrees of
freedom, or one that varies less. A kd-tree over the projections gives the leaves that a
query can't rule out; their rows are candidates in the order of projected distance, and are verified by their true
inner product in growing steps. The search stops when the next candidate's projected distance r and the k-th
best true distance d satisfy r^2 > c * d^2, where c is the `CONFIDENCE` quantile of chi-square: a
candidate that is nearer than d would have shown up before with that probability. What the stop cuts off
is never compared on the vectors.

The upper levels of the tree are fitted on a sample of at most `SAMPLE_ROWS` rows and make cells; every row
is indexed in its cell and range of lengths, and a cell with more than `CELL_ROWS` rows is cut into parts by a hash,
each with a tree of its own. A query first searches the cell that it would be indexed in, and then every other cell that its
k-th best distance does not rule out by the same test. Queries come to a part in blocks of at most about
`BLOCK_ROWS`, so a task holds a bounded number of both.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor
do rows without an id or with a length other than the most common one. A query finds no row with its own
id; repeated query rows are one query, repeated candidates are each a candidate. Equal scores go to the
smaller id. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm import _common, _vectors

DIMENSIONS = 24
CONFIDENCE = 0.9
CELL_ROWS = 8192
LEAF_ROWS = 64
BLOCK_ROWS = 4096
#: Rows that the cells are fitted on at most.
SAMPLE_ROWS = 16_384
SEED = 11

_CANDIDATES = "query_id long, vec_id long, score double"


def chi_square_quantile(p: float, freedom: int) -> float:
    """By bisection of the closed form for an even number of degrees of freedom."""

    def below(x: float) -> float:
        term = total = math.exp(-x / 2)
        for i in range(1, freedom // 2):
            term *= x / 2 / i
            total += term
        return 1 - total

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def directions(width: int) -> np.ndarray:
    """A direction in each column; those of a group of width + 1 are orthogonal to each other."""
    rng, parts = np.random.default_rng(SEED + width), []
    for at in range(0, DIMENSIONS, width + 1):
        q, r = np.linalg.qr(rng.standard_normal((width + 1, min(width + 1, DIMENSIONS - at))))
        parts.append(q * np.sign(np.diag(r)) * math.sqrt(width + 1))
    return np.hstack(parts)


def ranges(x: np.ndarray) -> np.ndarray:
    """The range of each row's length."""
    return np.floor(4 * np.log2(np.linalg.norm(x, axis=1)) + 0.5).astype(np.int32)


def lifted(x: np.ndarray, longest: np.ndarray | float) -> np.ndarray:
    """Projections of candidates, with the coordinate that makes each as long as the longest of its range."""
    more = np.sqrt(np.maximum(0, np.square(longest) - np.einsum("ij,ij->i", x, x)))
    return np.column_stack((x, more)) @ directions(x.shape[1])


def flat(x: np.ndarray) -> np.ndarray:
    """Projections of queries."""
    return x @ directions(x.shape[1])[:-1]


class Cells:
    """A kd-tree's upper levels."""

    def __init__(self, sample: np.ndarray, n: int) -> None:
        depth = max(0, math.ceil(math.log2(max(1, n / (CELL_ROWS / 2)))))
        depth = min(depth, int(math.log2(max(1, len(sample) / 4)))) if len(sample) else 0
        self.cell, self.cut = {}, {}
        todo = [(1, np.arange(len(sample)), depth)]
        while todo:
            node, own, levels = todo.pop()
            if levels and len(own) > 1:
                axis = int(np.argmax(np.ptp(sample[own], axis=0)))
                at = float(np.median(sample[own, axis]))
                left = sample[own, axis] <= at
                if left.any() and not left.all():
                    self.cut[node] = (axis, at)
                    todo += [(2 * node, own[left], levels - 1), (2 * node + 1, own[~left], levels - 1)]
                    continue
            self.cell[node] = len(self.cell)

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int32)
        todo = [(1, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if node in self.cut:
                axis, at = self.cut[node]
                left = x[own, axis] <= at
                todo += [(2 * node, own[left]), (2 * node + 1, own[~left])]
            else:
                out[own] = self.cell[node]
        return out


def far(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared projected distances from queries to boxes."""
    out = np.zeros((len(x), len(low)))
    for axis in range(DIMENSIONS):
        gap = np.maximum(np.maximum(low[None, :, axis] - x[:, axis, None], x[:, axis, None] - high[None, :, axis]), 0)
        out += gap * gap
    return out


def leaves(p: np.ndarray) -> list[np.ndarray]:
    """Rows of a kd-tree's leaves."""
    todo, out = [np.arange(len(p))], []
    while todo:
        own = todo.pop()
        if len(own) <= LEAF_ROWS:
            out.append(own)
            continue
        axis = int(np.argmax(np.ptp(p[own], axis=0)))
        middle = len(own) // 2
        order = own[np.argpartition(p[own, axis], middle)]
        todo += [order[:middle], order[middle:]]
    return out


def search(ids: np.ndarray, x: np.ndarray, longest: float, query_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Verified neighbours (query, row, score) among a part's rows x, all of one range of lengths, and how many pairs were verified.

    bound: a score that each query has k candidates for elsewhere.
    """
    p, quantile = lifted(x, longest), chi_square_quantile(CONFIDENCE, DIMENSIONS)
    groups = leaves(p)
    low, high = (np.array([f(p[g], axis=0) for g in groups]) for f in (np.min, np.max))
    rows_of, sizes = np.concatenate(groups), np.fromiter(map(len, groups), np.int64, len(groups))
    ids, x, p, squares = ids[rows_of], x[rows_of], p[rows_of], np.einsum("ij,ij->i", p[rows_of], p[rows_of])
    lengths = np.einsum("ij,ij->i", q, q) + longest**2
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    verified, first = 0, max(4 * k, 64)
    for at in range(0, len(q), 128):
        qp = flat(q[at : at + 128])
        apart = far(qp, low, high)
        near = np.einsum("ij,ij->i", qp, qp)[:, None] + squares[None, :] - 2 * (qp @ p.T)
        for i in range(at, at + len(qp)):
            r, leaf = near[i - at], np.repeat(apart[i - at], sizes)
            own = query_ids[i]
            scores = np.full(k, -np.inf)
            found: list[tuple[np.ndarray, np.ndarray]] = []

            def reach(floor: float, i: int = i) -> float:
                return quantile * max(lengths[i] - 2 * floor, 0) * (1 + 1e-9) if floor > -np.inf else np.inf

            limit = reach(bound[i])
            todo = np.flatnonzero((leaf <= limit) & (r <= limit))
            nearest = todo if len(todo) <= first else todo[np.argpartition(r[todo], first - 1)[:first]]
            step, done = nearest, nearest
            while len(step):
                at_hand = step[ids[step] != own]
                verified += len(at_hand)
                about, floor = x[at_hand] @ q[i], max(bound[i], float(scores.min()))
                at_hand = at_hand[about >= floor - 1e-9 * abs(floor)]
                # The same sum for equal vectors, wherever they stand.
                exact = (q[i] * x[at_hand]).sum(axis=1)
                found.append((at_hand, exact))
                both = np.concatenate((scores, exact))
                scores = np.partition(both, len(both) - k)[-k:]
                limit = reach(max(bound[i], float(scores.min())))
                if done is nearest and len(nearest) < len(todo):  # the rest in order, as far as the first ones leave it
                    left = (r <= limit) & (leaf <= limit)
                    left[nearest] = False
                    rest = np.flatnonzero(left)
                    todo, done, size = rest[np.argsort(r[rest], kind="stable")], 0, 2 * first
                elif done is nearest:
                    break
                step = todo[done : done + size]
                step = step[r[step] <= limit]
                done, size = done + size, 2 * size
            if not found:
                continue
            rows, exact = (np.concatenate(z) for z in zip(*found, strict=True))
            good = exact >= max(bound[i], float(scores.min()))
            rows, exact = rows[good], exact[good]
            top = np.lexsort((ids[rows], -exact))[:k]
            out.append((np.full(len(top), i), rows_of[rows[top]], exact[top]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), verified
    return (*(np.concatenate(z) for z in zip(*out, strict=True)), verified)


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest; is_query: which rows of `vectors` are queries, by `row_id`."""
    spark = vectors.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_vectors.doubles(batch.column("vector")))
            norms = [None if x is None else float(np.linalg.norm(x)) for x in found]
            of = [None if x is None else int(ranges(x[None, :])[0]) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array([None if x is None else x.tobytes() for x in found], pa.binary()), pa.array([None if x is None else len(x) for x in found], pa.int32()), pa.array(norms, pa.float64()), pa.array(of, pa.int32())], names=["row_id", "vector", "width", "norm", "range"])

    rows = vectors.select(F.col(vec_id).cast("long").alias("row_id"), F.col(embedding).alias("vector")).where("row_id is not null")
    rows = _common.stash(rows.mapInArrow(read, "row_id long, vector binary, width int, norm double, range int").where("vector is not null"), "ann")
    shape = rows.groupBy("width").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").head()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, n = shape.width, shape.n
    rows = rows.where(F.col("width") == width).select("row_id", "vector", "norm", "range")
    # A row for each range, of which the exponents of numbers bound the number.
    longest = {r.range: r.longest for r in rows.groupBy("range").agg(F.max("norm").alias("longest")).collect()}

    def project(batch: pa.RecordBatch) -> np.ndarray:
        return lifted(_vectors.stacked(batch.column("vector"), width), np.array([longest[r] for r in batch.column("range").to_pylist()]))

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in project(batch)], pa.binary())], names=["p"])

    share = rows.where(F.pmod(F.xxhash64("row_id"), F.lit(max(1, n * 2 // SAMPLE_ROWS))) == 0)
    sample = [r.p for r in share.mapInArrow(projected, "p binary").limit(SAMPLE_ROWS).collect()]
    cells = Cells(np.frombuffer(b"".join(sample), np.float64).reshape(-1, DIMENSIONS), n)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = project(batch)
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * DIMENSIONS), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(cells.of(p)), *(batch.column(c) for c in ("range", "row_id", "vector")), each], names=["cell", "range", "row_id", "vector", "p"])

    indexed = _common.stash(rows.mapInArrow(place, "cell int, range int, row_id long, vector binary, p array<double>"), "cells")
    placed = indexed.drop("p")
    # A row for each cell and range with the box of its rows; the sample bounds the cells.
    boxes = (F.array(*(f(F.col("p")[axis]) for axis in range(DIMENSIONS))).alias(name) for f, name in ((F.min, "low"), (F.max, "high")))
    sizes = indexed.groupBy("cell", "range").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("parts"), *boxes).collect()
    low, high = (np.array([r[c] for r in sizes], np.float64) for c in ("low", "high"))
    tops = np.array([longest[r.range] for r in sizes])
    of_cell, of_range, parts = (np.array([r[c] for r in sizes], np.int64) for c in ("cell", "range", "parts"))
    counted = spark.createDataFrame([(r.cell, r.range, r.parts) for r in sizes], "cell int, range int, parts int")
    queries = placed.where(is_query).select("cell", "range", "row_id", "vector").dropDuplicates(["row_id"])

    def visits(asked: DataFrame, first: bool) -> DataFrame:
        quantile = chi_square_quantile(CONFIDENCE, DIMENSIONS)

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    home, own, bound = (batch.column(c).to_numpy() for c in ("cell", "range", "bound"))
                    at_home = (home[:, None] == of_cell[None, :]) & (own[:, None] == of_range[None, :])
                    if first:
                        who, where = np.nonzero(at_home)
                    else:
                        x = _vectors.stacked(batch.column("vector"), width)
                        near = np.einsum("ij,ij->i", x, x)[:, None] + np.square(tops)[None, :] - 2 * bound[:, None]
                        who, where = np.nonzero((far(flat(x), low, high) <= quantile * np.maximum(near, 0) * (1 + 1e-9)) & ~at_home)
                    times = parts[where]
                    who, where, part = np.repeat(who, times), np.repeat(where, times), _common.ragged(np.zeros(len(times), np.int64), times)
                    index = pa.array(who)
                    yield pa.RecordBatch.from_arrays([pa.array(of_cell[where].astype(np.int32)), pa.array(of_range[where].astype(np.int32)), pa.array(part.astype(np.int32)), batch.column("row_id").take(index), batch.column("vector").take(index), batch.column("bound").take(index)], names=["cell", "range", "part", "row_id", "vector", "bound"])

        return asked.select("cell", "range", "row_id", "vector", "bound").mapInArrow(go, "cell int, range int, part int, row_id long, vector binary, bound double")

    def run(asked: DataFrame, first: bool) -> DataFrame:
        going = _common.stash(visits(asked, first), "visits")
        where = ["cell", "range", "part"]
        crowd = going.groupBy(*where).count().select(*where, F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks"))
        candidates = placed.join(F.broadcast(counted), ["cell", "range"]).withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int"))
        candidates = candidates.join(crowd, where).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        going = going.join(crowd, where).withColumn("block", F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int"))

        def meet(key: tuple, own: pa.Table, asking: pa.Table) -> pa.Table:
            own, asking = own.combine_chunks(), asking.combine_chunks()
            empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
            if not own.num_rows or not asking.num_rows:
                return pa.table(empty)
            ids, query_ids = own.column("row_id").to_numpy(), asking.column("row_id").to_numpy()
            x, q = (_vectors.stacked(t.column("vector"), width) for t in (own, asking))
            i, j, s, _ = search(ids, x, longest[key[1].as_py()], query_ids, q, asking.column("bound").to_numpy(), k)
            return pa.table({"query_id": query_ids[i], "vec_id": ids[j], "score": s})

        keys = [*where, "block"]
        right = going.select(*(F.col(c).alias(f"to_{c}") for c in keys), "row_id", "vector", "bound")
        met = candidates.select(*keys, "row_id", "vector").groupBy(*keys).cogroup(right.groupBy(*(f"to_{c}" for c in keys)))
        return _common.stash(met.applyInArrow(meet, _CANDIDATES), "near")

    none = queries.withColumn("bound", F.lit(-math.inf))
    near = run(none, True)
    # A cell's parts give k candidates each; the k-th best of all is what the others have to beat.
    best = near.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("nth") == k)
    bounded = queries.join(best.select("query_id", F.col("score").alias("least")), F.col("row_id") == F.col("query_id"), "left").select("cell", "range", "row_id", "vector", F.coalesce("least", F.lit(-math.inf)).alias("bound"))
    found = near.union(run(bounded, False))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
