"""Connected components by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import _common


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a long, b long) that isn't its component's smallest.

    component is the smallest node that links reach. Every round halves the depth of what it finds,
    and each ends in a table of the shared folder. Minima are combined before their shuffle, and the
    joins are plain ones whose large partitions Spark splits, so a node with very many links is no
    single task.
    """
    now = _common.stash(_canonical(edges, "a", "b"), "links")
    before = _signature(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are tables of their own: only between two plain shuffles does Spark split a node's many links.
        least = _common.stash(both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m")), "least")
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = _common.stash(large, "large")
        lower = _common.stash(large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")), "least")
        tied = large.join(lower, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select("x.v", "x.m")
        then = _common.stash(_canonical(tied, "v", "m"), "links")
        after = _signature(then)
        for gone in (now, least, large, lower):
            _common.discard(gone)
        now = then
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _canonical(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()


def _signature(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).head()
    return row.n, row.x


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that join what the links a-b join among n nodes."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        then = label.copy()
        for side in (a, b):
            np.minimum.at(then, side, least)
            np.minimum.at(then, label[side], least)
        then = then[then]
        if (then == label).all():
            break
        label = then
    joined = np.flatnonzero(label != np.arange(n))
    return joined, label[joined]
