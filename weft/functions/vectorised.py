"""Python functions over Arrow batches, for what built-in functions can't say."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scalar(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """A function from pandas Series to a Series of the same length, as one over columns."""
    return lambda build: F.pandas_udf(build, returnType=returns)


def aggregate(df: DataFrame, by: Sequence[str], partial: Callable, state: str, merge: Sequence[Column]) -> DataFrame:
    """A user's aggregate in two steps, so that no task ever holds a whole group.

    partial: from a pandas frame of some rows to one with a row of state for each of its keys. It sees each
    batch by itself, before the shuffle. state: the schema of what it gives, keys included. merge: aggregates of built-in
    functions over the states, which must not depend on how the rows were cut in batches.
    """

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        for batch in batches:
            if len(batch):
                yield partial(batch)

    return df.mapInPandas(run, state).groupBy(*by).agg(*merge)


def table(returns: str | T.StructType) -> Callable[[type], Callable]:
    """A table function of a class with `eval`, to be joined laterally."""
    return lambda kind: F.udtf(kind, returnType=returns)
