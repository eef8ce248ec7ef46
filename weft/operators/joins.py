"""As-of, range and salted joins as plans of built-in operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, take: Sequence[str], strict: bool = False) -> DataFrame:
    """Each left row with the columns `take` of the last right row of its keys that isn't later (strict: that is earlier).

    Both sides go through one sorted window, so nothing is multiplied: a shuffle on the keys and a
    sort. `take` should determine itself among right rows of equal keys and time: of those the greatest counts.
    """
    side = F.lit(0 if strict else 2)
    one = left.select(F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("__row"), *(F.col(k).alias(f"__{k}") for k in by), F.col(left_at).alias("__at"), side.alias("__side"), F.lit(None).cast(_struct(right, take)).alias("__got"))
    two = right.select(F.lit(None).cast(one.schema["__row"].dataType).alias("__row"), *(F.col(k).alias(f"__{k}") for k in by), F.col(right_at).alias("__at"), F.lit(1).alias("__side"), F.struct(*take).alias("__got"))
    order = Window.partitionBy(*(f"__{k}" for k in by)).orderBy("__at", "__side", F.col("__got").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    seen = one.union(two).withColumn("__last", F.last("__got", ignorenulls=True).over(order)).where("__row is not null")
    return seen.select("__row.*", *(F.col(f"__last.{c}").alias(c) for c in take))


def _struct(df: DataFrame, take: Sequence[str]) -> str:
    return "struct<" + ",".join(f"`{c}`:{df.schema[c].dataType.simpleString()}" for c in take) + ">"


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, by: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Pairs whose left `point` is in the right side's [low, high], by an equi-join on bins of `width`.

    A right row goes to each bin that its range touches, so `width` should be about a usual
    range's length; a pair meets in the point's bin only, so no pair comes twice.
    """
    bin_of = lambda x: F.floor(F.col(x).cast("double") / width).cast("long")
    a = left.withColumn("__bin", bin_of(point))
    b = right.where(F.col(low) <= F.col(high)).withColumn("__bins", F.explode(F.sequence(bin_of(low), bin_of(high))))
    on: Column = F.col("__bin") == F.col("__bins")
    for x, y in by:
        on = on & (F.col(x) == F.col(y))
    return a.join(b, on).where(F.col(point).between(F.col(low), F.col(high))).drop("__bin", "__bins")


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """An equi-join on `key` (inner, or left with the large side on the left) whose hot keys are `salts` tasks each."""
    if how not in ("inner", "left"):
        raise ValueError("salting keeps only inner and left joins whole")
    a = left.withColumn("__salt", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in left.columns)), F.lit(salts)).cast("int"))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [key, "__salt"], how).drop("__salt")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts groups short before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
