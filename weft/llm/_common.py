"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 4 << 20
#: Bytes that a partition dealt by a fixed number gets at most, unless one key has more.
PARTITION_BYTES = 64 << 20
#: Estimates beyond it are none: plans that don't know a size give the largest number there is.
MOST_BYTES = 1 << 47

_kept: set[str] = set()
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, wherever the driver has it from."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    top = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp()  # the driver serves it to executors as they come
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/{top.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    ship(spark)
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions(spark: SparkSession, size: int) -> int:
    """How many partitions to deal `size` bytes to: as many as the session shuffles to, and more where one would get over `PARTITION_BYTES`."""
    return max(parallelism(spark), -(-size // PARTITION_BYTES))


def size_of(df: DataFrame) -> int:
    """Bytes that the optimizer expects of df, from the sizes of its files; 0 where it doesn't know."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < MOST_BYTES else 0


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set, which only a local master can use."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir isn't set: executors need a folder that all of them share")
        found = tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/weft-{name}-{uuid.uuid4().hex}"
    if not _kept:
        atexit.register(_forget, spark)
    _kept.add(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a stash that no later plan reads."""
    path = getattr(df, "stash_path", None)
    if path:
        _delete(df.sparkSession, path)
        _kept.discard(path)


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables so far. Results that weren't written elsewhere can't be read after it."""
    for path in list(_kept):
        _delete(spark, path)
        _kept.discard(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _forget(spark: SparkSession) -> None:
    """At exit; a session that is gone by then leaves its folders behind."""
    with contextlib.suppress(Exception):
        for path in _kept:
            _delete(spark, path)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about `most` bytes of text each, and a row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lossless_text(column: str = "text") -> F.Column:
    """The text, with a null as empty."""
    return F.coalesce(F.col(column), F.lit(""))
