"""Token ids in binary shards, each a wavelet matrix.

A shard file (`WVM1`) holds, compressed, one bit-plane for each bit of the largest id, most
significant first. In every plane the ids stand in the order that the planes above left them in:
zeros of the plane above before its ones. Counts of ones before each 512-bit block, rebuilt on
opening from the plane itself, give rank in constant time; select is a binary search over them.

Rows of one table hold the files: (shard, part, documents with their lengths, payload), written by
Spark to the shared folder, so a lost executor's shard is written again by another.

Order is ascending doc_id, nulls first, equal ids in any order among themselves. A shard closes when
it has `SHARD_TOKENS` ids; a document is never split, so one longer than that is a shard of its own.
A null text is empty and has the end id alone; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm import _common, tokens

SHARD_TOKENS = 1 << 20
BLOCK_BITS = 512

_HEAD = struct.Struct("<4sBQ")
_SHARDS = "part int, shard int, doc_ids array<long>, lengths array<long>, n_ids long, payload binary"


def pack(ids: np.ndarray) -> bytes:
    """The file of a shard."""
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    now, planes = ids.astype(np.uint16 if levels <= 16 else np.uint32), []
    for shift in range(levels - 1, -1, -1):
        ones = now & now.dtype.type(1 << shift) != 0
        planes.append(np.packbits(ones, bitorder="little").tobytes())
        if shift:
            now = np.concatenate((np.compress(~ones, now), np.compress(ones, now)))
    squeeze = zstandard.ZstdCompressor(level=1).compress
    parts = [squeeze(x) for x in planes]
    return b"".join((_HEAD.pack(b"WVM1", levels, len(ids)), *(struct.pack("<I", len(x)) for x in parts), *parts))


class WaveletMatrix:
    """Access, rank and select on a shard file."""

    def __init__(self, payload: bytes) -> None:
        magic, self.levels, self.n = _HEAD.unpack_from(payload)
        if magic != b"WVM1":
            raise ValueError("not a token shard")
        sizes = struct.unpack_from(f"<{self.levels}I", payload, _HEAD.size)
        at, open_ = _HEAD.size + 4 * self.levels, zstandard.ZstdDecompressor().decompress
        self.planes = []
        for size in sizes:
            self.planes.append(np.frombuffer(open_(payload[at : at + size]), np.uint8))
            at += size
        self._ranks: list[np.ndarray] | None = None

    @property
    def ranks(self) -> list[np.ndarray]:
        """Ones before each block of each plane, and after the last."""
        if self._ranks is None:
            self._ranks = []
            step = BLOCK_BITS // 8
            for plane in self.planes:
                padded = np.concatenate((plane, np.zeros(-len(plane) % step, np.uint8)))
                self._ranks.append(np.concatenate(([0], np.cumsum(np.bitwise_count(padded).reshape(-1, step).sum(axis=1, dtype=np.int64)))))
        return self._ranks

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level][at >> 3]) >> (at & 7) & 1

    def _ones(self, level: int, at: int) -> int:
        """Ones of the plane before place `at`."""
        block, plane = at // BLOCK_BITS, self.planes[level]
        first, last = block * BLOCK_BITS // 8, at >> 3
        n = int(self.ranks[level][block]) + int(np.bitwise_count(plane[first:last]).sum())
        return n + ((int(plane[last]) & ((1 << (at & 7)) - 1)).bit_count() if at & 7 else 0)

    def _zeros(self, level: int) -> int:
        return self.n - int(self.ranks[level][-1])

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        out = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, at), self._ones(level, at)
            out = out << 1 | bit
            at = self._zeros(level) + ones if bit else at - ones
        return out

    def _reach(self, token: int, to: int) -> tuple[int, int]:
        """Where the token's ids among the first `to` lie below the last plane: first place and end."""
        first = 0
        for level in range(self.levels):
            a, b = self._ones(level, first), self._ones(level, to)
            if token >> (self.levels - 1 - level) & 1:
                zeros = self._zeros(level)
                first, to = zeros + a, zeros + b
            else:
                first, to = first - a, to - b
        return first, to

    def rank(self, token: int, to: int) -> int:
        """How often the token stands among the first `to` ids."""
        if token < 0 or token >> self.levels:
            return 0
        first, end = self._reach(token, min(to, self.n))
        return end - first

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, nth: int) -> int:
        """The place of the token's nth occurrence, from 0."""
        if not 0 <= nth < self.count(token):
            raise IndexError(nth)
        at = self._reach(token, self.n)[0] + nth
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            at = self._place(level, bit, at - self._zeros(level) if bit else at)
        return at

    def _place(self, level: int, bit: int, nth: int) -> int:
        """Select on a plane: where its nth bit of this kind stands."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > nth:
                high = mid
            else:
                low = mid + 1
        return low

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All ids in order: the planes undone from the last to the first."""
        out = np.zeros(self.n, np.uint8)
        for shift, plane in enumerate(reversed(self.planes)):
            if shift in (8, 16):  # no wider than its bits need
                out = out.astype(np.uint16 if shift == 8 else np.uint32)
            ones = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            lower, upper = np.flatnonzero(~ones), np.flatnonzero(ones)
            above = np.empty(self.n, out.dtype)
            above[lower] = out[: len(lower)]
            above[upper] = out[len(lower) :] | out.dtype.type(1 << shift)
            out = above
        return out


def write_shards(docs: DataFrame, source: str, end_id: int, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Encode, order and write all documents; the table of the written files.

    source: the contents of a `tokenizers` file of byte-level BPE; path: where the table is to stay, of
    any store that Spark writes to (by default a folder that goes when the driver ends).
    """
    dtype = tokens.widest(source, end_id)
    end, each = np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, shard = tokens.library(source, "byte", dtype), TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        names: list[int] = []
        lengths: list[int] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal shard, size
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([names], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([pack(np.frombuffer(b"".join(ids), dtype))], pa.binary())],
                names=["part", "shard", "doc_ids", "lengths", "n_ids", "payload"],
            )
            shard, size = shard + 1, 0
            for x in (ids, names, lengths):
                x.clear()
            return out

        for batch in _common.slices(batches, "text", tokens.SLICE_BYTES):
            for name, found in zip(batch.column("row_id").to_pylist(), tool.ids_of(batch.column("text").to_pylist()), strict=True):
                found += end
                names.append(name)
                ids.append(found)
                lengths.append(len(found) // each)
                size += len(found) // each
                if size >= SHARD_TOKENS:
                    yield close()
        if names:
            yield close()

    rows = docs.select(F.col(doc_id).cast("long").alias("row_id"), _common.lossless_text(text).alias("text"))
    n = max(_common.partitions(docs.sparkSession, _common.size_of(rows)), docs.sparkSession.sparkContext.defaultParallelism)
    # Rows of one id, or without one, are in any order, and so may go to several partitions.
    order = [F.col("row_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    shards = ordered.mapInArrow(build, _SHARDS)
    if path is None:
        return _common.stash(shards, "tokens")
    shards.write.mode("errorifexists").parquet(path)
    return docs.sparkSession.read.schema(shards.schema).parquet(path)


def read_documents(shards: DataFrame) -> DataFrame:
    """Every document out of the files: (doc_id, start, n_tokens, ids_crc32, part, shard, place)."""
    # Range partitions are in doc_id order, and so are the shards within each. Their totals are few:
    # one row for each range partition is summed in one task, the shards within a partition by its own.
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    within = shards.select("part", "shard", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")).alias("shard_start"))
    begins = within.join(before, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("begin"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = WaveletMatrix(row["payload"]).tokens().astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[b - n : b]) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                k = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64()), pa.array([row["part"]] * k, pa.int32()), pa.array([row["shard"]] * k, pa.int32())],
                    names=["doc_id", "place", "n_tokens", "ids_crc32", "part", "shard"],
                )

    docs = shards.select("part", "shard", "doc_ids", "lengths", "payload").mapInArrow(read, "doc_id long, place long, n_tokens long, ids_crc32 long, part int, shard int")
    return docs.join(begins, ["part", "shard"]).select("doc_id", (F.col("begin") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "part", "shard", "place")
