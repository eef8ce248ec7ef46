"""Best-fit packing of tokenised documents into sequences of fixed length.

Pieces differ for the packer only in their length, so the plan is made on the histogram of lengths:
at most `capacity` counts, however large the corpus. The longest length opens a sequence. Its gap is
looked up in an index of the sums of one, two or three lengths, made once over the lengths that occur; of the combinations
that fill it exactly, one that the counts still allow is taken as often as they do. Where none does, the longest length that fits goes in and the
smaller gap is looked up again. Each pattern runs at least one length short, which bounds the
plan by the capacity as well. Pieces then take their places by their rank within their length,
counted by bucket, so that one very common length is spread over as many tasks as there are buckets.

Defined results: a null text is empty, and an empty text is its end id alone; repeated rows are
packed each; a null id stays null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm import _common, tokens

CAPACITY = 2048


def cut(docs: DataFrame, source: str, end_id: int = 0, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most `capacity` ids; only longer documents are cut.

    source: the contents of a `tokenizers` file of plain-word BPE. Gives (row_id, piece, start,
    length, ids_crc32) and with keep_ids the ids as little-endian unsigned 32-bit integers.
    """
    end = np.array([end_id], "<u4").tobytes()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokens.library(source, "plain", "<u4")
        for batch in _common.slices(batches, "text", tokens.SLICE_BYTES):
            rows: list[tuple] = []
            for row_id, ids in zip(batch.column("row_id").to_pylist(), tool.ids_of(batch.column("text").to_pylist()), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((row_id, piece, at // 4, len(own) // 4, zlib.crc32(own), own if keep_ids else None))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 6 if keep_ids else 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=["row_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)])

    kept = docs.select(F.col(doc_id).cast("long").alias("row_id"), _common.lossless_text(text).alias("text"))
    return kept.mapInArrow(of, "row_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


class Sums:
    """Exact complements: by sum, the pairs and triples of lengths that give it. Which are still available, the counts say."""

    def __init__(self, lengths: np.ndarray, capacity: int) -> None:
        #: By sum, the smaller length of each pair, ascending.
        self.pairs: list[np.ndarray] = [np.zeros(0, np.int64)] * (capacity + 1)
        first, second = np.triu_indices(len(lengths))
        total, low = lengths[first] + lengths[second], lengths[first]
        total, low = total[total <= capacity], low[total <= capacity]
        order = np.lexsort((low, total))
        for own in np.split(order, np.flatnonzero(np.diff(total[order])) + 1) if len(order) else ():
            self.pairs[int(total[own[0]])] = low[own]
        #: By sum, the longest length of each triple, descending, where a pair gives the rest.
        paired = np.array([len(x) > 0 for x in self.pairs])
        self.triples = [longest[paired[s - longest]] for s in range(capacity + 1) for longest in [lengths[(lengths < s) & (3 * lengths >= s)][::-1]]]

    def pair(self, total: int, left: np.ndarray) -> tuple[int, int] | None:
        """The pair with most left."""
        low = self.pairs[total]
        if not len(low):
            return None
        n = np.where(low * 2 == total, left[low] // 2, np.minimum(left[low], left[total - low]))
        k = int(np.argmax(n))
        return (int(low[k]), total - int(low[k])) if n[k] > 0 else None

    def exact(self, gap: int, left: np.ndarray) -> tuple[int, ...] | None:
        """One, two or three available lengths that fill the gap."""
        if left[gap] > 0:
            return (gap,)
        if two := self.pair(gap, left):
            return two
        for one in self.triples[gap].tolist():
            if left[one] > 0:
                left[one] -= 1
                two = self.pair(gap - one, left)
                left[one] += 1
                if two:
                    return (one, *two)
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Patterns (how often, lengths in order) that use each length exactly as often as it is there."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    out, sums = [], Sums(np.flatnonzero(left), capacity)
    while len(there := np.flatnonzero(left)):
        parts, gap = [], capacity
        rest = left.copy()
        while gap:
            if parts and (found := sums.exact(gap, rest)):
                parts += found
                break
            fit = there[np.searchsorted(there, gap, side="right") - 1] if there[0] <= gap else 0
            while fit and rest[fit] == 0:
                k = int(np.searchsorted(there, fit))
                fit = there[k - 1] if k else 0
            if not fit:
                break
            parts.append(int(fit))
            rest[fit] -= 1
            gap -= int(fit)
        times = min(int(left[x]) // n for x, n in Counter(parts).items())
        for x in parts:
            left[x] -= times
        out.append((times, parts))
    return out


def places(patterns: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, how many a sequence, first sequence, offset) in order of length and rank."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for times, parts in patterns:
        offset = 0
        for length, n in Counter(parts).items():
            rows.append((length, used[length], n, sequence, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (row_id, piece, start, length, ids_crc32, ...)."""
    fields = pieces.schema.fields
    kept = [f.name for f in fields]
    buckets = max(64, _common.parallelism(pieces.sparkSession))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("row_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # At most `capacity` rows come to the driver, and the plan made of them is as bounded.
    found = places(plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    begins = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(begins, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before")).drop("bucket", "before")
    keys = (found[:, 0] << 44) + found[:, 1]

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            own = found[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            nth = rank - own[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(own[:, 3] + nth // own[:, 2]), pa.array(own[:, 4] + nth % own[:, 2] * length)], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return ranked.mapInArrow(seat, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, source: str, end_id: int = 0, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack."""
    return pack(_common.stash(cut(docs, source, end_id, capacity, doc_id, text, keep_ids), "pieces"), capacity)
