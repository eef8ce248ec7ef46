"""Embedding near-duplicates by sorted projection passes.

In each pass random hyperplanes give every vector a string of bits, and all vectors are put in the
lexicographic order of (pass, label, string) by one range-partitioned sort. A row's place in that
order is its rank, counted over all partitions, so windows cross their edges. Every vector is compared
with its `WINDOW_ROWS` - 1 neighbours on either side. Where more than `WINDOW_ROWS` neighbours agree on the
first `bits` bits (a run: many vectors lie close together), a window alone would lose pairs; such a run is
compared as a whole, in blocks of `PART_ROWS` ranks, each two blocks in a task of their own.

The bits grow with the largest label, so that a run of unrelated vectors is about a window. The number of passes
follows from the bits: it is the least for which a pair at the threshold shares a run, and
with it a window or a block, at least once with probability `RECALL`; closer pairs do so more surely.

Windows are first compared by signatures of `SIGNATURE_BITS` hyperplanes, so the sorts carry no vectors. Only
rows with a neighbour whose signature could be that of a link fetch their vectors, for the passes where that
is so; the cosine of every link is verified in double precision. The signatures' limit lies
`DEVIATIONS` standard deviations above what a pair at the threshold differs in.

A row with its vector carries its ranks and runs of all passes. So a pair that meets again is known from its two
rows, and it is counted in the first pass only: tasks give sums of links for each vector and a
spanning forest, never the pairs. Vectors equal to the last bit within a label are one row with a weight.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, one without
a label and one without an id link with nothing and are their own component. Vectors of different
lengths don't link. Ids are unique but for repeated rows, which count as other vectors of their own.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm import _common, _graph, _vectors

WINDOW_ROWS = 32
PART_ROWS = 1024
RECALL = 0.9995
#: Bits of a pass's string.
STRING_BITS = 30
SIGNATURE_BITS = 256
DEVIATIONS = 7
SEED = 7


def passes(largest: int, threshold: float) -> tuple[int, int]:
    """Bits that a run shares and the number of passes, for the size of the largest label."""
    bits = min(STRING_BITS, max(0, math.ceil(math.log2(max(1, largest / WINDOW_ROWS)))))
    alike = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - alike))) if alike < 1 else 1


def limit(threshold: float) -> int:
    """Most bits in which the signatures of a link differ."""
    p = math.acos(threshold) / math.pi
    return math.ceil(SIGNATURE_BITS * p + DEVIATIONS * math.sqrt(SIGNATURE_BITS * p * (1 - p)))


def hashes(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of the rows of x, as 64-bit words, and their bit strings in n passes."""
    width = x.shape[1]
    planes = np.random.default_rng(SEED + width).standard_normal((SIGNATURE_BITS + n * STRING_BITS, width)).T
    signs = x @ planes > 0
    own = np.packbits(signs[:, :SIGNATURE_BITS], axis=1).view(np.uint64)
    return own, signs[:, SIGNATURE_BITS:].reshape(len(x), n, STRING_BITS) @ (1 << np.arange(STRING_BITS - 1, -1, -1, dtype=np.int64))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(row_id, n_links, component) of every row."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("row_id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("vector"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [None if x is None else x.tobytes() for x in _vectors.doubles(batch.column("vector"))]
            # -0.0 equals 0.0
            digests = [None if x is None else hashlib.blake2b((np.frombuffer(x) + 0.0).tobytes(), digest_size=16).digest() for x in packed]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("label"), pa.array(packed, pa.binary()), pa.array(digests, pa.binary())], names=["row_id", "label", "vector", "digest"])

    read_rows = _common.stash(rows.mapInArrow(read, "row_id long, label string, vector binary, digest binary"), "vectors")
    taking = read_rows.where("row_id is not null and label is not null and digest is not null")
    classes = taking.groupBy("label", "digest").agg(F.min("row_id").alias("node"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector"), F.first(F.octet_length("vector")).alias("bytes"))
    classes = _common.stash(classes.withColumn("uid", F.monotonically_increasing_id()), "classes")
    sizes = classes.groupBy("label", "bytes").count().agg(F.max("count").alias("n"), F.sum("count").alias("total")).head()
    bits, n = passes(sizes.n or 0, threshold)
    ranked = in_order(classes, bits, n, sizes.total or 0)
    met = _common.stash(neighbours(ranked, sizes.total or 0, n, threshold), "met")
    found = _common.stash(verified(classes, ranked, met, threshold), "found")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    joined = _graph.components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "member")
    of_class = classes.select("label", "digest", "node", "weight").join(links, "node", "left").join(joined, F.col("node") == F.col("member"), "left")
    of_class = of_class.select(F.col("label").alias("l"), F.col("digest").alias("d"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    out = read_rows.select("row_id", "label", "digest").join(of_class, (F.col("label") == F.col("l")) & (F.col("digest") == F.col("d")) & F.col("row_id").isNotNull(), "left")
    return out.select("row_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "row_id").alias("component"))


def in_order(classes: DataFrame, bits: int, n: int, total: int) -> DataFrame:
    """(turn, uid, group, signature, rank, run, back, far) of each class in each pass.

    rank: its place in the order of (turn, label, length, string); group: a hash of the first three;
    run: the first rank of its run if that is wider than a window, else -1; back, far: the ranks that it meets.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                lengths = batch.column("bytes").to_numpy()
                for length in np.unique(lengths):
                    own = batch.filter(pa.array(lengths == length))
                    signatures, strings = hashes(_vectors.stacked(own.column("vector"), length // 8), n)
                    each = pa.ListArray.from_arrays(pa.array(np.arange(len(strings) + 1, dtype=np.int32) * n), pa.array(strings.ravel()))
                    yield pa.RecordBatch.from_arrays([own.column("uid"), own.column("label"), own.column("bytes"), pa.array([x.tobytes() for x in signatures], pa.binary()), each], names=["uid", "label", "bytes", "signature", "strings"])

    spark = classes.sparkSession
    hashed = classes.select("uid", "label", "bytes", "vector").mapInArrow(of, "uid long, label string, bytes int, signature binary, strings array<long>")
    thin = hashed.select("uid", "label", "bytes", "signature", F.posexplode("strings").alias("turn", "string"))
    order = ["turn", "label", "bytes", "string", "uid"]
    dealt = thin.repartitionByRange(_common.partitions(spark, 80 * total * n), *order).sortWithinPartitions(*order)
    placed = _common.stash(dealt.withColumn("at", F.monotonically_increasing_id()), "order")
    # A row for each partition of the sort; its rows' places are counted from where the last one's end.
    counts = placed.groupBy(F.shiftright("at", 33).alias("part")).count().orderBy("part").collect()
    starts = spark.createDataFrame([(int(r.part), int(s)) for r, s in zip(counts, np.cumsum([0, *(r["count"] for r in counts)]), strict=False)], "part long, start long")
    ranked = placed.join(F.broadcast(starts), F.shiftright("at", 33) == F.col("part")).withColumn("rank", F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1))
    ranked = ranked.withColumn("prefix", F.shiftright("string", STRING_BITS - bits)).select("turn", "label", "bytes", "prefix", "uid", "signature", "rank")
    keys = ["turn", "label", "bytes", "prefix"]
    wide = ranked.groupBy(*keys).agg(F.min("rank").alias("run"), F.max("rank").alias("end")).where(F.col("end") - F.col("run") >= WINDOW_ROWS)
    ranked = ranked.join(wide, keys, "left").withColumn("run", F.coalesce("run", F.lit(-1)))
    back, far = F.col("rank") - WINDOW_ROWS + 1, F.col("rank") + WINDOW_ROWS - 1
    back = F.greatest(F.lit(0), F.when(F.col("run") >= 0, F.least(back, "run")).otherwise(back))
    far = F.when(F.col("run") >= 0, F.greatest(far, "end")).otherwise(far)
    return _common.stash(ranked.select("turn", "uid", F.xxhash64("turn", "label", "bytes").alias("group"), "signature", "rank", "run", back.alias("back"), far.alias("far")), "ranked")


def in_blocks(rows: DataFrame, parts: int, *columns: Column | str) -> DataFrame:
    """Rows sent to each pair (a, b) of blocks of ranks in which they meet others; second: on the side of b."""
    block = lambda x: F.floor(F.col(x) / PART_ROWS)
    rows = rows.withColumn("own", block("rank")).withColumn("other", F.explode(F.sequence(block("back"), block("far"))))
    rows = rows.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).alias("second"), "rank", *columns)
    return rows.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "rank")


def neighbours(ranked: DataFrame, total: int, n: int, threshold: float) -> DataFrame:
    """(uid, turn) of the rows with a neighbour whose signature is that of a possible link."""
    most, window = limit(threshold), WINDOW_ROWS

    def of(t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        uid, turn, group, rank, run = (t.column(c).to_numpy() for c in ("uid", "turn", "group", "rank", "run"))
        signature = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint64).reshape(len(uid), -1)
        hit = np.zeros(len(uid), bool)
        for i, j in _meeting(t, rank, run, window):
            near = (group[i] == group[j]) & (_apart(signature, i, j) <= most)
            hit[i[near]] = hit[j[near]] = True
        if hit.any():
            yield pa.RecordBatch.from_arrays([pa.array(uid[hit]), pa.array(turn[hit])], names=["uid", "turn"])

    dealt = in_blocks(ranked, _common.partitions(ranked.sparkSession, 90 * total * n), "uid", "turn", "group", "run", "signature")
    return dealt.mapInArrow(lambda batches: _grouped(batches, of), "uid long, turn int").distinct()


def verified(classes: DataFrame, ranked: DataFrame, met: DataFrame, threshold: float) -> DataFrame:
    """Sums of links (a, null, links) for each class, and links (a, b, null) of a spanning forest."""
    most, window = limit(threshold), WINDOW_ROWS
    turns = _common.stash(met.groupBy("uid").agg(F.collect_set("turn").alias("turns")), "turns")
    bulk = turns.agg(F.sum(F.size("turns")).alias("n"), F.max(F.size("turns")).alias("most")).head()
    places = ranked.join(turns.select("uid"), "uid").groupBy("uid").agg(F.first("signature").alias("signature"), F.array_sort(F.collect_list(F.struct("turn", "rank", "run", "back", "far"))).alias("places"))
    whole = classes.select("uid", "label", "node", "weight", "vector").join(places, "uid").join(turns, "uid")
    # Ranks and runs of the passes before this one go with each row.
    rows = whole.withColumn("turn", F.explode("turns")).withColumn("here", F.col("places")[F.col("turn")]).withColumn("before", F.slice("places", F.lit(1), F.col("turn")))
    rows = rows.select("*", "here.rank", "here.run", "here.back", "here.far").drop("places", "turns", "here")
    size = 600 + 16 * (bulk.most or 0)
    dealt = in_blocks(rows, _common.partitions(classes.sparkSession, size * (bulk.n or 0)), "turn", "run", "label", "signature", F.col("before.rank").alias("ranks"), F.col("before.run").alias("runs"), "node", "weight", "vector")

    def of(t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rank, run, node, weight, turn = (t.column(c).to_numpy() for c in ("rank", "run", "node", "weight", "turn"))
        label = t.column("label").dictionary_encode().indices.to_numpy()
        packed = t.column("vector").to_pylist()
        length = np.fromiter(map(len, packed), np.int64, len(packed))
        signature = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint64).reshape(len(rank), -1)
        first, second = [], []
        # A block may hold several passes, labels and lengths next to each other; they never meet.
        kind = np.unique(np.column_stack((turn, label, length)), axis=0, return_inverse=True)[1].ravel()
        own_rank, own_run = ([np.asarray(x, np.int64) for x in t.column(c).to_pylist()] for c in ("ranks", "runs"))
        for group in np.unique(kind):
            of_group = np.flatnonzero(kind == group)
            x = np.frombuffer(b"".join(packed[k] for k in of_group), np.float64).reshape(len(of_group), -1)
            x = x / np.linalg.norm(x, axis=1)[:, None]
            for i, j in _meeting(t.take(pa.array(of_group)), rank[of_group], run[of_group], window):
                near = _apart(signature[of_group], i, j) <= most
                i, j = i[near], j[near]
                for k in range(0, len(i), 1 << 16):
                    a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    link = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                    first.append(of_group[a[link]])
                    second.append(of_group[b[link]])
        if not first or not sum(map(len, first)):
            return
        i, j = np.concatenate(first), np.concatenate(second)
        fresh = np.ones(len(i), bool)
        for now in np.unique(turn):
            mine = np.flatnonzero(turn[i] == now)
            if not now or not len(mine):
                continue
            some = np.flatnonzero(turn == now)
            back = np.zeros(len(rank), np.int64)
            back[some] = np.arange(len(some))
            ranks, runs = (np.stack([x[k] for k in some]) for x in (own_rank, own_run))
            for k in range(0, len(mine), 1 << 16):
                part = mine[k : k + (1 << 16)]
                a, b = back[i[part]], back[j[part]]
                seen = (np.abs(ranks[a] - ranks[b]) < window) | ((runs[a] == runs[b]) & (runs[a] >= 0))
                fresh[part] = ~seen.any(axis=1)
        links = np.bincount(i[fresh], weight[j[fresh]], len(rank)) + np.bincount(j[fresh], weight[i[fresh]], len(rank))
        some = np.flatnonzero(links)
        a, b = _graph.spanning(len(rank), i, j)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((node[some], node[a]))), pa.array([None] * len(some) + node[b].tolist(), pa.int64()), pa.array([*links[some].astype(np.int64).tolist(), *[None] * len(a)], pa.int64())],
            names=["a", "b", "links"],
        )

    return dealt.mapInArrow(lambda batches: _grouped(batches, of), "a long, b long, links long")


def _grouped(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """What `of` makes of the rows of each pair of blocks."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if sum(x.num_rows for x in held) > 1:
            yield from of(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
        marks = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        for at, to in zip([0, *marks], [*marks, batch.num_rows], strict=True):
            if held and (held[0].column("a")[0].as_py(), held[0].column("b")[0].as_py()) != (a[at], b[at]):
                yield from flush()
                held = []
            held.append(batch.slice(at, to - at))
    yield from flush()


def _meeting(t: pa.RecordBatch, rank: np.ndarray, run: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows, in order of rank, within a window or a run; in a pair of blocks, only across."""
    n, second = len(rank), t.column("second").to_numpy(zero_copy_only=False)
    across = n > 0 and t.column("a")[0].as_py() != t.column("b")[0].as_py()
    for step in range(1, min(window, n)):
        i = np.flatnonzero(rank[step:] - rank[:-step] < window)
        if not len(i):
            break
        if across:
            i = i[~second[i] & second[i + step]]
        yield i, i + step
    for name in np.unique(run[run >= 0]):
        own = np.flatnonzero(run == name)
        left, right = (own[~second[own]], own[second[own]]) if across else (own, own)
        rows = max(1, (1 << 18) // max(1, len(right)))
        for at in range(0, len(left), rows):
            i, j = np.nonzero(rank[right][None, :] - rank[left[at : at + rows]][:, None] >= window)
            yield left[at + i], right[j]


def _apart(signature: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which the signatures of each pair differ."""
    out = np.zeros(len(i), np.int64)
    for word in signature.T:
        out += np.bitwise_count(word[i] ^ word[j])
    return out
