"""SimHash near-duplicates: fingerprints linked through vantage-point trees, shard by shard.

`fingerprints` gives every whole text 64 bits from its word shingles. `link` finds the components of
fingerprints that differ in at most `radius` bits, all exactly:

* Fingerprints are partitioned by their Hamming distances to vantage points. Few of them are one shard. Many are
  seen through masks: of `radius + keep` blocks of bits, two linked fingerprints agree on `keep` whole blocks, so
  through one of the masks both have the same distance to any vantage point, and the shells of equal distances to a few vantage
  points are shards whose boundary strips have no width. (On all 64 bits, distances of unrelated texts
  crowd around 32 with a deviation of 4, and strips of 4 bits on either side hold most of them.) The number of vantage points, and
  then `keep`, grow with the number of fingerprints, so that a shard holds about `SHARD_ROWS`; every choice finds all pairs.
* Within a shard a vantage-point tree on all 64 bits splits by the median distance to a vantage point;
  pairs across the split are sought only in the strips that the triangle bound leaves.
* A shard of more than `SHARD_ROWS` is partitioned further by the distance on all bits to one more vantage point, in cells
  of `radius + 1` bits: linked fingerprints lie in one cell or in neighbouring ones, so each cell is
  queried with itself and, as far as its rows lie within the radius of the edge, with the next. A cell that is still too large is cut
  into parts, each two of which are a query of their own, so a third of all rows in one cell is many tasks. Tasks give the links of a
  spanning forest, not all pairs.

Equal fingerprints are one node, so copies are never compared.

`similar` is for a similarity that few bits don't reach (at a Jaccard similarity of 0.8, fingerprints
differ in about 10 of 64): texts that `link` joins, or that agree in one of `VIEWS` bands of `BAND` minima of their
shingles, are candidates, and every link between candidates is confirmed by the exact Jaccard
similarity of their shingles. Two texts at 0.8 share no band with a probability of 0.001; all else is exact.

Defined results: a null text is empty; a text without words has fingerprint zero and links like any
other; fewer words than a shingle's make one shingle of all. A row with a null id has its
fingerprint and the smallest id of its component (null if none has one). Repeated rows each get the
same result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm import _common, _graph

#: Rows that a shard holds as a rule, and beyond which it is partitioned further.
SHARD_ROWS = 2048
#: A tree's node of at most so many rows is a leaf.
LEAF_ROWS = 64
SEED = 42
#: Bands of minima that make texts candidates, and minima of each.
VIEWS, BAND = 24, 6
#: Texts of a group of candidates, beyond which it is cut into parts, each two of which are compared.
PART_TEXTS = 512

#: Vantage points of the shards, and the one of the cells.
_VANTAGE = [int(v) for v in np.random.default_rng(SEED + 2).integers(-(1 << 63), 1 << 63, 9)]
_FACTORS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, VIEWS * BAND, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = np.random.default_rng(SEED + 1).integers(0, 1 << 63, VIEWS * BAND, np.uint64)


def shingles(text: str | None, words_each: int) -> np.ndarray:
    """A hash for each run of `words_each` words; of none for a text without words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z and the six white characters of ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    joined, sizes = b" ".join(words), [len(w) + 1 for w in words]
    ends = list(accumulate(sizes))
    starts = [0, *ends[:-1]]
    k = min(words_each, len(words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :], strict=False)), np.uint64, len(words) - k + 1)


def fingerprint(text: str | None, words_each: int = 4) -> int:
    return _print(shingles(text, words_each))


def _print(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        block = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_each: int = 4) -> DataFrame:
    """(row_id, fp): the fingerprint's 64 bits as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches, "text"):
            fps = np.array([fingerprint(t, words_each) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(fps)], names=["row_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("row_id"), F.col(text).cast("string").alias("text")).mapInArrow(of, "row_id long, fp long")


def projections(n: int, radius: int) -> list[int]:
    """Masks of which any two fingerprints within the radius agree on at least one; of few fingerprints, the one that hides all bits."""
    if n <= SHARD_ROWS:
        return [0]
    for keep in range(1, 65 - radius):
        blocks = radius + keep
        if n >> (64 * keep // blocks) <= SHARD_ROWS or keep == 4:
            break
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [reduce(int.__or__, x) for x in combinations(masks, keep)]


def vantage_points(n: int, bits: int) -> int:
    """How many vantage points make shards of about `SHARD_ROWS`, by the chance that two random rows have equal distances to one."""
    equal = math.comb(2 * bits, bits) / 4**bits
    return next((k for k in range(len(_VANTAGE) - 1) if n * equal**k <= SHARD_ROWS), len(_VANTAGE) - 1)


def _far(point: int, mask: int = -1) -> Column:
    """Hamming distance of fp to a vantage point, through a mask."""
    return F.bit_count(F.col("fp").bitwiseXOR(F.lit(point)).bitwiseAND(F.lit(mask))).cast("long")


def link(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(node, component) of the distinct fingerprints of `fps` (fp long) that links join to a smaller one."""
    n = fps.count()
    views = []
    for k, m in enumerate(projections(n, radius)):
        shell = reduce(lambda x, v, m=m: x * 65 + _far(v, m - (1 << 64) if m >> 63 else m), _VANTAGE[: vantage_points(n, m.bit_count())], F.lit(0).cast("long"))
        views.append(F.struct(F.lit(k).alias("view"), shell.alias("shell")))
    rows = fps.select("fp", F.explode(F.array(*views)).alias("x")).select("x.view", "x.shell", "fp")
    width = radius + 1
    rows = rows.withColumn("far", _far(_VANTAGE[-1])).withColumn("cell", F.floor(F.col("far") / width))
    cells = rows.groupBy("view", "shell", "cell").count()
    large = cells.groupBy("view", "shell").agg(F.sum("count").alias("n"), F.ceil(F.max("count") / SHARD_ROWS).alias("parts")).where(F.col("n") > SHARD_ROWS).drop("n")
    rows = rows.join(large, ["view", "shell"], "left")
    # The cells that a row meets: its own, and a neighbour if it lies within the radius of it.
    low, high = F.col("cell") - (F.col("far") % width < radius).cast("int"), F.col("cell") + (F.col("far") % width > 0).cast("int")
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))
    rows = rows.withColumn("own", F.coalesce(F.col("cell") * F.col("parts") + part, F.lit(0)))
    others = F.when(F.col("parts").isNull(), F.sequence(F.lit(0).cast("long"), F.lit(0).cast("long"))).otherwise(F.sequence(F.greatest(F.lit(0), low * F.col("parts")), (high + 1) * F.col("parts") - 1))
    rows = rows.withColumn("other", F.explode(others))
    rows = rows.select("view", "shell", F.least("own", "other").cast("int").alias("a"), F.greatest("own", "other").cast("int").alias("b"), (F.col("own") > F.col("other")).alias("second"), "fp")
    keys = ["view", "shell", "a", "b"]
    dealt = rows.repartition(_common.partitions(fps.sparkSession, 100 * len(views) * n), *keys).sortWithinPartitions(*keys)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = forest(x, radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            x = np.empty(batch.num_rows, _ROW)
            for k in (*keys, "second", "fp"):
                x[k] = batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) if k == "fp" else batch.column(k).to_numpy(zero_copy_only=False)
            held.append(x)
            if sum(map(len, held)) >= 1 << 16:
                whole = np.concatenate(held)
                last = np.flatnonzero(np.logical_and.reduce([whole[k] == whole[k][-1] for k in keys]))[0]
                yield from out(whole[:last])
                held = [whole[last:]]
        if held:
            yield from out(np.concatenate(held))

    return _graph.components(dealt.mapInArrow(pairs, "a long, b long"))


_ROW = np.dtype([("view", np.int32), ("shell", np.int64), ("a", np.int32), ("b", np.int32), ("second", bool), ("fp", np.uint64)])


def forest(rows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over the pairs found within sorted shards."""
    if not len(rows):
        return (np.zeros(0, np.uint64),) * 2
    fresh = np.ones(len(rows), bool)
    fresh[1:] = np.logical_or.reduce([rows[k][1:] != rows[k][:-1] for k in ("view", "shell", "a", "b")])
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, len(rows)))
    group = np.repeat(np.arange(len(starts)), sizes)
    fp, found = rows["fp"], []
    # A shard cut in parts holds whole parts against each other; any other one is compared with itself.
    cross = rows["a"][starts] != rows["b"][starts]
    small = ~cross & (sizes <= LEAF_ROWS)
    in_small = np.repeat(small, sizes)
    at = np.flatnonzero(in_small)
    for step in range(1, int(sizes[small].max(initial=1))):
        left = at[: len(at) - step] if step < len(at) else at[:0]
        right = at[step:]
        same = group[left] == group[right]
        left, right = left[same], right[same]
        near = np.bitwise_count(fp[left] ^ fp[right]) <= radius
        found.append((left[near], right[near]))
    for k in np.flatnonzero(~small):
        own = np.arange(starts[k], starts[k] + sizes[k])
        second = rows["second"][own]
        pairs = _cross(fp, own[~second], own[second], radius) if cross[k] else _within(fp, own, radius)
        if pairs:  # a dense shard has far more pairs than the links that join them
            a, b = (np.concatenate(x) - starts[k] for x in zip(*pairs, strict=True))
            a, b = _graph.spanning(len(own), a, b)
            found.append((own[a], own[b]))
    if not found:
        return (np.zeros(0, np.uint64),) * 2
    names, index = np.unique(fp, return_inverse=True)
    a, b = (index[np.concatenate(x)] for x in zip(*found, strict=True))
    joined, roots = _graph.spanning(len(names), a, b)
    return names[joined], names[roots]


def _outright(fp: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for at in range(0, len(a), 1024):
        i, j = np.nonzero(np.bitwise_count(fp[a[at : at + 1024], None] ^ fp[None, b]) <= radius)
        out.append((a[at + i], b[j]))
    return out


def _within(fp: np.ndarray, own: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the radius among `own`: a vantage-point tree, built and queried in one descent."""
    if len(own) <= LEAF_ROWS:
        return _outright(fp, own, own, radius)
    far = np.bitwise_count(fp[own] ^ fp[own[0]]).astype(np.int16)
    middle = int(np.median(far))
    inner = far <= middle
    if inner.all():
        middle -= 1
        inner = far <= middle
        if not inner.any():
            return _outright(fp, own, own, radius)
    return [*_within(fp, own[inner], radius), *_within(fp, own[~inner], radius), *_cross(fp, own[inner & (far > middle - radius)], own[~inner & (far <= middle + radius)], radius)]


def _cross(fp: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the radius between a and b."""
    if not len(a) or not len(b):
        return []
    if len(a) * len(b) <= 1 << 16:
        return _outright(fp, a, b, radius)
    far_a, far_b = (np.bitwise_count(fp[x] ^ fp[a[0]]).astype(np.int16) for x in (a, b))
    middle = int(np.median(np.concatenate((far_a, far_b))))
    in_a, in_b = far_a <= middle, far_b <= middle
    near_a, near_b = np.abs(far_a - middle - 0.5) < radius, np.abs(far_b - middle - 0.5) < radius
    parts = [(a[in_a], b[in_b]), (a[~in_a], b[~in_b]), (a[in_a & near_a], b[~in_b & near_b]), (a[~in_a & near_a], b[in_b & near_b])]
    if sum(len(x) * len(y) for x, y in parts) > 0.8 * len(a) * len(b):
        return _outright(fp, a, b, radius)
    return [pair for x, y in parts for pair in _cross(fp, x, y, radius)]


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_each: int = 4, radius: int = 4) -> DataFrame:
    """(row_id, fp, component) of every row."""
    prints = _common.stash(fingerprints(docs, doc_id, text, words_each), "prints")
    nodes = prints.groupBy("fp").agg(F.min("row_id").alias("least"))
    joined = link(nodes.select("fp"), radius)
    # Only fingerprints that link to others meet here; the smallest of a component stands for itself.
    members = joined.union(joined.select(F.col("component").alias("node"), "component").distinct())
    named = members.join(nodes, F.col("node") == F.col("fp"))
    roots = named.groupBy("component").agg(F.min("least").alias("smallest"))
    linked = members.join(roots, "component").select("node", "smallest")
    labelled = nodes.join(linked, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("own"), F.coalesce(F.when(F.col("node").isNotNull(), F.col("smallest")), F.col("least")).alias("component"))
    labelled = _common.stash(labelled, "labelled")  # a plain shuffle on either side, so that one text's many copies are split
    return prints.join(labelled, F.col("fp") == F.col("own")).select("row_id", "fp", "component")


def bands(hashes: np.ndarray) -> np.ndarray:
    """A number for each view, equal where the minima of its band are."""
    least = np.full(VIEWS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[None, at : at + 512] * _FACTORS[:, None] + _SHIFTS[:, None]).min(axis=1), out=least)
    mixed = _common.mix64(least).reshape(VIEWS, BAND) * _FACTORS[:BAND]
    return _common.mix64(mixed.sum(axis=1, dtype=np.uint64) + _SHIFTS[:VIEWS])


def alike(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join what pairs of that exact Jaccard similarity join; each set sorted, without repeats.

    With all sets ordered alike, rarest elements first, two such sets share an element in their first
    len - ceil(similarity * len) + 1 ones; so only sets that do are compared, and what many texts have in common makes no pairs.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    _, element, counts = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((element, counts[element], owner))
    heads = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    head = (np.arange(len(flat)) - starts[owner] < heads[owner]) & (counts[element[order]] > 1)
    element, owner = element[order][head], owner[head]
    bounds = np.searchsorted(owner, np.arange(len(sets) + 1))
    holders = owner[np.argsort(element, kind="stable")]
    of = np.cumsum(np.bincount(element, minlength=len(counts)))
    label, found = np.arange(len(sets)), []
    for i, own in enumerate(sets):
        # Pairs that other links join already needn't be compared, so that a dense group is one pass.
        if (label[i + 1 :] == label[i]).all():
            continue
        if len(own):
            mine = element[bounds[i] : bounds[i + 1]]
            before = np.where(mine > 0, of[mine - 1], 0)
            rest = np.unique(holders[_common.ragged(before, of[mine] - before)])
        else:
            rest = np.arange(len(sets))
        rest = rest[(rest > i) & (label[rest] != label[i])]
        rest = rest[np.minimum(sizes[rest], len(own)) >= similarity * np.maximum(sizes[rest], len(own)) - 1e-9]
        if not len(rest):
            continue
        if len(own):
            theirs = flat[_common.ragged(starts[rest], sizes[rest])]
            hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes[rest]) - sizes[rest])
            rest = rest[both >= similarity * (len(own) + sizes[rest] - both) - 1e-9]
        found += [(i, int(j)) for j in rest]
        label[np.isin(label, label[rest])] = label[i]
    return found


def confirmed(texts: DataFrame, words_each: int, similarity: float) -> DataFrame:
    """Links (a, b) between the texts (node, component, text) of each group of candidates."""
    large = texts.groupBy("component").count().where(F.col("count") > PART_TEXTS).select("component", F.ceil(F.col("count") / PART_TEXTS).cast("int").alias("parts"))
    rows = texts.join(large, "component", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.where("parts = 1 or own <> other").select("component", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "text")
    keys = ["component", "a", "b"]
    dealt = rows.repartition(_common.parallelism(texts.sparkSession), *keys).sortWithinPartitions(*keys)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: tuple | None = None
        nodes: list[int] = []
        sets: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            found = alike(sets, similarity) if len(sets) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[x[k]] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for part in _common.slices([batch], "text"):
                for component, a, b, node, text in zip(*(part.column(k).to_pylist() for k in (*keys, "node", "text")), strict=True):
                    if shard != (component, a, b):
                        yield from out()
                        shard, nodes, sets = (component, a, b), [], []
                    nodes.append(node)
                    sets.append(np.unique(shingles(text, words_each)))
        yield from out()

    return dealt.mapInArrow(pairs, "a long, b long")


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_each: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """(row_id, component) of every row with an id; texts without words are alike."""
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("row_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches, "text"):
            fps, views = [], []
            for t in batch.column("text").to_pylist():
                hashes = shingles(t, words_each)
                fps.append(_print(hashes))
                views.append(bands(hashes))
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * VIEWS), pa.array(np.concatenate(views).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("node"), pa.array(np.array(fps, np.uint64).view(np.int64)), each], names=["row_id", "node", "fp", "views"])

    prints = _common.stash(rows.mapInArrow(of, "row_id long, node long, fp long, views array<long>"), "prints")
    nodes = _common.stash(prints.groupBy("node").agg(F.min("row_id").alias("least"), F.first("fp").alias("fp"), F.first("views").alias("views")), "nodes")
    # Candidates: each text with the first one of its band, of its fingerprint, and of those that link to it.
    seen = nodes.select("node", F.explode("views").alias("view"))
    first = seen.groupBy("view").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("view", "b")
    edges = seen.join(first, "view").select(F.col("node").alias("a"), "b")
    by_print = _common.stash(nodes.groupBy("fp").agg(F.min("node").alias("b")), "first")
    edges = edges.union(nodes.join(by_print, "fp").select(F.col("node").alias("a"), "b"))
    joined = link(by_print.select("fp"), radius).select(F.col("node").alias("fp"), "component")
    roots = by_print.select(F.col("fp").alias("component"), F.col("b").alias("a"))
    edges = edges.union(joined.join(by_print, "fp").join(roots, "component").select("a", "b"))
    groups = _members(_graph.components(edges))
    texts = _common.stash(rows.select("node", "text").join(groups, "node").groupBy("node", "component").agg(F.first("text").alias("text")), "candidates")
    members = _members(_graph.components(confirmed(texts, words_each, similarity)))
    named = members.join(nodes.select("node", "least"), "node")
    smallest = named.groupBy("component").agg(F.min("least").alias("smallest"))
    linked = members.join(smallest, "component").select(F.col("node").alias("k"), "smallest")
    labelled = nodes.join(linked, F.col("node") == F.col("k"), "left").select(F.col("node").alias("own"), F.coalesce("smallest", "least").alias("component"))
    labelled = _common.stash(labelled, "labelled")
    return prints.select("row_id", "node").join(labelled, F.col("node") == F.col("own")).select("row_id", "component")


def _members(joined: DataFrame) -> DataFrame:
    """(node, component) with each component's smallest node too."""
    return joined.union(joined.select(F.col("component").alias("node"), "component").distinct())


def hexed(fp: str = "fp") -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
