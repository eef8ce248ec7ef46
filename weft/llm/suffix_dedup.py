"""Repeated passages cut by a sparse suffix array.

Words are runs of bytes other than ASCII white space. A suffix is retained where a minimiser stands: of the
`STEP` suffixes that could begin a seed within a passage of `PASSAGE_WORDS` words, the one whose first `SEED_WORDS` words hash lowest.
That choice depends on the passage's words alone, so two equal passages retain the same suffix, and no other
suffixes need a look. Passages that a text itself has at an earlier place are settled within the text, by its words, so a line that a text repeats many times
gives the sort its first places only. Suffixes whose seed's hash no other text has have no neighbour to match and are left out. The others are sorted by their
first `PASSAGE_WORDS` words, by a range partitioning on the first bytes with the place as last key, so that even a passage that a third of all texts share is
dealt to many tasks. In that order neighbours are compared word by word: the words that they have in
common to the right, and the ones before them, extend the match in both directions, and it is a passage where both ways together have
`PASSAGE_WORDS`. Matches that reach the edge of a partition are settled between partitions, one row a passage and partition, by the
128-bit digest of their words. Of equal passages the first stays, by (smallest id of the text, text, place), and
every word that lies in a later one is cut.

Equal whole texts (by SHA-256) of `PASSAGE_WORDS` words or more are one text; that of the smallest id stays, the others
are emptied. Minima and counts are combined before their shuffle, and all joins are plain ones
whose large partitions Spark splits, so a passage in a third of all rows is no single task.

Defined results: a null text stays null; texts without a repeated passage stay as they are, character for
character; texts shorter than a passage always do. Repeated rows (same id, same text) are one document
and get equal results; a row with a null id comes after all others. Other columns pass through, but for one named
`spans`, which the result's replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm import _common

PASSAGE_WORDS = 50
SEED_WORDS = 25
#: Seeds of a passage.
STEP = PASSAGE_WORDS - SEED_WORDS + 1

#: Sorted suffixes that a task looks at together, and more where a run of equal prefixes is longer.
BLOCK_ROWS = 1 << 13

#: Bytes by which suffixes are dealt to partitions. The words of a seed and the blanks between them are more, so equal seeds agree on them.
PREFIX_BYTES = 2 * SEED_WORDS - 2

_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MARK = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, 1 << 16), base, np.uint64)
        found[0] = 1
        found = np.cumprod(found)
        if n <= 1 << 22:  # longer ones are not kept
            _powers[base] = found
    return found[:n]


def _rolling(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the stretches of x, equal for equal stretches wherever they stand."""
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * _power(base, len(x)), out=sums[1:])
    back = _power(pow(base, -1, 1 << 64), len(x))
    return _common.mix64((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes of text."""
    blank = np.empty(len(data) + 2, bool)
    blank[0] = blank[-1] = True
    blank[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return edge[::2], edge[1::2]


def minimisers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Each passage's seed: its hash and its place in words. None for a text too short."""
    if len(data) < 2 * PASSAGE_WORDS - 1:
        return None
    starts, ends = words(data)
    n = len(starts)
    if n < PASSAGE_WORDS:
        return None
    at = np.arange(n - SEED_WORDS + 1)
    seeds = _rolling(_rolling(_MARK[data], starts, ends, _P), at, at + SEED_WORDS, _Q)
    least = np.lib.stride_tricks.sliding_window_view(seeds, STEP).argmin(axis=1) + np.arange(n - PASSAGE_WORDS + 1)
    return seeds[least], least


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def _long(text: Column) -> Column:
    """A text that is long enough for a passage; words have a byte and a blank between them."""
    return F.octet_length(text) >= 2 * PASSAGE_WORDS - 1


def _suffixes(docs: DataFrame) -> DataFrame:
    """(seed, k, twice) of every retained suffix: its first words' hash, its text, and if the text has it at two places."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches, "text"):
            found: list[np.ndarray] = []
            twice: list[np.ndarray] = []
            keys: list[np.ndarray] = []
            for k, text in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist(), strict=True):
                p = minimisers(_bytes(text))
                if p is None:
                    continue
                _, first = np.unique(p[1], return_index=True)
                seeds, times = np.unique(p[0][first], return_counts=True)
                found.append(seeds)
                twice.append(times > 1)
                keys.append(np.full(len(seeds), k, np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(twice))], names=["seed", "k", "twice"])

    return docs.where(_long(F.col("text"))).select("k", "text").mapInArrow(of, "seed long, k long, twice boolean")


def _paired(names: np.ndarray, by: int) -> np.ndarray:
    """Numbers of the pairs of each name and the one `by` places on, equal for equal pairs."""
    return np.unique(names[: len(names) - by] * (int(names.max()) + 1) + names[by:], return_inverse=True)[1].ravel()


def _again(body: list[bytes]) -> np.ndarray:
    """Of each passage of a text, whether the text has the same words at an earlier place."""
    numbers: dict[bytes, int] = {}
    names, size = np.array([numbers.setdefault(w, len(numbers)) for w in body], np.int64), 1
    while 2 * size <= PASSAGE_WORDS:
        names, size = _paired(names, size), 2 * size
    names = _paired(names, PASSAGE_WORDS - size)  # two stretches that overlap
    again = np.ones(len(names), bool)
    again[np.unique(names, return_index=True)[1]] = False
    return again


def _covered(edge: np.ndarray) -> np.ndarray:
    """Begins and ends of what stretches cover, by how many more of them begin than end at each word and after the last."""
    gone = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
    return np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)


def _contexts(texts: DataFrame) -> DataFrame:
    """Retained suffixes with a shared seed: their words, those before them, and how many words before them a passage may begin.

    Suffixes all of whose passages the text has before are left out. Rows without words are what a text repeats of itself: so many words from a place on.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches, "text"):
            right, left, owners, places, low, high = [], [], [], [], [], []
            selves, begun, lengths = [], [], []
            for row, (text, seeds) in enumerate(zip(batch.column("text").to_pylist(), batch.column("seeds"), strict=True)):
                raw = text.encode()
                p = minimisers(np.frombuffer(raw, np.uint8))
                if p is None:
                    continue
                at, first, times = np.unique(p[1], return_index=True, return_counts=True)
                some = np.isin(p[0][first], seeds.values.to_numpy().view(np.uint64))
                twice = len(np.unique(p[0][first])) < len(first)
                if not twice and not some.any():
                    continue
                body = raw.split()
                if twice:
                    again = _again(body)
                    some &= ~np.logical_and.reduceat(again, first)  # a suffix's passages follow one another
                    edge = np.zeros(len(body) + 1, np.int64)
                    edge[: len(again)] += again
                    edge[PASSAGE_WORDS:] -= again
                    for a, b in _covered(edge).tolist():
                        selves.append(row)
                        begun.append(a)
                        lengths.append(b - a)
                some = np.flatnonzero(some)
                plain = b" ".join(body)
                ends = np.cumsum([len(w) + 1 for w in body])
                begins = np.concatenate(([0], ends[:-1]))
                for place, since, n in zip(at[some].tolist(), first[some].tolist(), times[some].tolist()):
                    right.append(plain[begins[place] : ends[min(len(body), place + PASSAGE_WORDS) - 1] - 1])
                    left.append(plain[begins[max(0, place - STEP + 1)] : begins[place]])
                    owners.append(row)
                    places.append(place)
                    low.append(place - since - n + 1)
                    high.append(place - since)
            if owners or selves:
                index = pa.array(owners + selves, pa.int64())
                own = [batch.column(c).take(index) for c in ("t", "id", "k")]
                none = [None] * len(selves)
                numbers = (places + begun, low + none, high + none, [None] * len(owners) + lengths)
                yield pa.RecordBatch.from_arrays([pa.array(right + none, pa.binary()), pa.array(left + none, pa.binary()), *own, *(pa.array(x, pa.int32()) for x in numbers)], names=["right", "left", "t", "id", "k", "place", "low", "high", "words"])

    return texts.mapInArrow(of, "right binary, left binary, t long, id long, k long, place int, low int, high int, words int")


def _codes(column: pa.Array, width: int, backwards: bool) -> tuple[np.ndarray, int]:
    """A row of word numbers for each run of words, the nearest first, -1 where there are no more; and how many words there are."""
    split = pc.split_pattern(column.cast(pa.large_binary()), b" ") if not backwards else pc.split_pattern(pc.binary_slice(column, 0, -1).cast(pa.large_binary()), b" ")
    found = split.flatten().dictionary_encode()
    offsets = split.offsets.to_numpy()
    sizes = np.where(pc.binary_length(column).to_numpy(zero_copy_only=False) > 0, np.diff(offsets), 0)
    out = np.full((len(column), width), -1, np.int32)
    rows, at = np.repeat(np.arange(len(column)), sizes), _common.ragged(np.zeros(len(sizes), np.int64), sizes)
    out[rows, np.repeat(sizes, sizes) - 1 - at if backwards else at] = found.indices.to_numpy(zero_copy_only=False)[_common.ragged(offsets[:-1], sizes)]
    return out, len(found.dictionary)


def _shared(right: np.ndarray) -> np.ndarray:
    """How many first words each row has in common with the next."""
    same = right[1:] == right[:-1]
    return np.where(same.all(axis=1), right.shape[1], same.argmin(axis=1))


def _matches(t: pa.RecordBatch, opens: int, closes: int) -> tuple[np.ndarray, list[tuple[bytes, int, int]]]:
    """Of sorted suffixes, a mask of the passages around each that an earlier place has, and open ones (digest, row, words before).

    Bit x of a mask: the passage that begins x words before the suffix.
    Rows before `opens` and from `closes` on may go on in other partitions, so their first places are open.
    """
    common = _shared(_codes(t.column("right"), PASSAGE_WORDS, False)[0])
    left, n_words = _codes(t.column("left"), STEP - 1, True)
    id_, k, place, low, high = (t.column(c) for c in ("id", "k", "place", "low", "high"))
    low, high, keys = low.to_numpy(), high.to_numpy(), [id_.is_null().to_numpy(zero_copy_only=False), pc.fill_null(id_, 0).to_numpy(), k.to_numpy(), place.to_numpy()]
    order = np.lexsort(keys[::-1])
    # Repeated rows are one text, so their places are equal.
    rank = np.zeros(len(order), np.int64)
    rank[order[1:]] = np.cumsum(np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in keys]))
    mask, ends = np.zeros(len(rank), np.int32), []
    edge = np.ones(len(rank), bool)
    edge[opens:closes] = False
    before = np.zeros(len(rank), np.int64)
    for x in range(STEP):
        if x:  # equal in one word more to the left
            before = np.unique(before * (n_words + 1) + left[:, x - 1] + 1, return_inverse=True)[1].ravel()
        rows = np.flatnonzero((low <= x) & (x <= high))
        if not len(rows):
            continue
        segment = np.concatenate(([0], np.cumsum(common < PASSAGE_WORDS - x)))
        name = (segment * (int(before.max()) + 1) + before)[rows]
        by = np.lexsort((rank[rows], name))
        fresh = np.ones(len(by), bool)
        fresh[1:] = name[by][1:] != name[by][:-1]
        first = rows[by[fresh]]
        own = rows[by]
        mask[own[rank[own] > rank[np.repeat(first, np.diff(np.append(np.flatnonzero(fresh), len(by))))]]] |= 1 << x
        for row in first[edge[first]].tolist():
            after, ahead = (t.column(c)[row].as_py().split() for c in ("right", "left"))
            whole = b" ".join([*(ahead[-x:] if x else ()), *after[: PASSAGE_WORDS - x]])
            ends.append((hashlib.blake2b(whole, digest_size=16).digest(), row, x))
    return mask, ends


def repeats(contexts: DataFrame) -> DataFrame:
    """(t, place, mask) of suffixes of which passages are repeats: bit x of the mask for the one that begins x words before."""
    ties = ["id", "k", "place"]
    size = contexts.agg(F.sum(F.octet_length("right") + F.octet_length("left") + 60)).head()[0] or 0
    block = BLOCK_ROWS
    dealt = contexts.repartitionByRange(_common.partitions(contexts.sparkSession, size), F.substring("right", 1, PREFIX_BYTES), *ties).sortWithinPartitions("right", *ties)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        begun = False  # a prefix that isn't the partition's first has been reached

        def out(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, begun
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            prefix = pc.binary_slice(t.column("right"), 0, PREFIX_BYTES)
            turns = np.flatnonzero(pc.not_equal(prefix[1:], prefix[:-1]).to_numpy(zero_copy_only=False)) + 1
            if not final and not len(turns):
                held = [t]
                return
            to = t.num_rows if final else int(turns[-1])
            opens = 0 if begun else (int(turns[0]) if len(turns) else t.num_rows)
            closes = (int(turns[-1]) if len(turns) else 0) if final else to
            mask, ends = _matches(t.slice(0, to), opens, closes)
            begun, held = True, [] if final else [t.slice(to)]
            some = np.flatnonzero(mask)
            index = pa.array(np.concatenate((some, np.array([row for _, row, _ in ends], np.int64))))
            masks = pa.array([*mask[some].tolist(), *(1 << x for _, _, x in ends)], pa.int32())
            yield pa.RecordBatch.from_arrays([*(t.column(c).take(index) for c in ("t", "id", "k", "place")), masks, pa.array([None] * len(some) + [d for d, _, _ in ends], pa.binary())], names=["t", "id", "k", "place", "mask", "passage"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= block:
                    yield from out(False)
        if held:
            yield from out(True)

    found = _common.stash(dealt.mapInArrow(of, "t long, id long, k long, place int, mask int, passage binary"), "repeats")
    open_ = found.where("passage is not null").withColumn("o", F.struct(F.col("id").isNull().alias("last"), "id", "k", "place"))
    owner = open_.groupBy(F.col("passage").alias("p")).agg(F.min("o").alias("first"))
    settled = open_.join(owner, F.col("passage") == F.col("p")).where(~F.col("o").eqNullSafe(F.col("first")))
    return found.where("passage is null").select("t", "place", "mask").union(settled.select("t", "place", "mask"))


def cut(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with later occurrences of repeated passages cut; adds `spans`, the cut stretches of characters."""
    kept = [c for c in docs.columns if c != "spans"]
    digest = F.when(_long(F.col(text)), F.sha2(text, 256))
    bare = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("k"), digest.alias("sha"))
    suffixes = _common.stash(_suffixes(bare), "seeds")
    shared = suffixes.groupBy("seed").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.max("twice").alias("twice")).where("a <> b or twice").select(F.col("seed").alias("shared"), F.expr("a <> b").alias("others"))
    of_text = suffixes.join(shared, F.col("seed") == F.col("shared")).groupBy(F.col("k").alias("own")).agg(F.collect_set(F.when(F.col("others"), F.col("seed"))).alias("seeds"))
    texts = bare.where("sha is not null").groupBy("sha", "k").agg(F.min("id").alias("first"))
    known = texts.join(of_text, F.col("k") == F.col("own"), "left").select("sha", "k", "first", "seeds")
    known = _common.stash(known.withColumn("t", F.monotonically_increasing_id()), "texts")
    one = known.where("seeds is not null").select(F.col("sha").alias("same"), "t", "first", "seeds")
    found = bare.join(one, (F.col("sha") == F.col("same")) & F.col("id").eqNullSafe(F.col("first"))).select("t", "id", "k", "text", "seeds")
    # Sorting samples its input, which therefore is a table.
    contexts = _common.stash(_contexts(found), "contexts")
    later = repeats(contexts.where("right is not null").drop("words")).withColumn("words", F.lit(PASSAGE_WORDS))
    selves = contexts.where("right is null").select("t", "place", F.lit(1).alias("mask"), "words")
    later = later.union(selves).groupBy(F.col("t").alias("of")).agg(F.collect_list(F.struct("place", "mask", "words")).alias("cuts"))
    plan = known.join(later, F.col("t") == F.col("of"), "left").select(F.col("sha").alias("same"), "first", "cuts")
    plan = _common.stash(plan, "passages")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(doc_id).cast("long").alias("id"), digest.alias("sha"))
    rows = rows.join(plan, F.col("sha") == F.col("same"), "left").select("row", "id", "same", "first", "cuts")
    where = kept.index(text)
    schema = docs.select(*(F.col(f"`{c}`") for c in kept), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))).alias("spans")).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            columns = [*whole.column("row").flatten(), *(whole.column(c) for c in ("id", "same", "first", "cuts"))]
            for batch in _common.slices([pa.RecordBatch.from_arrays(columns, names=[str(k) for k in range(len(columns))])], str(where)):
                name, same, first, cuts = batch.columns[len(kept) :]
                body = batch.column(where).to_pylist()
                spans: list[list | None] = [None] * len(body)
                for k in np.flatnonzero(pc.is_valid(same).to_numpy(zero_copy_only=False)).tolist():
                    if name[k].as_py() != first[k].as_py():
                        # Shorter in words than a passage, it isn't cut even as a whole.
                        if len(words(_bytes(body[k]))[0]) >= PASSAGE_WORDS:
                            spans[k], body[k] = [(0, len(body[k]))], ""
                    elif cuts[k].is_valid:
                        own = cuts[k].values
                        body[k], spans[k] = _without(body[k], *(own.field(c).to_numpy() for c in ("place", "mask", "words")))
                done = [pa.array(body, pa.string()) if c == where else batch.column(c) for c in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*done, pa.array([[{"start": a, "end": b} for a, b in s or ()] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=[*kept, "spans"])

    return rows.mapInArrow(apply, schema)


def _without(text: str, places: np.ndarray, masks: np.ndarray, lengths: np.ndarray) -> tuple[str, list[tuple[int, int]]]:
    """The text without the words of passages that an earlier text or place has, and what was cut: `lengths` words from x before a place on, for each bit x of its mask."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends = words(data)
    edge = np.zeros(len(starts) + 1, np.int64)
    for x in range(STEP):
        some = masks >> x & 1 == 1
        np.add.at(edge, places[some] - x, 1)
        np.add.at(edge, places[some] - x + lengths[some], -1)
    turns = _covered(edge)
    if not len(turns):
        return text, []
    parts, spans, last = [], [], 0
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    for a, b in turns.tolist():
        # Up to the next word, or with the blanks before it where no word follows.
        to = int(starts[b]) if b < len(starts) else len(data)
        since = int(starts[a]) if b < len(starts) or not a else int(ends[a - 1])
        parts.append(raw[last:since])
        spans.append((int(before[since]), int(before[to])))
        last = to
    parts.append(raw[last:])
    return b"".join(parts).decode(), spans
