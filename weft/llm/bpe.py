"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Every chunk of documents (`CHUNK_BYTES` of text) becomes a dictionary of its pre-tokens and, in order
of position, each pre-token's place in that dictionary. The dictionary's words are exploded by a
hash of the word, those of one hash bucket in one row, so that all occurrences of a word in
dictionaries meet in one task, where it is encoded once and its ids join them. The ids go back to
their chunk, and the positions put them in order. So the shuffles carry a chunk's distinct words
instead of all its words, packed and compressed by bucket, and even the most common word stands in
each chunk only once. Decoding looks every id up in the token-byte table, which has one row for each
id of the vocabulary.

Defined results: a null text counts as empty; an empty text has no ids; repeated rows each get their
own result; a null id stays null; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import _common, tokens

CHUNK_BYTES = 32 << 20
#: Words whose ids a task remembers.
MEMO_WORDS = 1_000_000
#: Buckets of words for each shuffle partition.
BUCKETS_EACH = 3

_PIECES = "chunk long, bucket int, row_ids array<long>, n_words array<int>, payload binary"


def squeeze(x: np.ndarray) -> bytes:
    """Numbers compressed: their lowest bytes, then the next ones, and so on."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unsqueeze(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def squeeze_places(places: np.ndarray, repeated: int) -> bytes:
    """Places of words, of which those from `repeated` on occur once each and in this order.

    Those need no number. Of the others, the number of bits goes into one compressed stream, and the
    bits below the leading one are packed by that number.
    """
    x = np.where(places >= repeated, 0, places + np.uint32(1)).astype(np.uint32)
    bits = np.zeros(len(x), np.uint8)
    for n in range(32):
        bits += x >= np.uint32(1 << n)
    parts = [zstandard.ZstdCompressor(level=6).compress(bits.tobytes())]
    for n in range(1, 33):
        own = x[bits == n] if n > 1 else x[:0]
        parts.append(np.packbits((own[:, None] >> np.arange(n - 1, dtype=np.uint32) & np.uint32(1)).astype(np.uint8)).tobytes())
    return _joined(struct.pack("<I", repeated), *parts)


def unsqueeze_places(x: bytes) -> np.ndarray:
    head, stream, *parts = _parted(x, 34)
    bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(stream), np.uint8)
    out = np.zeros(len(bits), np.uint32)
    for n, part in enumerate(parts, 1):
        at = np.flatnonzero(bits == n)
        low = np.unpackbits(np.frombuffer(part, np.uint8), count=len(at) * (n - 1)).reshape(len(at), n - 1)
        out[at] = (1 << (n - 1)) - 1 + low @ (1 << np.arange(n - 1, dtype=np.uint32))
    once = np.flatnonzero(bits == 0)
    out[once] = struct.unpack("<I", head)[0] + np.arange(len(once), dtype=np.uint32)
    return out


def _joined(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def _parted(x: bytes, n: int) -> Iterator[bytes]:
    at = 4 * n
    for size in struct.unpack_from(f"<{n}I", x):
        yield x[at : at + size]
        at += size


def chunked(docs: DataFrame, source: str, pattern: str, buckets: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each chunk its documents' places (bucket null), and for each bucket of words its places and words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, chunk = tokens.ranks(source, pattern), TaskContext.get().partitionId() << 32
        press = zstandard.ZstdCompressor(level=3).compress
        for part in _common.slices(batches, "text", CHUNK_BYTES):
            seen: dict[bytes, int] = {}
            flats, sizes = [], []
            for some in _common.slices([part], "text", tokens.SLICE_BYTES):
                found = tool.split(some.column("text").to_pylist())
                known = np.fromiter((seen.setdefault(w, len(seen)) for w in found.distinct), np.uint32, len(found.distinct))
                flats.append(known[found.places])
                sizes.append(np.diff(found.first))
            flat, words, counts = np.concatenate(flats), list(seen), np.concatenate(sizes)
            del flats, seen
            times = np.bincount(flat, minlength=len(words))
            order = np.argsort(-times, kind="stable")  # the commonest word first, so that most places are small
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            at = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int32, len(words))
            by = np.lexsort((place, at))
            rows = [(None, squeeze_places(place[flat], int(np.count_nonzero(times > 1))))]
            del flat, order
            for own in np.split(by, np.flatnonzero(np.diff(at[by])) + 1) if len(by) else ():
                body = [words[k] for k in own.tolist()]
                sizes = np.fromiter(map(len, body), np.uint32, len(body))
                rows.append((int(at[own[0]]), _joined(squeeze(np.diff(place[own], prepend=np.uint32(0))), squeeze(sizes), press(b"".join(body)))))
            ids = [part.column("row_id").to_pylist(), *[None] * (len(rows) - 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * len(rows)), pa.array([b for b, _ in rows], pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array([counts.tolist(), *[None] * (len(rows) - 1)], pa.list_(pa.int32())), pa.array([x for _, x in rows], pa.binary())],
                names=["chunk", "bucket", "row_ids", "n_words", "payload"],
            )
            chunk += 1

    return docs.select(F.col(doc_id).cast("long").alias("row_id"), _common.lossless_text(text).alias("text")).mapInArrow(cut, _PIECES)


def encode(docs: DataFrame, source: str, pattern: str, doc_id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Ids of every text and the text that decodes from them.

    source: the contents of a rank file; pattern: the expression that splits a text before merging.
    Gives (row_id, n_tokens, ids binary little-endian uint32, decoded binary), or with `digests`
    the SHA-256 of both in place of the two.
    """
    spark = docs.sparkSession
    n = _common.partitions(spark, _common.size_of(docs))
    pieces = _common.stash(chunked(docs, source, pattern, BUCKETS_EACH * n, doc_id, text), "bpe")
    # A task puts together about as many chunks as one read, however many there are.
    chunks = max(_common.parallelism(spark), pieces.where("bucket is null").count())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, known = tokens.ranks(source, pattern), {}
        open_, press = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            out = []
            for payload in batch.column("payload").to_pylist():
                places, sizes, body = _parted(payload, 3)
                ends, body = np.cumsum(unsqueeze(sizes)).tolist(), open_(body)
                words = [body[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                if len(known) > MEMO_WORDS:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = np.array(tool.encode(w), "<u4").tobytes()
                ids = [known[w] for w in words]
                out.append(_joined(places, squeeze(np.fromiter(map(len, ids), np.uint32, len(ids)) // 4), squeeze(np.frombuffer(b"".join(ids), "<u4"))))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(out, pa.binary())], names=["chunk", "ids"])

    dealt = pieces.where("bucket is not null").select("chunk", "bucket", "payload").repartition(n, "bucket")
    found = dealt.mapInArrow(merge, "chunk long, ids binary")
    kind = "string" if digests else "binary"
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")

    def assemble(words: pa.Table, rows: pa.Table) -> pa.Table:
        tool = tokens.ranks(source, pattern)
        parts = [list(map(unsqueeze, _parted(x, 3))) for x in words.column("ids").to_pylist()]
        places = np.concatenate([np.cumsum(p, dtype=np.uint32) for p, _, _ in parts]) if parts else np.zeros(0, np.uint32)
        sizes = np.concatenate([s for _, s, _ in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        flat = np.concatenate([x for _, _, x in parts]) if parts else np.zeros(0, np.uint32)
        starts, lengths = np.empty(len(places), np.int64), np.empty(len(places), np.int64)
        starts[places], lengths[places] = np.cumsum(sizes) - sizes, sizes
        out: list[list] = [[], [], [], []]
        for row in rows.to_pylist():
            codes, at = unsqueeze_places(row["payload"]), 0
            for row_id, n in zip(row["row_ids"], row["n_words"], strict=True):
                own = codes[at : at + n]
                at += n
                ids = flat[_common.ragged(starts[own], lengths[own])]
                decoded = tool.flat[_common.ragged(tool.start[ids], tool.length[ids])]
                out[0].append(row_id)
                out[1].append(len(ids))
                for k, x in ((2, ids.tobytes()), (3, decoded.tobytes())):
                    out[k].append(hashlib.sha256(x).hexdigest() if digests else x)
        last = pa.string() if digests else pa.binary()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], last), pa.array(out[3], last)], names=["row_id", "n_tokens", *names])

    whole = pieces.where("bucket is null").select(F.col("chunk").alias("own"), "row_ids", "n_words", "payload")
    found, whole = found.repartition(chunks, "chunk"), whole.repartition(chunks, "own")
    return found.groupBy("chunk").cogroup(whole.groupBy("own")).applyInArrow(assemble, f"row_id long, n_tokens long, {names[0]} {kind}, {names[1]} {kind}")
