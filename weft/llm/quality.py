"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features say what its bytes and words are like, and so do its
neighbours' lines' features; transitions tie neighbouring labels. The forward-backward recursion gives each line's
marginal probability of being good, and their mean, weighted by the lines' lengths, is the
document's score.

The model is fitted on at most `SAMPLE_DOCS` labelled documents with at most `SAMPLE_LINES` lines each,
the first in the order of a hash of their ids; all lines of a document bear its label, and each
document weighs the same. Ids, labels, languages and sources are no features.

Defined results: a null text is empty, and an empty text is one empty line. Without any labelled
row every score is 0.5; where all labels agree, it is that label. Repeated rows get equal scores; labels
without a value or without a document teach nothing, of several for an id the lowest counts. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from weft.llm import _common

#: Bound of the sample that the model is fitted on.
SAMPLE_DOCS = 4000
SAMPLE_LINES = 200
ROUNDS = 150
RATE = 0.1
RIDGE = 1e-3
#: A score from here on counts as good.
THRESHOLD = 0.3

# Kinds of bytes: small letters and all beyond ASCII, capitals, digits, white space, the common marks of prose, bars,
# exclamation marks, anything else.
_KINDS = 8
_KIND = np.full(256, 7, np.uint8)
for _k, _of in enumerate((bytes(range(ord("a"), ord("z") + 1)) + bytes(range(128, 256)), bytes(range(ord("A"), ord("Z") + 1)), b"0123456789", b" \t\r\n\x0b\x0c", b".,;:'\"?()-", b"|", b"!")):
    _KIND[np.frombuffer(_of, np.uint8)] = _k

_WIDE = _KINDS + 6
#: Numbers for bytes, whose sums tell words and lines apart well enough to see repetition.
_MARK = np.random.default_rng(3).integers(1, 1 << 40, 256)


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, the lines' lengths in bytes and each text's number of lines."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    sizes = np.diff(ends, prepend=-1) - 1
    n_lines = np.array([x.count(b"\n") + 1 for x in raw], np.int64)
    line = np.repeat(np.arange(len(ends)), sizes + 1)
    kind = _KIND[data]
    counts = np.bincount(line * _KINDS + kind, minlength=len(ends) * _KINDS).reshape(-1, _KINDS)
    counts[:, 3] -= 1  # the line's end
    blank = kind == 3
    closes = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    words = np.bincount(line[closes], minlength=len(ends))
    # Words that end in neither a letter nor a mark of prose.
    odd = np.bincount(line[closes[np.isin(kind[closes - 1], (5, 6, 7))]], minlength=len(ends))
    # Words and lines that repeat the one before.
    sums = np.concatenate(([0], np.cumsum(_MARK[data])))
    opens = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    marks = sums[closes] - sums[opens]
    again = np.flatnonzero((marks[1:] == marks[:-1]) & (line[opens[1:]] == line[opens[:-1]])) + 1
    same = np.bincount(line[opens[again]], minlength=len(ends))
    marks = sums[ends] - sums[ends - sizes]
    echo = np.zeros(len(ends))
    echo[1:] = (marks[1:] == marks[:-1]) & (sizes[1:] > 0)
    echo[np.cumsum(n_lines) - n_lines] = 0
    long = np.maximum(sizes, 1)[:, None]
    own = np.column_stack((counts / long, np.log1p(sizes) / 5, (sizes - counts[:, 3]) / np.maximum(words, 1) / 10, odd / np.maximum(words, 1), same / np.maximum(words, 1), echo, sizes == 0))
    return own, sizes, n_lines


def with_neighbours(own: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """A line's own features, the line before's and the line after's; zeros beyond the document."""
    ends = np.cumsum(n_lines)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[ends - n_lines], after[ends - 1] = 0, 0
    edge = np.zeros((len(own), 2))
    edge[ends - n_lines, 0] = edge[ends - 1, 1] = 1
    return np.column_stack((own, before, after, edge, np.ones(len(own))))


def forward_backward(unary: np.ndarray, n_lines: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of good for each line, expected transitions (document, 2, 2) and log partition of each document.

    unary: a line's score for good against bad; pair: scores of the transitions.
    """
    order = np.argsort(-n_lines, kind="stable")
    sizes, starts = n_lines[order], (np.cumsum(n_lines) - n_lines)[order]
    longest = int(sizes[0]) if len(sizes) else 0
    living = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
    forward = np.zeros((len(unary), 2))
    scores = np.column_stack((np.zeros(len(unary)), unary))
    for t in range(longest):
        at = starts[: living[t]] + t
        if t:
            last = forward[at - 1]
            forward[at] = np.column_stack([np.logaddexp(last[:, 0] + pair[0, y], last[:, 1] + pair[1, y]) for y in (0, 1)])
        forward[at] += scores[at]
    backward = np.zeros((len(unary), 2))
    for t in range(longest - 2, -1, -1):
        at = starts[: living[t + 1]] + t
        then = scores[at + 1] + backward[at + 1]
        backward[at] = np.column_stack([np.logaddexp(then[:, 0] + pair[y, 0], then[:, 1] + pair[y, 1]) for y in (0, 1)])
    last = starts + sizes - 1
    total = np.empty(len(n_lines))
    total[order] = np.logaddexp(forward[last, 0], forward[last, 1])
    each = np.repeat(total, n_lines)
    good = np.exp(np.minimum(0, forward[:, 1] + backward[:, 1] - each))
    inner = np.ones(len(unary), bool)
    inner[np.cumsum(n_lines) - 1] = False
    at = np.flatnonzero(inner)
    joint = np.exp(forward[at][:, :, None] + pair[None] + (scores + backward)[at + 1][:, None, :] - each[at][:, None, None])
    moves = np.zeros((len(n_lines), 2, 2))
    np.add.at(moves, np.repeat(np.arange(len(n_lines)), n_lines)[at], joint)
    return good, moves, total


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    pair: np.ndarray
    middle: np.ndarray
    scale: np.ndarray

    def unary(self, x: np.ndarray) -> np.ndarray:
        return (x - self.middle) / self.scale @ self.weights

    def scores(self, texts: list[str | None]) -> np.ndarray:
        own, sizes, n_lines = line_features(texts)
        good, _, _ = forward_backward(self.unary(with_neighbours(own, n_lines)), n_lines, self.pair)
        weight, first = sizes + 1.0, np.cumsum(n_lines) - n_lines
        return np.clip(np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first), 0, 1)


@dataclass(frozen=True)
class Constant:
    value: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.full(len(texts), self.value)


def fit(own: np.ndarray, n_lines: np.ndarray, labels: np.ndarray) -> Model | Constant:
    """Maximum likelihood with a ridge, by Adam, from a zero start."""
    if not len(labels):
        return Constant(0.5)
    if labels.min() == labels.max():
        return Constant(float(labels[0]))
    x = with_neighbours(own, n_lines)
    middle, scale = x.mean(axis=0), x.std(axis=0)
    middle[-1], scale[scale < 1e-9] = 0, 1
    z = (x - middle) / scale
    y = np.repeat(labels, n_lines)
    weight = 1 / np.repeat(n_lines, n_lines) / len(n_lines)
    share = 1 / n_lines / len(n_lines)
    steps = (n_lines - 1) * share
    seen = np.diag([steps[labels == 0].sum(), steps[labels == 1].sum()])
    theta = np.zeros(z.shape[1] + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, ROUNDS + 1):
        pair = theta[-4:].reshape(2, 2)
        good, moves, _ = forward_backward(z @ theta[:-4], n_lines, pair)
        slope = np.concatenate((z.T @ (weight * (good - y)), ((moves * share[:, None, None]).sum(axis=0) - seen).ravel())) + RIDGE * theta
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        theta = theta - RATE * first / (1 - 0.9**k) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return Model(theta[:-4], theta[-4:].reshape(2, 2), middle, scale)


def learn(docs: DataFrame, labels: DataFrame, teaches: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model | Constant:
    """Fit on the documents whose labels may teach (`teaches`, over the labels' `row_id`)."""
    _common.ship(docs.sparkSession)
    known = labels.select(F.col(doc_id).cast("long").alias("row_id"), F.col(label).cast("int").alias("label")).where(F.col("row_id").isNotNull() & F.col("label").isNotNull() & teaches)
    chosen = known.groupBy("row_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("row_id"), "row_id").limit(SAMPLE_DOCS)
    rows = docs.select(F.col(doc_id).cast("long").alias("row_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "row_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches, "text"):
            own, _, n_lines = line_features(batch.column("text").to_pylist())
            cells = [x.astype(np.float32).tobytes() if len(x) <= SAMPLE_LINES else None for x in np.split(own, np.cumsum(n_lines)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("label"), pa.array(cells, pa.binary())], names=["row_id", "label", "lines"])

    # At most SAMPLE_DOCS rows of at most SAMPLE_LINES lines.
    found = rows.mapInArrow(read, "row_id long, label int, lines binary").where("lines is not null").orderBy("row_id", "lines").limit(SAMPLE_DOCS).collect()
    lines = [np.frombuffer(r.lines, np.float32).reshape(-1, _WIDE) for r in found]
    return fit(np.concatenate(lines).astype(float) if lines else np.zeros((0, _WIDE)), np.array([len(x) for x in lines], np.int64), np.array([float(r.label > 0) for r in found]))


def score(docs: DataFrame, model: Model | Constant, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with the score added."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(batch.column(text).to_pylist()), pa.float64())], names=[*batch.schema.names, name])

    _common.ship(docs.sparkSession)
    kept = docs.drop(name)
    return kept.mapInArrow(of, StructType([*kept.schema.fields, StructField(name, DoubleType())]))
