"""Operator 4, quality by a linear-chain conditional random field over lines.

Every ``\\n``-separated line that is not blank is a node labelled bad or good. Its features are
shares of kinds of characters, words and repetitions, of the line itself and of its
neighbours. Forward-backward gives each line's chance to be good; the mean of these,
weighted by the lines' lengths, is the document's score.

The field is fitted on at most about ``SAMPLE`` documents of either label, of up to ``SAMPLE_BYTES`` and ``SAMPLE_LINES`` lines each
and outside of the held-out fold; a line takes its document's label. Features are
collected for that sample only (150 MB if all its documents had the most lines). Scores are made for all whole texts, as blocks stream by, and
all documents of a block go through the recursion side by side.

Edge cases: a null, empty or blank text has no line, score 0 and is predicted 0; documents
without labels are scored alike; a null id counts as held out; repeated rows are scored each;
without labelled rows of both kinds every score is 0.5; an empty table gives no rows;
other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import VISIBLE, blocks, flat, widen, widened, word_hashes, words
from tessera.llm.folds import held_out, sampled

SAMPLE = 1500
SAMPLE_BYTES = 1 << 17
SAMPLE_LINES = 256
STEPS, RATE, DECAY = 150, 0.1, 1e-3
THRESHOLD = 0.3


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.float32)
    t[list(chars)] = 1
    return t


# Kinds of bytes whose shares are features.
_KINDS = [_table(b"#*$%&|<>{}~^=_\\@+"), _table(bytes(range(65, 91))), _table(b"!?"), _table(b"0123456789"), _table(b"|"), _table(b",;:.'\"()-"), _table(bytes(range(128, 256)))]
_STOPS = _table(b".!?:;\"')]")
FEATURES = len(_KINDS) + 9


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines that are not blank with those of their neighbours, lengths, and offsets of texts into lines."""
    data, offsets = flat(texts)
    starts, ends, at = words(data, offsets, VISIBLE)
    if not len(starts):
        return np.zeros((0, 3 * FEATURES + 2)), np.zeros(0), at
    # a line begins at the first word after a text's or a line's begin
    breaks = np.r_[0, np.cumsum(data == 10)]
    new = np.r_[True, breaks[starts[1:]] > breaks[starts[:-1]]]
    new[at[:-1][np.diff(at) > 0]] = True
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(starts)])
    begin, end = starts[first], ends[np.r_[first[1:], len(starts)] - 1]
    length = (end - begin).astype(np.float64)
    doc_line = np.searchsorted(first, at)
    hashes = word_hashes(data, starts, ends)
    same = np.r_[False, hashes[1:] == hashes[:-1]] & ~new
    line_hash = np.add.reduceat(hashes * (np.arange(len(hashes)) - np.repeat(first, count) + 1).astype(np.uint64), first)
    row = np.repeat(np.arange(len(at) - 1), np.diff(doc_line))
    order = np.lexsort((np.arange(len(line_hash)), line_hash, row))
    again = np.zeros(len(first), bool)
    again[order[1:]] = (line_hash[order[1:]] == line_hash[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    span = np.empty(2 * len(begin), np.int64)
    span[::2], span[1::2] = begin, end
    padded = np.r_[data, np.uint8(0)]
    cols = [np.minimum(4 * np.add.reduceat(k[padded], span)[::2] / length, 2) for k in _KINDS]
    cols += [
        _STOPS[data[end - 1]], np.minimum(count, 3) / 3.0, np.log1p(count) / 5, np.minimum(np.add.reduceat((ends - starts).astype(np.float64), first) / count / 8, 3),
        np.add.reduceat(same.astype(np.float64), first) / count, again.astype(float), np.add.reduceat(((ends - starts) == 1).astype(np.float64), first) / count,
        np.add.reduceat(_KINDS[0][data[ends - 1]].astype(np.float64), first) / count, np.ones(len(first)),
    ]
    own = np.stack(cols, axis=1)
    back, ahead = np.zeros_like(own), np.zeros_like(own)
    inner = row[1:] == row[:-1]
    back[1:][inner] = own[:-1][inner]
    ahead[:-1][inner] = own[1:][inner]
    total = np.diff(doc_line)[row]
    place = np.stack([np.log1p(total) / 5, again * 1.0 + 0 * total], axis=1)
    return np.concatenate([own, back, ahead, place], axis=1), length, doc_line


def _step(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log((e^(r+t11) + e^t01) / (e^(r+t10) + e^t00)): what a neighbour's log odds say about a line."""
    return np.logaddexp(r + t[1, 1], t[0, 1]) - np.logaddexp(r + t[1, 0], t[0, 0])


def chances(odds: np.ndarray, at: np.ndarray, t: np.ndarray, pairs: bool = False):
    """Each line's chance to be good, given the lines' own log odds; with ``pairs`` also those of neighbouring labels."""
    sizes = np.diff(at)
    order = np.argsort(-sizes, kind="stable")
    begin, left = at[:-1][order], sizes[order]
    ahead, behind = odds.copy(), np.zeros_like(odds)
    alive = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), "right")
    for k in range(1, len(alive)):
        i = begin[: alive[k]] + k
        ahead[i] += _step(ahead[i - 1], t)
    for k in range(1, len(alive)):
        n = alive[k]
        i = begin[:n] + left[:n] - 1 - k
        behind[i] = _step(odds[i + 1] + behind[i + 1], t.T)
    good = 1 / (1 + np.exp(-np.clip(ahead + behind, -60, 60)))
    if not pairs:
        return good
    inner = np.ones(len(odds), bool)
    inner[at[:-1][sizes > 0]] = False
    i = np.flatnonzero(inner)
    joint = np.stack([t[a, b] + a * ahead[i - 1] + b * (odds[i] + behind[i]) for a in (0, 1) for b in (0, 1)], axis=1)
    joint = np.exp(joint - joint.max(1, keepdims=True))
    return good, joint / joint.sum(1, keepdims=True), i


class Field:
    """Weights of the lines' features and of neighbouring labels."""

    def __init__(self, width: int):
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.weights, self.bias, self.pair = np.zeros(width), 0.0, np.zeros((2, 2))

    def odds(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias

    def fit(self, x: np.ndarray, at: np.ndarray, label: np.ndarray) -> None:
        """Adam on the conditional likelihood of whole documents, each of which counts alike."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.scale
        sizes = np.diff(at)
        y, weight = np.repeat(label, sizes).astype(float), np.repeat(1 / np.maximum(sizes, 1), sizes) / max(len(sizes), 1)
        theta = np.zeros(z.shape[1] + 5)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, STEPS + 1):
            self.weights, self.bias, self.pair = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)
            good, joint, inner = chances(z @ self.weights + self.bias, at, self.pair, True)
            off = (y - good) * weight
            told = np.zeros_like(joint)
            told[np.arange(len(inner)), (3 * y[inner]).astype(int)] = 1
            grad = np.concatenate([z.T @ off - DECAY * self.weights, [off.sum()], ((told - joint) * weight[inner, None]).sum(0) - DECAY * theta[-4:]])
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        self.weights, self.bias, self.pair = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list]:
        """Documents' scores, and their lines' chances."""
        x, length, at = line_features(texts)
        sizes = np.diff(at)
        good = chances(self.odds(x), at, self.pair) if len(x) else np.zeros(0)
        full = sizes > 0
        score = np.zeros(len(sizes))
        if full.any():
            begin = at[:-1][full]
            score[full] = np.add.reduceat(good * length, begin) / np.add.reduceat(length, begin)
        return score, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(good))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches):
        x, _, at = line_features(part.column("text"))
        x = x.astype(np.float32)
        yield pa.record_batch([part.column("quality"), pa.array([x[a:b].tobytes() if b - a <= SAMPLE_LINES else b"" for a, b in zip(at, at[1:])], pa.binary())], names=["quality", "lines"])


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """Fit on a bounded sample of labelled documents."""
    chosen = sampled(labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")), "quality", SAMPLE)
    few = F.broadcast(chosen)  # about 2 * SAMPLE rows by construction
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_BYTES).join(few, "doc_id").select("quality", "text")
    rows = [r for r in texts.mapInArrow(_examples, "quality int, lines binary").collect() if r.lines]
    field = Field(3 * FEATURES + 2)
    if len({r.quality for r in rows}) == 2:
        parts = [np.frombuffer(r.lines, np.float32).reshape(-1, 3 * FEATURES + 2) for r in rows]
        at = np.r_[0, np.cumsum([len(p) for p in parts])]
        field.fit(np.concatenate(parts).astype(float), at, np.array([r.quality for r in rows]))
    return field


def _score(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches):
        score, lines = field.score(part.column("text"))
        yield widen(part, ["score", "predicted", "line_scores"], [score, (score >= THRESHOLD).astype(np.int32), lines])


def quality(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` (doc_id, text) with held_out, score (0 to 1), predicted (0 or 1) and line_scores."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    docs = docs.withColumn("held_out", held_out())
    return docs.mapInArrow(lambda batches: _score(batches, shared.value), widened(docs.schema, "score double, predicted int, line_scores array<double>"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    field = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality(docs, field).select("doc_id", "held_out", "score", "predicted", F.size("line_scores").cast("bigint").alias("n_lines"))
