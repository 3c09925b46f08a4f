"""Operator 1, language identification of spans and whole texts.

A word's script, from the ranges of its characters, narrows the languages that it may be; its
score under each is the sum of log probabilities of its byte trigrams. Viterbi's algorithm
with a penalty for each switch of language labels the words of a text; neighbouring
words of one language are a span. The text's language is the one with most letters.

Most texts are of one language, and then the labelling need not be searched: if no stretch
of words gains more than half a penalty by any other language, no labelling beats the
constant one, which is checked for a block of texts at once. The rest are walked.

The model is a table of ``BUCKETS`` hashed trigrams for each language, counted by the cluster on a
sample of at most about ``SAMPLE`` labelled texts a language (whole texts), so what is collected
and broadcast is bounded by buckets times languages. Held-out texts are never counted.

Edge cases: a null text or one without any letter is ``und`` with score 0 and no span; without
any labelled text, all are ``und``; rows with null ids count as held out; repeated rows are
labelled each; an empty table gives no rows; other columns of the input pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import blocks, flat, widen, widened, words
from tessera.llm.folds import held_out, sampled

SAMPLE = 3000
BITS = 16
BUCKETS = 1 << BITS
SMOOTHING = 0.5
SWITCH = 20.0
#: A language may be meant by words of a script that makes up this share of its words.
SCRIPT_SHARE = 0.01
OTHER_SCRIPT = 20.0

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _script_table() -> np.ndarray:
    """Scripts by the first byte of a character in UTF-8; 0 is Latin, ASCII and what any script uses."""
    # Last byte of each range and the script's number.
    ranges = [(0xCD, 0), (0xCF, 1), (0xD4, 2), (0xD7, 3), (0xDB, 4), (0xDF, 5), (0xE0, 6), (0xE2, 0), (0xE3, 7), (0xE9, 8), (0xED, 9), (0xFF, 10)]
    table, at = np.zeros(256, np.uint8), 0
    for last, script in ranges:
        table[at : last + 1] = script
        at = last + 1
    return table


_SCRIPT = _script_table()
SCRIPTS = 11


def _words(texts: pa.Array):
    """Lower-cased bytes with a space for each non-letter; words; trigram buckets of all letters; scripts of words."""
    data, offsets = flat(texts)
    starts, ends, at = words(data, offsets, _LETTER)
    clean = np.where(_LETTER[data], data, 0x20).astype(np.uint32)
    upper = (clean >= 65) & (clean <= 90)
    if len(clean) > 1:
        upper[1:] |= (clean[:-1] == 0xC3) & (clean[1:] >= 0x80) & (clean[1:] <= 0x9E) & (clean[1:] != 0x97)
    clean[upper] += 0x20
    letters = np.flatnonzero(_LETTER[data])
    padded = np.r_[np.uint32(0x20), clean, np.uint32(0x20)]
    left, right = padded[letters], padded[letters + 2]
    begins = np.searchsorted(letters, starts)
    if len(begins):
        left[begins] = 0x20
        right[np.r_[begins[1:], len(letters)] - 1] = 0x20
    grams = (left << 16) | (padded[letters + 1] << 8) | right
    buckets = (grams * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    script = np.maximum.reduceat(_SCRIPT[data[letters]], begins) if len(begins) else np.zeros(0, np.uint8)
    return data, offsets, starts, ends, at, begins, buckets, script


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of trigram buckets and, above them, of scripts for each language of a task's texts."""
    counts: dict[str, np.ndarray] = {}
    for part in blocks(batches):
        _, offsets, _, _, at, begins, buckets, script = _words(part.column("text"))
        edge = np.r_[begins, len(buckets)][at]
        for i, lang in enumerate(part.column("lang").to_pylist()):
            c = counts.setdefault(lang, np.zeros(BUCKETS + SCRIPTS, np.int64))
            c[:BUCKETS] += np.bincount(buckets[edge[i] : edge[i + 1]], minlength=BUCKETS)
            c[BUCKETS:] += np.bincount(script[at[i] : at[i + 1]], minlength=SCRIPTS)
    for lang, c in counts.items():
        some = np.flatnonzero(c)
        yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(c[some])], names=["lang", "bucket", "n"])


class Model:
    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        place = {lang: i for i, lang in enumerate(self.langs)}
        counts = np.zeros((len(self.langs), BUCKETS + SCRIPTS))
        for lang, bucket, n in rows:
            counts[place[lang], bucket] = n
        grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
        self.log = np.log((grams + SMOOTHING) / (grams.sum(1, keepdims=True) + SMOOTHING * BUCKETS)).astype(np.float32)
        allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)
        allowed[:, ~allowed.any(0)] = True
        self.script = np.where(allowed, 0.0, -OTHER_SCRIPT)


def train(docs: DataFrame) -> Model:
    """Learn from text and lang of a sample of the labelled documents."""
    rows = sampled(docs.select("doc_id", "text", "lang").where("text IS NOT NULL"), "lang", SAMPLE)
    counted = rows.select("lang", "text").mapInArrow(_count, "lang string, bucket int, n bigint")
    return Model([tuple(r) for r in counted.groupBy("lang", "bucket").agg(F.sum("n")).collect()])


def viterbi(scores: np.ndarray, switch: float) -> list[int]:
    """The labelling of rows with the largest sum of scores less ``switch`` for each change."""
    value = [0.0] * scores.shape[1]
    back: list[list[int] | None] = []
    for row in scores.tolist():
        top = max(value)
        best, limit = value.index(top), top - switch
        if min(value) >= limit:
            back.append(None)  # all stay
            value = [v + s for v, s in zip(value, row)]
        else:
            back.append([k if v >= limit else best for k, v in enumerate(value)])
            value = [(v if v >= limit else limit) + s for v, s in zip(value, row)]
    label = value.index(max(value))
    out = [label]
    for step in reversed(back[1:]):
        if step is not None:
            label = step[label]
        out.append(label)
    return out[::-1]


def constant_is_best(scores: np.ndarray, at: np.ndarray, best: np.ndarray, switch: float) -> np.ndarray:
    """For each text whether no stretch of words gains over half of ``switch`` by another language."""
    sizes = np.diff(at)
    full = np.flatnonzero(sizes)
    row = np.repeat(np.arange(len(full)), sizes[full])
    own = scores[np.arange(len(scores)), np.repeat(best, sizes)]
    fine = np.ones(len(sizes), bool)
    for k in range(scores.shape[1]):
        gain = scores[:, k] - own
        total = np.cumsum(gain)
        before = total - gain
        first = before[at[:-1][full]]
        inside, start = total - first[row], before - first[row]
        far = np.abs(inside).max() + np.abs(start).max() + 1.0
        lowest = np.minimum.accumulate(start - row * far) + row * far
        most = np.maximum.reduceat(inside - lowest, at[:-1][full])
        fine[full] &= most <= switch / 2 - 1e-6
    return fine


_NEW = "held_out boolean, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    langs = model.langs
    for part in blocks(batches):
        texts = part.column("text")
        data, offsets, starts, ends, at, begins, buckets, script = _words(texts)
        n = part.num_rows
        pred, score, spans = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
        if len(starts) and langs:
            scores = np.stack([np.add.reduceat(t[buckets], begins, dtype=np.float64) for t in model.log], axis=1) + model.script.T[script]
            total = np.zeros((n, len(langs)))
            full = np.diff(at) > 0
            total[full] = np.add.reduceat(scores, at[:-1][full])
            best = total.argmax(1)
            fine = constant_is_best(scores, at, best, SWITCH)
            ascii_letter = np.r_[0, np.cumsum(_LETTER[data] & (data < 128))]
            latin = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
            sure = np.exp((total - total.max(1, keepdims=True)) / 4)
            sure = sure.max(1) / sure.sum(1)
            for i in np.flatnonzero(full).tolist():
                a, b = int(at[i]), int(at[i + 1])
                if not latin[i] and not any(c.isalpha() for c in texts[i].as_py()):
                    continue
                origin = int(offsets[i])
                if fine[i]:
                    pred[i], score[i] = langs[best[i]], sure[i]
                    spans[i] = [{"start": int(starts[a]) - origin, "end": int(ends[b - 1]) - origin, "lang": langs[best[i]]}]
                    continue
                label = np.array(viterbi(scores[a:b], SWITCH))
                size = np.bincount(label, (ends - starts)[a:b], len(langs))
                pred[i], score[i] = langs[int(size.argmax())], size.max() / size.sum()
                first = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
                last = np.r_[first[1:], len(label)] - 1
                spans[i] = [{"start": int(starts[a + x]) - origin, "end": int(ends[a + y]) - origin, "lang": langs[label[x]]} for x, y in zip(first.tolist(), last.tolist())]
        yield widen(part, ["lang_pred", "score", "spans"], [pa.array(pred, pa.string()), score, pa.array(spans, _SPAN)])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) with held_out, lang_pred, score (0 to 1) and spans (byte offsets and language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.withColumn("held_out", held_out())
    new = _NEW.split(", ", 1)[1]
    return docs.mapInArrow(lambda batches: _predict(batches, shared.value), widened(docs.schema, new))


def op1_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("bigint").alias("n_spans"))
