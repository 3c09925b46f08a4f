"""Operator 6, packing: order-preserving dynamic programming over cut points.

The documents of a partition, in their order, are one stream of token ids, each document
ended by id 0. Windows of at most ``size`` ids are cut from the stream. Cuts are wanted
at document ends (free) or sentence ends (``SENTENCE_COST``); a window may also be filled
to the brim within a sentence (``MIDDLE_COST``). The plan with the least padding plus
cut costs comes from f(i) = min over j of f(j) + padding(j, i) + cost(i). As padding is
``size`` less the length, the minimum is over f(j) + j in a sliding range, which a
monotone queue gives in constant time. A cut within a sentence is only worth making
where it fills a window, so such states are added as their predecessor leaves the queue.

There is no shuffle: each partition is packed as its rows stream by, a few MB of text
at a time, and the open end of one block is the start of the next. What remains at the
end of a partition is cut into powers of two, which need no padding. A retried task
gives the same rows, as sequence ids hold the partition's number.

Edge cases: a null or empty text is one piece of the final id alone; a document longer
than a window spreads over several; repeated rows are packed each; an empty table gives
no rows; a null doc_id stays null, each such row being a document of its own; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import blocks, flat

SIZE = 1024
SENTENCE_COST = 1
MIDDLE_COST = 3

SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def byte_of_symbol() -> dict[str, int]:
    """The byte that each printable symbol of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: UTF-8 of the white space beyond ASCII that a vocabulary's splitting pattern knows.
_WIDE_SPACES = np.array([int.from_bytes(chr(c).encode().ljust(3, b"\0"), "big") for c in [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]])


def awkward(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that don't fall apart at their spaces: with white space after a space, a space at the end, ``<|``, or nothing at all."""
    padded = np.r_[data, np.zeros(3, np.uint8)]
    space = np.flatnonzero(data == 0x20)
    after = padded[space + 1]
    odd = (after <= 0x20) & (after >= 0x1C) | (after <= 0x0D) & (after >= 0x09)
    wide = np.flatnonzero(np.isin(after, [0xC2, 0xE1, 0xE2, 0xE3]))
    code = sum(padded[space[wide] + k].astype(np.int64) << 8 * (3 - k) for k in (1, 2, 3))
    odd[wide] = np.isin(code, _WIDE_SPACES) | np.isin(code & 0xFFFF00, _WIDE_SPACES)
    angle = np.flatnonzero(data == 0x3C)
    at = np.r_[space[odd], angle[padded[angle + 1] == 0x7C]]
    found = np.diff(offsets) == 0
    found[np.searchsorted(offsets, at, "right") - 1] = True
    full = np.flatnonzero(~found)
    found[full] = data[offsets[1:][full] - 1] == 0x20
    return found


class WordTokens:
    """Token ids of texts, equal to those of the vocabulary file's own tokenizer.

    A byte-level tokenizer never joins a word with the word before the space, so each
    different ``" word"`` of a block is encoded once, all in one call, and they are told
    apart by the tokens' byte lengths. Texts with runs of white space or possible
    special tokens are encoded whole. Nothing is kept from one block to the next.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        model = json.loads(open(path, encoding="utf-8").read())
        symbols = byte_of_symbol()
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(symbols[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        coder = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._whole = lambda text: coder.encode_to_numpy(text, allowed_special="all").astype(np.uint32)
        count = max([*ranks.values(), *special.values()]) + 1
        names: list[bytes] = [b""] * count
        for token, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            names[i] = token
        self._bytes = np.array([len(x) for x in names], np.int64)
        stop, gap = re.compile(rb"[.!?]['\")\]]*$"), re.compile(rb"^\s")
        self.stops = np.array([bool(stop.search(x)) for x in names])
        self.gaps = np.array([bool(gap.match(x)) for x in names])
        self.breaks = np.array([b"\n" in x for x in names])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), one after the other, and the n + 1 offsets into them."""
        texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
        odd = awkward(*flat(texts))
        words = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        at, words = words.offsets.to_numpy(), words.flatten()
        first = np.zeros(len(words), bool)
        first[at[:-1]] = True
        heads, words = (words.filter(pa.array(x)).dictionary_encode() for x in (first, ~first))
        known = words.dictionary
        tables = []  # ids and their bounds: of " word" once each, of first words, of awkward texts
        if len(known):
            data, bounds = flat(known)
            ids = self._whole(np.insert(data, bounds[:-1], 0x20).tobytes().decode())
            ends = bounds[1:] + np.arange(1, len(bounds))
            tables.append((ids, np.r_[0, np.searchsorted(np.cumsum(self._bytes[ids]), ends) + 1]))
        else:
            tables.append((np.zeros(0, np.uint32), np.zeros(1, np.int64)))
        for some in (heads.dictionary, texts.filter(pa.array(odd))):
            each = [self._whole(x) for x in some.to_pylist()]
            tables.append((np.concatenate([np.zeros(0, np.uint32), *each]), np.r_[0, np.cumsum([len(x) for x in each])].astype(np.int64)))
        base = np.cumsum([0, *(len(x) for x, _ in tables)])
        ids = np.concatenate([x for x, _ in tables])
        words_of = np.ones(len(odd), np.int64)
        words_of[~odd] = np.diff(at)
        row = np.repeat(odd, words_of)  # over words, an awkward text being one
        begin, count = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
        plain = np.flatnonzero(~row)
        for place, k, (_, cuts), b in zip((plain[~first], plain[first], np.flatnonzero(row)), (words.indices.to_numpy(), heads.indices.to_numpy(), np.arange(int(odd.sum()))), tables, base):
            begin[place], count[place] = cuts[k] + b, cuts[k + 1] - cuts[k]
        total = np.r_[0, np.cumsum(count)]
        where = np.arange(total[-1]) + np.repeat(begin - total[:-1], count)
        return ids[where], total[np.r_[0, np.cumsum(words_of)]]


_LOADED: dict[str, WordTokens] = {}


def tokens(path: str) -> WordTokens:
    """The tokenizer, loaded once in a worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def plan_cuts(at: np.ndarray, cost: np.ndarray, size: int, middle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """States of the plan: position, f + position, predecessor; and the queue, at the end, of states not beaten by a later one.

    ``at`` are ascending candidates from 0. Besides them a state can be ``size`` ids after
    another one: a window filled to the brim.

    f + position is ``size`` times the windows plus the costs so far. So the monotone queue falls
    apart into one run for each number of windows, ascending in costs and positions, and a
    whole run moves on at once: within a state's reach only the last candidate of each cost is not beaten
    by a later one. A run has a place for each sum of costs, with the furthest state that costs no
    more. It loses its head where a state behind has an f lower by ``size`` or more: any plan from the
    head, joined by one from behind it, loses less than a window of padding by that.
    """
    at, cost = np.asarray(at), np.asarray(cost)
    begin, last = int(at[0]), int(at[-1])
    kinds = []  # for each cost: the last candidate up to each position, or 0, in the upper half
    for c in sorted(set(cost[1:].tolist())):
        before = np.zeros(last + 1, np.int64)
        here = at[1:][cost[1:] == c]
        before[here] = here << 32
        kinds.append((int(c), np.maximum.accumulate(before)))
    dearest = max([middle, *(c for c, _ in kinds)])
    # a run's states: position in the upper half, number of the predecessor in the lower one
    run, low, done, best, w = np.array([begin << 32]), 0, 0, None, 0
    levels = [(run, low, w)]
    while best is None or size * (w + 1) + low < best:
        w += 1
        n = len(run)
        number = np.arange(done, done + n)
        done += n
        reach = np.minimum((run >> 32) + size, last)
        new = np.zeros(n + dearest, np.int64)
        for c, before in [*kinds, (middle, None)]:
            to = (reach << 32 if before is None else before[reach]) + number
            np.maximum(new[c : c + n], to, out=new[c : c + n])
        new = np.maximum.accumulate(new)
        hi = int(np.searchsorted(new, new[-1])) + 1
        f = np.arange(hi) - (new[:hi] >> 32)
        lo = int(np.argmax(f < f.min() + size))
        run, low = new[lo:hi], low + lo
        levels.append((run, low, w))
        if run[-1] >> 32 == last:
            ended = size * w + low + len(run) - 1
            best = ended if best is None else min(best, ended)
    states = np.concatenate([x for x, _, _ in levels])
    value = np.concatenate([size * k + m + begin + np.arange(len(x)) for x, m, k in levels])
    place, back = states >> 32, states & 0xFFFFFFFF
    near = np.flatnonzero(place >= last - size)
    order = near[np.lexsort((value[near], -place[near]))]  # from the end: of one place the cheapest first
    least = np.minimum.accumulate(np.r_[np.iinfo(np.int64).max, value[order][:-1]])
    return place, value, back, order[value[order] < least][::-1]


def _candidates(ids: np.ndarray, ends: np.ndarray, tok: WordTokens) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions with costs; ``ends`` are the ends of documents in ``ids``."""
    cost = np.full(len(ids) + 1, -1, np.int64)
    sentence = tok.breaks[ids]
    sentence[:-1] |= tok.stops[ids[:-1]] & tok.gaps[ids[1:]]
    cost[1:][sentence] = SENTENCE_COST
    cost[ends] = 0
    cost[[0, -1]] = 0
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def _cuts(ids: np.ndarray, ends: np.ndarray, tok: WordTokens, size: int, last: bool) -> list[int]:
    """Ascending ends of windows; what follows the last one is left for the next block."""
    at, cost = _candidates(ids, ends, tok)
    place, value, back, queue = plan_cuts(at, cost, size, MIDDLE_COST)
    k = int(queue[0])
    cuts, p = [], int(place[k])
    while k:
        cuts.append(int(place[k]))
        k = int(back[k])
    cuts.reverse()
    if last:  # powers of two need no padding
        rest = len(ids) - p
        for bit in range(rest.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                p += 1 << bit
                cuts.append(p)
    return cuts


_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def _pack_stream(batches: Iterator[pa.RecordBatch], path: str, size: int) -> Iterator[pa.RecordBatch]:
    tok, sequence = tokens(path), TaskContext.get().partitionId() << 40
    schema = pa.schema(_FIELDS)
    # of what is not yet packed: token ids; documents with a null where there is no id; their ids before, length, ids
    open_ids, open_docs, open_rows = np.zeros(0, np.uint32), pa.array([], pa.int64()), np.zeros((0, 3), np.int64)

    def step(ids: np.ndarray, docs: pa.Array, rows: np.ndarray, last: bool) -> pa.RecordBatch:
        nonlocal open_ids, open_docs, open_rows, sequence
        begins = np.concatenate(([0], np.cumsum(rows[:, 1])))
        whole = rows[:, 0] + rows[:, 1] == rows[:, 2]
        cuts = np.array(_cuts(ids, begins[1:][whole], tok, size, last), np.int64)
        done = int(cuts[-1]) if len(cuts) else 0
        edges = np.unique(np.concatenate((begins[begins < done], cuts[cuts < done], [0, done])))
        a, b = edges[:-1], edges[1:]
        row = np.searchsorted(begins, a, "right") - 1
        window = np.searchsorted(cuts, a, "right")
        starts = np.concatenate(([0], cuts))
        pieces = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((4 * edges).astype(np.int32)), pa.py_buffer(ids[:done])])
        batch = pa.record_batch([docs.take(pa.array(row)), rows[row, 0] + a - begins[row], b - a, pieces, rows[row, 2], sequence + window, a - starts[window]], schema=schema)
        sequence += len(cuts)
        k = int(np.searchsorted(begins, done, "right")) - 1
        open_ids, open_docs, open_rows = ids[done:].copy(), docs.take(pa.array(np.arange(k, len(docs)))), rows[k:].copy()
        if len(open_rows):
            open_rows[0, 0] += done - begins[k]
            open_rows[0, 1] -= done - begins[k]
        return batch

    for part in blocks(batches):
        got, at = tok.encode(part.column("text"))
        n = np.diff(at) + 1
        ids = np.insert(got, at[1:], 0)
        docs = pa.concat_arrays([open_docs, part.column("doc_id").cast(pa.int64())])
        yield step(np.concatenate([open_ids, ids]), docs, np.concatenate([open_rows, np.stack([np.zeros_like(n), n, n], axis=1)]), False)
    if len(open_ids):
        yield step(open_ids, open_docs, open_rows, True)


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _pack_stream(batches, tokenizer, size), SCHEMA)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokenizer_path()).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
