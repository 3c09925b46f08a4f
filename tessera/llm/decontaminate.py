"""Operator 9, benchmark decontamination with a generalised suffix automaton.

The automaton takes the normalised words of all benchmark items. Documents stream their
words through it; the length of the longest match that ends at each word is
tracked, and wherever it reaches the window, the last ``WINDOW`` words are hit. Items shorter
than a window must match as a whole. A table of word pairs that occur in items
finds, by whole arrays, the stretches where a match can be long enough at all; only
these are walked word by word.

Documents are never shuffled. The benchmark is taken in blocks of at most ``BLOCK_BYTES`` of
text, so an automaton that is broadcast has a bounded size (it is built with dictionaries in the
driver, then kept as arrays, some 60 bytes for each of up to two states a word); for more than one block, the rows
with what is known so far are written to the shared folder between the passes.

In the cleaned text, hit stretches of under ``MIN_SPAN_WORDS`` words stay; they can only come from items
shorter than a window.

Edge cases: null and empty texts have no words and are clean; null and wordless items
never match; repeated items are found each; an item with a null id counts for hits, but is not
listed; an empty benchmark leaves all documents clean; the columns of the documents stay,
except for those whose names are those of the result.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import ALNUM, blocks, flat, lower, widen, widened, without_spans, word_hashes, words
from tessera.session import cut

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: Limits of the cleaning: shorter hit stretches stay; beyond this share of hit words the document goes.
MIN_SPAN_WORDS = 10
MAX_COVERAGE = 0.5


class Automaton:
    """A generalised suffix automaton over word numbers, with the items of its windows."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        data, offsets = flat(pa.array([t for _, t in items], pa.string()))
        data = lower(data)
        starts, ends, at = words(data, offsets, ALNUM)
        hashes = word_hashes(data, starts, ends)
        self.window = window
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        self.names = [i for i, _ in items]
        texts = [numbers[a:b].tolist() for a, b in zip(at, at[1:])]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for t in texts:
            last = 0
            for c in t:
                last = self._extend(last, c)
        self._freeze()
        self.least = min((min(len(t), window) for t in texts if t), default=0)
        inside = np.ones(max(len(numbers) - 1, 0), bool)
        inside[at[(at > 0) & (at < len(numbers))] - 1] = False
        self.pairs = np.unique(numbers[:-1][inside] * len(self.vocabulary) + numbers[1:][inside])
        #: Items shorter than a window, with their length, by their state.
        self.short: dict[int, list[tuple[int, int]]] = {}
        held = array("q")
        for k, t in enumerate(texts):
            for state, length, _ in self.walk(t):
                if len(t) >= window and length >= window:
                    held.append(self.shortest(state, window) << 32 | k)
            if t and len(t) < window:
                self.short.setdefault(self.shortest(state, len(t)), []).append((len(t), k))
        #: Items by the state of a window, those of a state side by side.
        both = np.unique(np.frombuffer(held, np.int64)) if held else np.zeros(0, np.int64)
        self.held = array("i", (both & 0xFFFFFFFF).astype(np.int32).tobytes())
        self.held_at = array("i", np.searchsorted(both >> 32, np.arange(len(self.length) + 1)).astype(np.int32).tobytes())

    def _freeze(self) -> None:
        """Transitions as arrays, those of a state side by side in the order of words."""
        self.first, self.word, self.target = array("i", [0]), array("i"), array("i")
        for k, own in enumerate(self.next):
            for c in sorted(own):
                self.word.append(c)
                self.target.append(own[c])
            self.first.append(len(self.word))
            self.next[k] = None
        del self.next
        self.link, self.length = array("i", self.link), array("i", self.length)

    def step(self, state: int, c: int) -> int:
        """The state after one more word, or -1."""
        first, word = self.first, self.word
        a, b = first[state], first[state + 1]
        if b - a > 1:
            a = bisect_left(word, c, a, b)
        return self.target[a] if a < b and word[a] == c else -1

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def shortest(self, state: int, size: int) -> int:
        """The state that holds the last ``size`` words of what reached ``state``."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def walk(self, numbers: list[int]) -> Iterator[tuple[int, int, int]]:
        """State and longest match after each word, and the word's place."""
        link, length, step = self.link, self.length, self.step
        state = matched = 0
        for at, c in enumerate(numbers):
            new = step(state, c)
            while new < 0 and state:
                state = link[state]
                matched = length[state]
                new = step(state, c)
            if new >= 0:
                state = new
                matched += 1
            yield state, matched, at

    def stretches(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begins and ends of runs of words in which a window can occur, and all words' numbers."""
        number = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[number] == hashes
        if self.least < 2:
            joined = known.copy()
            reach = 0
        else:
            joined = known[:-1] & known[1:]
            inner = at[1:-1]
            joined[inner[(inner > 0) & (inner < len(hashes))] - 1] = False
            i = np.flatnonzero(joined)
            key = number[i] * len(self.vocabulary) + number[i + 1]
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined[i] = self.pairs[place] == key
            reach = 1
        if reach == 0:  # runs end with their text
            edges = np.zeros(len(hashes) + 1, bool)
            edges[at] = True
            begins = np.flatnonzero(joined & (np.r_[True, ~joined[:-1]] | edges[:-1]))
            ends = np.flatnonzero(joined & (np.r_[~joined[1:], True] | edges[1:])) + 1
        else:
            step = np.diff(np.r_[0, joined.astype(np.int8), 0])
            begins, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + 1
        enough = ends - begins >= self.least
        return begins[enough], ends[enough], number

    def hits(self, numbers: list[int]) -> Iterator[tuple[int, int, "array[int] | list[int]", int]]:
        """(begin, end, items, longest match) of windows that occur in a run of words."""
        for state, matched, at in self.walk(numbers):
            if matched >= self.window:
                p = self.shortest(state, self.window)
                yield at + 1 - self.window, at + 1, self.held[self.held_at[p] : self.held_at[p + 1]], matched
            if self.short:
                p = state
                while p > 0:
                    for size, k in self.short.get(p, ()):
                        if size <= matched:
                            yield at + 1 - size, at + 1, [k], matched
                    p = self.link[p]


_NEW = "n_words bigint, n_hit bigint, items array<string>, longest_match bigint, hit_words binary, hit_spans array<struct<start:bigint,end:bigint>>, cleaned_text string, kept boolean"
_NAMES = ["n_words", "n_hit", "items", "longest_match", "hit_words", "hit_spans", "cleaned_text", "kept"]
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch], automaton: Automaton, earlier: bool, text_out: bool) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches):
        data, offsets = flat(part.column("text"))
        starts, ends, at = words(lower(data), offsets, ALNUM)
        n = part.num_rows
        hit = np.zeros(len(starts), bool)
        found: dict[int, set[str]] = {}
        longest = np.zeros(n, np.int64)
        if earlier:
            for i, x in enumerate(part.column("hit_words").to_pylist()):
                if x:
                    hit[at[i] : at[i + 1]] = np.unpackbits(np.frombuffer(x, np.uint8), count=at[i + 1] - at[i])
                    found[i] = set(part.column("items")[i].as_py())
                    longest[i] = part.column("longest_match")[i].as_py()
        if automaton.least and len(starts):
            hashes = word_hashes(lower(data), starts, ends)
            begins, stops, number = automaton.stretches(hashes, at)
            rows = np.searchsorted(at, begins, "right") - 1
            for row, a, b in zip(rows.tolist(), begins.tolist(), stops.tolist()):
                for x, y, items, matched in automaton.hits(number[a:b].tolist()):
                    hit[a + x : a + y] = True
                    found.setdefault(row, set()).update(automaton.names[k] for k in items)
                    longest[row] = max(longest[row], matched)
        n_words = np.diff(at)
        total = np.r_[0, np.cumsum(hit)]
        n_hit = total[at[1:]] - total[at[:-1]]
        spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        cleaned, packed = part.column("text").to_pylist() if text_out else [None] * n, [None] * n
        for i in np.flatnonzero(n_hit).tolist():
            own = hit[at[i] : at[i + 1]]
            packed[i] = np.packbits(own).tobytes()
            step = np.diff(np.r_[0, own.astype(np.int8), 0])
            a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            long = b - a >= min(MIN_SPAN_WORDS, automaton.window)
            spans[i] = list(zip((starts[at[i] + a] - offsets[i]).tolist(), (ends[at[i] + b - 1] - offsets[i]).tolist()))
            if text_out:
                gone = [s for s, x in zip(spans[i], long.tolist()) if x]
                cleaned[i] = without_spans(data[offsets[i] : offsets[i + 1]].tobytes(), gone).decode("utf-8", "ignore")
        items = [sorted(x for x in found.get(i, ()) if x is not None) for i in range(n)]
        yield widen(part, _NAMES, [
            n_words, n_hit, pa.array(items, pa.list_(pa.string())), longest, pa.array(packed, pa.binary()),
            pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS), pa.array(cleaned, pa.string()), n_hit <= MAX_COVERAGE * n_words,
        ])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_out: bool = True) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids, sorted), longest_match, hit_words (a bit each), hit_spans (byte offsets), cleaned_text and kept."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / BLOCK_BYTES * 1.5)) if size > BLOCK_BYTES else 1
    schema = widened(docs.schema, _NEW)
    for b in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        automaton = spark.sparkContext.broadcast(Automaton([tuple(r) for r in block.collect()], window))
        if b:
            docs = cut(docs, "decontaminated")
        docs = docs.mapInArrow(lambda batches, a=automaton, e=b > 0: _scan(batches, a.value, e, text_out), schema)
    return docs


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text_out=False)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS g
      FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(len(w) - {WINDOW} + 2, 2))) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM k),
v AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n)),
m AS (SELECT doc_id, i, v.n, item_id FROM v JOIN k ON v.g = k.g AND v.n = k.n),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN q USING (doc_id)"""
