"""Whole texts as flat byte arrays: the ground under the vectorised operators.

Arrow hands a batch of strings over as one byte buffer with offsets. The helpers
here cut batches into blocks of bounded size (a single longer text makes a block of
its own), find words with a byte table and hash words and shingles without a
Python loop over rows. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


#: One scrambled value for each byte, for polynomial hashes.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * _MULT)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of words `[^\x20\x09-\x0D]+`.
VISIBLE = np.ones(256, bool)
VISIBLE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; every other byte as it is."""
    return _LOWER[data]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets into them."""
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    n, buffers = len(texts), texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, texts.offset * 8)
    if buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system: workers are kept for later tasks, and those of several stages live side by side."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have about ``limit`` bytes; one longer text is one slice."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        part = np.cumsum(lengths) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
            give_back()


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 offsets of texts into the words.

    A word never crosses a text's end.
    """
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, inside
    after = np.append(inside, False)
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def powers(n: int, base: int = 0x9FB21C651E98DF25) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n."""
    out = np.empty(max(n, 1), U64)
    out[0], done = 1, 1
    step = base
    while done < len(out):
        k = min(done, len(out) - done)
        out[done : done + k] = out[:k] * U64(step)
        step = step * step % 2**64
        done += k
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each word's bytes."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    within = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    at = within + np.repeat(starts, lengths)
    values = BYTE_VALUE[data[at]] * powers(int(lengths.max()))[within]
    return mix(np.add.reduceat(values, first) + lengths.astype(U64))


def windows(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of ``size`` words within a text, and where each text's hashes begin.

    A text of fewer words, but not none, has one hash, of all its words.
    """
    counts = np.diff(offsets)
    if not len(hashes):
        return np.zeros(0, U64), np.zeros(len(counts) + 1, np.int64)
    weight = powers(size, 0xC2B2AE3D27D4EB4F)
    total = np.zeros(len(hashes), U64)
    for k in range(min(size, len(hashes))):
        total[: len(hashes) - k] += hashes[k:] * weight[k]
    full = np.maximum(counts - size + 1, 0)
    out_counts = np.where(counts >= size, full, np.minimum(counts, 1))
    out = np.concatenate(([0], np.cumsum(out_counts)))
    at = np.arange(out[-1]) - np.repeat(out[:-1], out_counts) + np.repeat(offsets[:-1], out_counts)
    result = total[at]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        a, b = offsets[i], offsets[i + 1]
        result[out[i]] = (hashes[a:b] * weight[: b - a]).sum() + U64(int(b - a))
    return mix(result), out


def widened(schema, new: str):
    """A Spark schema: the input's columns, then those of ``new``; the latter win a clash of names."""
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(new)
    names = {f.name.lower() for f in added}
    return StructType([f for f in schema if f.name.lower() not in names] + list(added))


def widen(part: pa.RecordBatch, names: list[str], arrays: list) -> pa.RecordBatch:
    """The rows of ``part`` with further columns, which win a clash of names."""
    taken = {n.lower() for n in names}
    keep = [i for i, n in enumerate(part.schema.names) if n.lower() not in taken]
    arrays = [a if isinstance(a, pa.Array) else pa.array(a) for a in arrays]
    return pa.RecordBatch.from_arrays([part.column(i) for i in keep] + arrays, names=[part.schema.names[i] for i in keep] + names)


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside of ascending, disjoint [start, end) spans."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)
