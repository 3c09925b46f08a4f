"""Content-defined chunking with a gear hash, by whole arrays.

The rolling hash after a byte is a sum of table values of the last 64 bytes, shifted by age, so
all positions' hashes come from six doublings, h2n[i] = hn[i] + hn[i - n] << n. Only the first
63 positions after a restart see fewer bytes; they are hashed in a short loop.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MIN, AVG, MAX = 2 << 10, 8 << 10, 64 << 10
#: The table's seed and the masks' shift fix where cuts fall.
SEED, SHIFT = 0x5253594E43, 12


def gear_table() -> np.ndarray:
    rng = random.Random(SEED)
    return np.array([rng.getrandbits(64) for _ in range(256)], np.uint64)


GEAR = gear_table()


def _ones(bits: int) -> int:
    return ((1 << bits) - 1) << SHIFT


class Chunker:
    def __init__(self, least: int = MIN, usual: int = AVG, most: int = MAX):
        if not 0 < least <= usual <= most:
            raise ValueError("sizes must satisfy 0 < min <= avg <= max")
        self.least, self.usual, self.most = least, usual, most
        bits = usual.bit_length() - 1
        self.strict, self.lenient = _ones(bits + 2), _ones(max(bits - 2, 0))

    def cuts(self, data: bytes) -> list[int]:
        """End offsets of all chunks."""
        n = len(data)
        raw = np.frombuffer(data, np.uint8)
        hashes = GEAR[raw]
        width = 1
        while width < 64 and width < n:
            older = hashes[:-width] << np.uint64(width)
            hashes = np.r_[hashes[:width], hashes[width:] + older]
            width *= 2
        easy = np.flatnonzero((hashes & np.uint64(self.lenient)) == 0)
        hard = np.flatnonzero((hashes & np.uint64(self.strict)) == 0)
        out, start = [], 0
        while start < n:
            start = self._next(raw, hard, easy, start, n)
            out.append(start)
        return out

    def _next(self, raw: np.ndarray, hard: np.ndarray, easy: np.ndarray, start: int, n: int) -> int:
        if n - start <= self.least:
            return n
        limit = min(start + self.most, n)
        normal = min(start + self.usual, limit)
        base, h = start + self.least, 0
        for i in range(base, min(base + 63, limit)):
            h = ((h << 1) + int(GEAR[raw[i]])) & 0xFFFFFFFFFFFFFFFF
            if not h & (self.strict if i < normal else self.lenient):
                return i + 1
        at = max(base + 63, base)
        k = int(np.searchsorted(hard, at))
        if k < len(hard) and hard[k] < normal:
            return int(hard[k]) + 1
        k = int(np.searchsorted(easy, max(at, normal)))
        if k < len(easy) and easy[k] < limit:
            return int(easy[k]) + 1
        return limit

    def chunks(self, data: bytes) -> Iterator[tuple[str, int, int, bytes]]:
        """sha256, offset, size and bytes of each chunk."""
        a = 0
        for b in self.cuts(data):
            yield hashlib.sha256(data[a:b]).hexdigest(), a, b - a, data[a:b]
            a = b


CHUNKS = "path string, seq int, hash string, offset bigint, size int"


def chunk_files(files: DataFrame, sizes: tuple[int, int, int] = (MIN, AVG, MAX), with_data: bool = False) -> DataFrame:
    """One row for each chunk of files (path, data as string or binary); nothing is shuffled. Null data has no chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = Chunker(*sizes)
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = data.encode() if isinstance(data, str) else data or b""
                rows += [(path, k, h, o, s, d if with_data else None) for k, (h, o, s, d) in enumerate(chunker.chunks(data))]
            cols = [[r[k] for r in rows] for k in range(6)]
            arrays = [pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.binary()])]
            yield pa.record_batch(arrays[: 6 if with_data else 5], names=["path", "seq", "hash", "offset", "size", "data"][: 6 if with_data else 5])

    return files.select("path", "data").mapInArrow(run, CHUNKS + (", data binary" if with_data else ""))
