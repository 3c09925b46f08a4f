"""Systematic Reed-Solomon codes over GF(256), by table lookups on whole shards."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

POLYNOMIAL = 0x11D


def _tables() -> tuple[np.ndarray, np.ndarray]:
    exp, log, x = np.zeros(510, np.uint8), np.zeros(256, np.int64), 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x = x << 1 ^ (POLYNOMIAL if x & 128 else 0)
    return exp, log


EXP, LOG = _tables()


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where((a == 0) | (b == 0), 0, EXP[LOG[a] + LOG[b]]).astype(np.uint8)


def inverse(a: np.ndarray) -> np.ndarray:
    return EXP[255 - LOG[a]]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product; rows of ``b`` may be long shards."""
    out = np.zeros((len(a), b.shape[1]), np.uint8)
    for j in range(a.shape[1]):
        out ^= mul(a[:, j, None], b[None, j])
    return out


def solve(m: np.ndarray) -> np.ndarray:
    """The inverse of a square matrix, by elimination."""
    n = len(m)
    work = np.concatenate([m.astype(np.uint8), np.eye(n, dtype=np.uint8)], axis=1)
    for c in range(n):
        p = c + int(np.flatnonzero(work[c:, c])[0])
        work[[c, p]] = work[[p, c]]
        work[c] = mul(work[c], inverse(work[c, c]))
        others = np.arange(n) != c
        work[others] ^= mul(work[others, c][:, None], work[c][None])
    return work[:, n:]


@cache
def generator(k: int, m: int) -> np.ndarray:
    """k + m rows, the first k the identity: a Cauchy matrix times the inverse of its top."""
    if k < 1 or m < 0 or 2 * k + m > 256:
        raise ValueError("need k >= 1, m >= 0 and 2k + m <= 256")
    cauchy = inverse(np.arange(k, 2 * k + m)[:, None] ^ np.arange(k)[None])
    return product(cauchy, solve(cauchy[:k]))


def encode(data: bytes, k: int, m: int) -> list[bytes]:
    if k < 1 or m < 0:
        raise ValueError("need k >= 1 and m >= 0")
    size = max(1, -(-len(data) // k))
    shards = np.frombuffer(data.ljust(size * k, b"\0"), np.uint8).reshape(k, size)
    rest = product(generator(k, m)[k:], shards) if m else np.zeros((0, size), np.uint8)
    return [x.tobytes() for x in [*shards, *rest]]


def decode(k: int, m: int, shards: dict[int, bytes]) -> bytes:
    """All data bytes, padding included, from any k of the shards."""
    have = sorted(i for i in shards if 0 <= i < k + m)[:k]
    if len(have) < k:
        raise ValueError(f"need {k} fragments, have {len(have)}")
    known = np.stack([np.frombuffer(shards[i], np.uint8) for i in have])
    return product(solve(generator(k, m)[have]), known).tobytes()


def encode_files(files: DataFrame, k: int, m: int) -> DataFrame:
    """path, idx, fragment of each file (path, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = data.encode() if isinstance(data, str) else data or b""
                own = encode(data, k, m)
                yield pa.record_batch([pa.array([path] * len(own), pa.string()), pa.array(range(len(own)), pa.int32()), pa.array(own, pa.binary()), pa.array([len(data)] * len(own), pa.int64())], names=["path", "idx", "fragment", "size"])

    return files.select("path", "data").mapInArrow(run, "path string, idx int, fragment binary, size bigint")


def decode_files(fragments: DataFrame, k: int, m: int) -> DataFrame:
    """path, data from k or more fragments of each path; with fewer, data is null."""

    def run(table: pa.Table) -> pa.Table:
        shards = dict(zip(table.column("idx").to_pylist(), table.column("fragment").to_pylist()))
        size = table.column("size")[0].as_py()
        data = decode(k, m, shards)[:size] if len(shards) >= k else None
        return pa.table({"path": pa.array([table.column("path")[0].as_py()], pa.string()), "data": pa.array([data], pa.binary())})

    return fragments.groupBy("path").applyInArrow(run, "path string, data binary")
