"""Bloom filters of node stores: built in pieces of the input, joined by OR."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def sizing(n: int, p: float) -> tuple[int, int]:
    """Bits and hashes for n items at a false positive rate of p."""
    m = math.ceil(-max(1, n) * math.log(p) / math.log(2) ** 2)
    return m, max(1, round(m / max(1, n) * math.log(2)))


def indices(item: str, m: int, k: int) -> list[int]:
    d = hashlib.sha256(item.encode()).digest()
    a, b = int.from_bytes(d[:8], "big"), int.from_bytes(d[8:16], "big") | 1
    return [(a + i * b) % m for i in range(k)]


class Bloom:
    def __init__(self, m: int, k: int, bits: bytes | None = None):
        self.m, self.k = m, k
        self.bits = np.zeros((m + 7) // 8, np.uint8) if bits is None else np.frombuffer(bits, np.uint8).copy()

    def add(self, item: str) -> None:
        for i in indices(item, self.m, self.k):
            self.bits[i >> 3] |= 1 << (i & 7)

    def __contains__(self, item: str) -> bool:
        return all(self.bits[i >> 3] >> (i & 7) & 1 for i in indices(item, self.m, self.k))

    def nbytes(self) -> int:
        return len(self.bits)

    def to_dict(self) -> dict:
        """The filter as values that JSON can carry."""
        return {"m": self.m, "k": self.k, "bits": self.bits.tobytes().hex()}

    @classmethod
    def from_dict(cls, d: dict) -> Bloom:
        return cls(d["m"], d["k"], bytes.fromhex(d["bits"]))

    def fill_ratio(self) -> float:
        return int(np.unpackbits(self.bits).sum()) / self.m

    def false_positive_rate(self) -> float:
        return self.fill_ratio() ** self.k


def build(items: DataFrame, expected: int, p: float = 0.02) -> DataFrame:
    """node, bits over items (node, item): each task makes its parts, which then are joined for each node."""
    m, k = sizing(max(64, expected), p)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[int, Bloom] = {}
            for node, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own.setdefault(node, Bloom(m, k)).add(item)
            yield pa.record_batch([pa.array(list(own), pa.int64()), pa.array([b.bits.tobytes() for b in own.values()], pa.binary())], names=["node", "bits"])

    def join(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()])
        return pa.table({"node": pa.array([table.column("node")[0].as_py()], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

    return items.select("node", "item").mapInArrow(parts, "node bigint, bits binary").groupBy("node").applyInArrow(join, "node bigint, bits binary")


def probe(items: DataFrame, filters: DataFrame, expected: int, p: float = 0.02) -> DataFrame:
    """items (node, item) with maybe: whether the node's filter has the item. Each filter meets its node's items only."""
    m, k = sizing(max(64, expected), p)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Bloom(m, k, right.column("bits")[0].as_py()) if right.num_rows else Bloom(m, k)
        return left.append_column("maybe", pa.array([x in own for x in left.column("item").to_pylist()], pa.bool_()))

    return items.select("node", "item").groupBy("node").cogroup(filters.groupBy("node")).applyInArrow(run, "node bigint, item string, maybe boolean")
