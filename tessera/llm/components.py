"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut


class Forest:
    """Union by smallest name, with path halving."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


#: Edges that one pass of a task takes together; the result doesn't depend on it.
_TOGETHER = 1 << 19


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of some thousand edges at a time, those that still make the same components: a star for each."""

    def stars(forest: Forest) -> pa.RecordBatch:
        rows = [(x, forest.find(x)) for x in list(forest.up)]
        rows = [r for r in rows if r[0] != r[1]]
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["u", "v"])

    forest, n = Forest(), 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
        n += batch.num_rows
        if n >= _TOGETHER:
            yield stars(forest)
            forest, n = Forest(), 0
    yield stars(forest)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b): the least node that can be reached.

    Alternating stars: each round hangs the larger neighbours of a node, then the smaller
    ones, on the least; rounds grow with the logarithm of a component's size. Each round is
    written to the shared folder. Nodes with very many neighbours only meet in sums that are
    combined before the shuffle and in joins with one row for each node, which adaptive
    execution splits.
    """
    e = cut(edges.select("a", "b").where("a <> b").mapInArrow(_contract, "u bigint, v bigint").distinct(), "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        e = cut(pairs.select("x.u", F.col("x.m").alias("v")).where("u <> v").distinct(), "stars")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
