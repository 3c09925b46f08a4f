"""Bounded training samples outside of the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by ``FOLDS``; true for a null id, which nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def sampled(rows: DataFrame, label: str, bound: int, doc_id: str = "doc_id") -> DataFrame:
    """Rows outside of the held-out fold, about ``bound`` at most of each label, chosen by a hash of the id."""
    rows = rows.where(~held_out(doc_id) & F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), min(1.0, bound / n)).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(F.col(doc_id), F.lit(11)), F.lit(1 << 30)) < share * (1 << 30))
