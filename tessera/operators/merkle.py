"""Merkle summaries of a namespace and the comparison of two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAVES = 256
EMPTY = "0" * 64
_END = "\x1f"


def bucket(key: Column, leaves: int = LEAVES) -> Column:
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") % leaves


def leaves(entries: DataFrame, n: int = LEAVES) -> DataFrame:
    """idx and hash of all ``n`` leaves over entries (key, value), empty ones included.

    Each bucket is hashed in order of its keys; there are n groups, so n is to grow with the namespace.
    """
    spark = entries.sparkSession
    part = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "value"))), lambda e: F.concat(e["key"], F.lit(_END), e["value"], F.lit(_END))), "")
    full = entries.withColumn("idx", bucket(F.col("key"), n)).groupBy("idx").agg(F.sha2(part, 256).alias("hash"))
    return spark.range(n).select(F.col("id").alias("idx")).join(full, "idx", "left").select("idx", F.coalesce("hash", F.lit(EMPTY)).alias("hash"))


def levels(leaf_rows: DataFrame, n: int = LEAVES) -> DataFrame:
    """level, idx, hash from the leaves (level 0) to the root; a level is half of the one below."""
    out = level = leaf_rows.select(F.lit(0).alias("level"), "idx", "hash")
    k = 0
    while n > 1:
        k, n = k + 1, n // 2
        two = F.sha2(F.concat(F.max(F.when(F.col("idx") % 2 == 0, F.col("hash"))), F.lit(_END), F.max(F.when(F.col("idx") % 2 == 1, F.col("hash"))), F.lit(_END)), 256)
        level = level.groupBy(F.floor(F.col("idx") / 2).alias("up")).agg(two.alias("hash")).select(F.lit(k).alias("level"), F.col("up").alias("idx"), "hash")
        out = out.unionByName(level)
    return out


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Leaves of two summaries whose hashes differ."""
    other = b.select("idx", F.col("hash").alias("other"))
    return a.join(other, "idx", "full").where(~F.col("hash").eqNullSafe(F.col("other"))).select("idx")


def differing_by_level(a: DataFrame, b: DataFrame, n: int = LEAVES) -> DataFrame:
    """Leaves (idx) of two trees' levels (level, idx, hash) reached from the root through differing nodes only.

    Trees of different depth differ in all leaves of the first.
    """
    tops = [x.agg(F.max("level")).first()[0] for x in (a, b)]
    if tops[0] != tops[1]:
        return a.where("level = 0").select("idx")
    other = b.select("level", "idx", F.col("hash").alias("other"))
    bad = a.join(other, ["level", "idx"]).where("hash <> other").select("level", "idx")
    # a leaf counts if it and all its ancestors differ: one row for each of them meets at the leaf
    span = F.sequence((F.col("idx") * F.expr("1 << level")).cast("bigint"), ((F.col("idx") + 1) * F.expr("1 << level") - 1).cast("bigint"))
    return bad.select(F.explode(span).alias("idx"), "level").groupBy("idx").agg(F.count("*").alias("n")).where(F.col("n") == tops[0] + 1).select("idx")


def round_of(buckets: DataFrame, limit: int = 16) -> DataFrame:
    """The buckets that one round of repair asks for."""
    return buckets.orderBy("idx").limit(limit)


def roots(entries: DataFrame, by: str, n: int = LEAVES) -> DataFrame:
    """One Merkle root for each value of ``by`` over its entries (by, key, value). A tree of n leaves is one array in a row."""
    part = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "value"))), lambda e: F.concat(e["key"], F.lit(_END), e["value"], F.lit(_END))), "")
    full = entries.withColumn("idx", bucket(F.col("key"), n).cast("int")).groupBy(by, "idx").agg(F.sha2(part, 256).alias("hash"))
    rows = full.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("idx", "hash"))).alias("m"))
    rows = rows.withColumn("level", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(EMPTY))))
    while n > 1:
        n //= 2
        two = lambda i: F.sha2(F.concat(F.get("level", 2 * i), F.lit(_END), F.get("level", 2 * i + 1), F.lit(_END)), 256)
        rows = rows.withColumn("level", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), two))
    return rows.select(by, F.get("level", F.lit(0)).alias("root"))


def divergent_keys(local: DataFrame, remote: DataFrame, n: int = LEAVES) -> DataFrame:
    """Keys of the remote entries that are absent or different here, looked for in differing buckets only."""
    idx = differing(leaves(local, n), leaves(remote, n))
    few = remote.withColumn("idx", bucket(F.col("key"), n)).join(idx, "idx", "left_semi")
    rows = few.join(local.select("key", F.col("value").alias("mine")), "key", "left")
    return rows.where(~F.col("value").eqNullSafe(F.col("mine"))).select("key", "idx", F.when(F.col("mine").isNull(), "absent").otherwise("different").alias("why"))
