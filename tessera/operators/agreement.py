"""Who agrees with whom: namespace roots and configuration keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import merkle


def drift(labelled: DataFrame) -> DataFrame:
    """Each node that differs from the majority on a label: label, majority_hash (null: the key is absent), majority_count, node, hash.

    A node without the label counts as a group of its own; ties go to the group that the first node is in.
    """
    every = labelled.select("label").distinct().crossJoin(labelled.select("node").distinct())  # labels times nodes is the size of the answer's table
    rows = every.join(labelled.select("label", "node", "hash"), ["label", "node"], "left")
    groups = rows.groupBy("label", "hash").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    order = Window.partitionBy("label").orderBy(F.desc("n"), "first")
    best = groups.withColumn("k", F.row_number().over(order)).where("k = 1").select("label", F.col("hash").alias("majority_hash"), F.col("n").alias("majority_count"))
    return rows.join(best, "label").where(~F.col("hash").eqNullSafe(F.col("majority_hash"))).select("label", "majority_hash", "majority_count", "node", "hash")


def consistency(roots: DataFrame) -> DataFrame:
    """node, root, and whether the node is with the majority root (ties: the one the first node has)."""
    groups = roots.groupBy("root").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    best = groups.agg(F.max_by("root", F.struct("n", -F.col("first"))).alias("majority"), F.count("*").alias("n_roots"))
    return roots.join(F.broadcast(best), how="cross").select("node", "root", "majority", "n_roots", (F.col("root") == F.col("majority")).alias("agrees"))  # best is one row


def namespace_roots(labelled: DataFrame) -> DataFrame:
    """The Merkle root of all that a node has (node, label, hash)."""
    return merkle.roots(labelled.select("node", F.col("label").alias("key"), F.col("hash").alias("value")), "node")
