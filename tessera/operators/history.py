"""Versioned manifests: current, history, snapshots, rollback and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current(versions: DataFrame) -> DataFrame:
    """The newest version of each path; a maximum that is combined before the shuffle."""
    return versions.groupBy("path").agg(F.max(F.struct("created", "digest", "origin", "size")).alias("x")).select("path", "x.digest", "x.created", "x.origin", "x.size")


def history(versions: DataFrame) -> DataFrame:
    order = Window.partitionBy("path").orderBy("created", "digest")
    return versions.select("path", "digest", "created", F.row_number().over(order).cast("bigint").alias("ordinal"), F.lag("digest").over(order).alias("previous"))


def rollback_target(versions: DataFrame) -> DataFrame:
    """The second newest version of each path that has one."""
    order = Window.partitionBy("path").orderBy(F.desc("created"), F.desc("digest"))
    return versions.withColumn("k", F.row_number().over(order)).where("k = 2").select("path", "digest", "created")


def as_of(versions: DataFrame, moment: Column) -> DataFrame:
    return current(versions.where(F.col("created") <= moment))


def restore_plan(snapshot: DataFrame, now: DataFrame, known: DataFrame) -> DataFrame:
    """path and what restoring ``snapshot`` does: already, restored, unknown (its version is lost) or created_since."""
    rows = snapshot.select("path", F.col("digest").alias("wanted")).join(now.select("path", F.col("digest").alias("have")), "path", "full")
    rows = rows.join(known.select(F.col("digest").alias("wanted"), F.lit(True).alias("known")).distinct(), "wanted", "left")
    action = F.when(F.col("wanted").isNull(), "created_since").when(F.col("wanted").eqNullSafe(F.col("have")), "already").when(F.col("known").isNull(), "unknown").otherwise("restored")
    return rows.select("path", "wanted", "have", action.alias("action"))


def resolve_conflicts(versions: DataFrame) -> DataFrame:
    """Of several heads of a path the largest digest wins; the others get a side path that names their origin."""
    best = versions.groupBy("path").agg(F.max("digest").alias("winner"), F.countDistinct("digest").alias("n")).where("n > 1")
    rows = versions.join(best, "path").where("digest <> winner")
    side = F.concat(F.col("path").cast("string"), F.lit(".conflict-"), "origin", F.lit("-"), F.substring("digest", 1, 8))
    return rows.select("path", "winner", F.col("digest").alias("loser"), side.alias("side_path")).distinct()


# Version vectors: maps from a node to its count, absent meaning 0.


def _count(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("bigint"))


def _some(a: Column, b: Column, test) -> Column:
    return F.exists(F.map_values(F.map_zip_with(a, b, lambda k, x, y: test(_count(x), _count(y)))), lambda v: v)


def compare(a: Column, b: Column) -> Column:
    """equal, before, after or concurrent."""
    less, more = _some(a, b, lambda x, y: x < y), _some(a, b, lambda x, y: x > y)
    return F.when(less & more, "concurrent").when(less, "before").when(more, "after").otherwise("equal")


def descends(a: Column, b: Column) -> Column:
    return ~_some(a, b, lambda x, y: y > x)


def merge(a: Column, b: Column) -> Column:
    """The pointwise maximum, without entries of 0 that only ``b`` has."""
    both = F.map_zip_with(a, b, lambda k, x, y: F.greatest(_count(x), _count(y)))
    return F.map_filter(both, lambda k, v: (v > 0) | F.map_contains_key(a, k))


def bump(vector: Column, node: Column) -> Column:
    """The vector with one more for ``node``."""
    return F.map_concat(F.map_filter(vector, lambda k, v: k != node), F.create_map(node, _count(F.try_element_at(vector, node)) + 1))
