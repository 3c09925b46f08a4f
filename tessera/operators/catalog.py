"""Chunk catalogs: dedup accounting, residency, missing sets and range reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_chunks(files: DataFrame) -> DataFrame:
    """One row for each line of a file: path, origin, seq, hash, size."""
    lines = files.select("path", "origin", F.posexplode(F.split("data", "\n")).alias("seq", "line"))
    return lines.select("path", "origin", "seq", F.sha2("line", 256).alias("hash"), F.octet_length("line").cast("bigint").alias("size"))


def catalog(chunks: DataFrame) -> DataFrame:
    """Chunks, different chunks and bytes of each path."""
    each = chunks.groupBy("path", "hash").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return each.groupBy("path").agg(F.sum("n").alias("n_chunks"), F.count("*").alias("n_distinct"), F.sum("bytes").alias("bytes"))


def dedup_ratio(chunks: DataFrame, by: str) -> DataFrame:
    """Logical and physical bytes and their ratio (1.0 where nothing is stored); copies collapse before the second shuffle."""
    each = chunks.groupBy(by, "hash").agg(F.sum("size").alias("logical"), F.max("size").alias("physical"))
    total = each.groupBy(by).agg(F.sum("logical").alias("logical_bytes"), F.sum("physical").alias("physical_bytes"))
    return total.withColumn("ratio", F.round(F.coalesce(F.try_divide("logical_bytes", "physical_bytes"), F.lit(1.0)), 6))


# Bounds of file sizes with the least, usual and largest chunk.
PROFILES = [(8 << 20, (2 << 10, 8 << 10, 64 << 10)), (256 << 20, (24 << 10, 64 << 10, 512 << 10)), (4 << 30, (192 << 10, 512 << 10, 4 << 20)), (None, (384 << 10, 1 << 20, 8 << 20))]


def chunk_profile(size: Column) -> Column:
    """min_size, avg_size and max_size for a file of this size."""
    out = None
    for bound, sizes in PROFILES:
        value = F.struct(*(F.lit(v).cast("bigint").alias(n) for n, v in zip(("min_size", "avg_size", "max_size"), sizes)))
        if bound is None:
            return out.otherwise(value)
        out = (F if out is None else out).when(size <= bound, value)
    return out


def residency(interest: DataFrame, manifests: DataFrame, holdings: DataFrame) -> DataFrame:
    """For (node, file): chunks held and wanted; PHANTOM, PARTIAL or RESIDENT."""
    wanted = manifests.select("file", "hash").distinct()
    held = holdings.select("node", "hash", F.lit(1).alias("has"))
    rows = interest.join(wanted, "file").join(held, ["node", "hash"], "left")
    out = rows.groupBy("node", "file").agg(F.count("has").alias("have"), F.count("*").alias("want"))
    return out.withColumn("state", F.when(F.col("have") == F.col("want"), "RESIDENT").when(F.col("have") > 0, "PARTIAL").otherwise("PHANTOM"))


def missing(wanted: DataFrame, holdings: DataFrame) -> DataFrame:
    """Wanted (node, hash) that a node's store lacks."""
    return wanted.select("node", "hash").distinct().join(holdings, ["node", "hash"], "left_anti")


def present(wanted: DataFrame, holdings: DataFrame) -> DataFrame:
    return wanted.select("node", "hash").distinct().join(holdings, ["node", "hash"], "left_semi")


def offsets(manifests: DataFrame) -> DataFrame:
    """Where each chunk of a file begins: the sum of sizes before it."""
    before = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifests.select("file", "seq", "hash", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))


def range_read(manifests: DataFrame, ranges: DataFrame) -> DataFrame:
    """Chunks that overlap [start, start + length) of a file; both sides meet by file, never by range alone."""
    hit = (F.col("length") > 0) & (F.col("offset") < F.col("start") + F.col("length")) & (F.col("offset") + F.col("size") > F.col("start"))
    return offsets(manifests).join(ranges, "file").where(hit).select("file", "start", "length", "seq", "hash", "offset", "size")


def read_ahead(manifests: DataFrame, reads: DataFrame, depth: int = 8) -> DataFrame:
    """The next ``depth`` chunks after the last one read of a file."""
    rows = manifests.join(reads.groupBy("file").agg(F.max("seq").alias("last")), "file")
    return rows.where(F.col("seq").between(F.col("last") + 1, F.col("last") + depth)).select("file", "seq", "hash", "size")


def edit_delta(chunks: DataFrame, previous: DataFrame) -> DataFrame:
    """New different chunks, and their bytes, of each path against its previous version (path, hash)."""
    fresh = chunks.groupBy("path", "hash").agg(F.max("size").alias("size")).join(previous.select("path", "hash").distinct().withColumn("old", F.lit(1)), ["path", "hash"], "left")
    new = F.col("old").isNull()
    return fresh.groupBy("path").agg(F.count_if(new).alias("n_new"), F.coalesce(F.sum(F.when(new, F.col("size"))), F.lit(0)).alias("bytes_moved"))


def overcommit(manifests: DataFrame, holdings: DataFrame, interest: DataFrame) -> DataFrame:
    """Bytes that a node presents against those it stores."""
    sizes = manifests.groupBy("file").agg(F.sum("size").alias("bytes"))
    presented = interest.join(sizes, "file").groupBy("node").agg(F.sum("bytes").alias("presented"))
    physical = holdings.groupBy("node").agg(F.sum("size").alias("physical"))
    return presented.join(physical, "node", "full").select("node", F.coalesce("presented", F.lit(0)).alias("presented"), F.coalesce("physical", F.lit(0)).alias("physical"), F.round(F.try_divide("presented", "physical"), 2).alias("ratio"))
