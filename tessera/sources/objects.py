"""A content-addressed object store as Parquet, fanned out by the hash's first two digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut

SCHEMA = "hash string, size bigint, data binary, h2 string"


def put(store: str, data: DataFrame) -> DataFrame:
    """Add blobs (data, optional expected hash); known ones are left out. Returns what was added (hash, size).

    A blob whose hash is not the expected one fails the write.
    """
    spark = data.sparkSession
    rows = data.withColumn("hash", F.sha2("data", 256))
    if "expected" in data.columns:
        bad = F.raise_error(F.concat(F.lit("hash mismatch: "), F.col("expected")))
        rows = rows.withColumn("hash", F.when(F.coalesce(F.col("expected"), F.col("hash")) == F.col("hash"), F.col("hash")).otherwise(bad))
    rows = rows.select("hash", F.octet_length("data").cast("bigint").alias("size"), "data", F.substring("hash", 1, 2).alias("h2")).dropDuplicates(["hash"])
    new = rows.join(scan(spark, store).select("hash", "h2"), ["hash", "h2"], "left_anti")
    new = cut(new.select("hash", "size", "data", "h2"), "new-objects")  # what is new is decided once, before the store grows
    new.repartition("h2").write.mode("append").partitionBy("h2").parquet(store)
    return new.select("hash", "size")


def scan(spark: SparkSession, store: str) -> DataFrame:
    """hash, size, data, h2 of all objects; empty where there is no store yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(store)


def get(spark: SparkSession, store: str, digest: str) -> DataFrame:
    """One object; the partition filter prunes all other folders."""
    return scan(spark, store).where((F.col("h2") == digest[:2]) & (F.col("hash") == digest)).select("hash", "size", "data")


def damaged(spark: SparkSession, store: str) -> DataFrame:
    """Objects whose bytes no longer have their hash."""
    return scan(spark, store).where(F.sha2("data", 256) != F.col("hash")).select("hash", "size")


def drop(spark: SparkSession, store: str, hashes: DataFrame) -> DataFrame:
    """Take objects (hash) out of the store; returns those that were there. Only the folders that hold one are written again."""
    gone = cut(scan(spark, store).join(hashes.select("hash").distinct(), "hash", "left_semi").select("hash", "size", "h2"), "dropped")
    touched = gone.select("h2").distinct()
    kept = scan(spark, store).join(touched, "h2", "left_semi").join(gone.select("hash"), "hash", "left_anti").select("hash", "size", "data", "h2")
    kept = cut(kept, "kept-objects")  # read whole before its folders are replaced
    # a folder that keeps nothing still has to be replaced: it gets no file from an overwrite, so it is removed by name
    emptied = touched.join(kept.select("h2").distinct(), "h2", "left_anti")
    kept.repartition("h2").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("h2").parquet(store)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for row in emptied.collect():  # 256 folders at most
        path = jvm.org.apache.hadoop.fs.Path(f"{store}/h2={row.h2}")
        path.getFileSystem(conf).delete(path, True)
    return gone.select("hash", "size")


def scrub(spark: SparkSession, store: str) -> DataFrame:
    """Drop all damaged objects; returns the hashes that are wanted again."""
    bad = cut(damaged(spark, store).select("hash"), "damaged")
    drop(spark, store, bad)
    return bad


def files(spark: SparkSession, path: str, with_data: bool = False) -> DataFrame:
    """Files of a folder as path, size, mtime and, if asked for, data; else contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *(["content"] if with_data else []))
