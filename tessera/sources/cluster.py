"""A virtual file-sync cluster over the star-schema tables.

Each relation has a Spark and a SQL form of the same rows, so that the operators can be
compared with DuckDB. None of them collects anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, origin, data, size of each payload."""
    d = table(spark, sf_dir, "documents")
    data = F.coalesce("text", F.lit(""))
    return d.select(F.concat(F.lit("/"), "source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("source").alias("origin"), data.alias("data"), F.octet_length(data).cast("bigint").alias("size"))


def replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, hash, size, atime, file, seq: each chunk of a file and a node that has a copy."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("hash"), F.col("l_quantity").cast("bigint").alias("size"),
        F.col("l_shipdate").alias("atime"), F.col("l_orderkey").alias("file"), F.row_number().over(order).cast("bigint").alias("seq"),
    )


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, hash, size, atime: a node's store, one row for each chunk, as last used."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("hash")).agg(F.max(F.col("l_quantity").cast("bigint")).alias("size"), F.max("l_shipdate").alias("atime"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("rack"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, digest, created, origin, size of every version of a manifest."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("path"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("digest"), F.col("o_orderdate").alias("created"),
        F.col("o_orderpriority").alias("origin"), F.col("o_totalprice").alias("size"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, a, b: two version vectors of a path, by the orders of its even and odd days."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("path"), (F.col("o_orderkey") % 2).alias("side"), F.col("o_orderstatus").alias("k")).count()
    side = lambda s: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("k", F.col("count").alias("v"))))))
    return counts.groupBy("path").agg(side(0).alias("a"), side(1).alias("b"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, label, hash: the last value of each configuration key on each node."""
    value = F.sha2((F.get_json_object("props", "$.k").cast("bigint") % 2).cast("string"), 256)
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 12).alias("node"), F.col("event_type").alias("label"), "event_id", value.alias("hash"))
    return e.groupBy("node", "label").agg(F.max_by("hash", "event_id").alias("hash"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), F.col("event_type").alias("name"), "value", "ts", F.col("event_id").alias("seq"))


#: The same relations for DuckDB, as common table expressions.
SQL = {
    "files": "files AS (SELECT '/' || source || '/doc-' || doc_id || '.txt' AS path, source AS origin, coalesce(text, '') AS data, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM documents)",
    "replicas": "replicas AS (SELECT l_suppkey AS node, l_partkey AS hash, l_quantity::BIGINT AS size, l_shipdate AS atime, l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_extendedprice) AS seq FROM lineitem)",
    "holdings": "holdings AS (SELECT l_suppkey AS node, l_partkey AS hash, max(l_quantity::BIGINT) AS size, max(l_shipdate) AS atime FROM lineitem GROUP BY ALL)",
    "nodes": "nodes AS (SELECT s_suppkey AS node, s_nationkey AS rack FROM supplier)",
    "versions": "versions AS (SELECT o_custkey AS path, sha256(o_orderkey::VARCHAR) AS digest, o_orderdate AS created, o_orderpriority AS origin, o_totalprice AS size FROM orders)",
    "vectors": "vectors AS (SELECT o_custkey AS path, o_orderkey % 2 AS side, o_orderstatus AS k, count(*) AS v FROM orders GROUP BY ALL)",
    "labelled": "labelled AS (SELECT user_id % 12 AS node, event_type AS label, max_by(sha256(((props::JSON->>'$.k')::BIGINT % 2)::VARCHAR), event_id) AS hash FROM events GROUP BY ALL)",
    "telemetry": "telemetry AS (SELECT user_id AS node, event_type AS name, value, ts, event_id AS seq FROM events)",
}


def sql(names: str, body: str) -> str:
    """A query over some of the relations."""
    return f"WITH {', '.join(SQL[n] for n in names.split())} {body}"
