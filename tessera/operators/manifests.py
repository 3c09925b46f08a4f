"""Manifests: files published as ordered chunk lists with canonical digests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import gear, reed_solomon, structured
from tessera.operators.history import bump
from tessera.session import cut

FIELDS = "path string, size bigint, mode int, mtime double, chunks array<string>, sizes array<bigint>, vv map<string,bigint>, origin string, created double, deleted boolean, note string, labels array<string>, ec string"
CONTENT = ("path", "size", "chunks", "sizes", "labels", "ec")


def canonical(record: dict) -> str:
    return json.dumps(record, sort_keys=True, separators=(",", ":"))


def digests(manifests: DataFrame) -> DataFrame:
    """``manifests`` with digest (of all fields) and content_id (of what a read sees).

    The canonical text is that of a JSON library, nulls, escapes and float forms included,
    which SQL's does not equal, so this is an Arrow batch in Python.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = lambda v: v.tolist() if hasattr(v, "tolist") else v
        for f in frames:
            rows = []
            for r in f[names].itertuples(index=False):
                d = {k: plain(v) for k, v in zip(names, r)}
                d["vv"] = {k: int(v) for k, v in (dict(d["vv"]) if d["vv"] is not None else {}).items()}
                d["ec"] = json.loads(d["ec"]) if isinstance(d["ec"], str) else None
                content = {k: d[k] for k in CONTENT}
                rows.append([hashlib.sha256(canonical(x).encode()).hexdigest() for x in (d, content)])
            f["digest"], f["content_id"] = [x[0] for x in rows], [x[1] for x in rows]
            yield f

    schema = ", ".join(f"{n} {t}" for n, t in manifests.dtypes)
    return manifests.mapInPandas(run, f"{schema}, digest string, content_id string")


def publish(files: DataFrame, origin: Column, moment: float, previous: DataFrame | None = None) -> DataFrame:
    """Manifests of files (path, data): grammar pieces where a file has a structure, else content-defined chunks.

    ``previous`` (path, vv) gives the vectors that are bumped by the origin.
    """
    split = structured.split_files(files)
    labelled = split.join(files.select("path", F.col("data").cast("binary").alias("data")), "path")
    piece = F.substring("data", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    labelled = labelled.select("path", "seq", F.sha2(piece, 256).alias("hash"), (F.col("end") - F.col("start")).alias("size"), "label")
    plain = gear.chunk_files(files.join(split.select("path").distinct(), "path", "left_anti"))
    chunks = labelled.unionByName(plain.select("path", "seq", "hash", F.col("size").cast("bigint").alias("size"), F.lit(None).cast("string").alias("label")))
    lists = chunks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "hash", "size", "label"))).alias("c"))
    rows = files.select("path", origin.alias("origin")).join(lists, "path", "left")
    empty = F.create_map().cast("map<string,bigint>")
    rows = rows.join(previous.select("path", "vv"), "path", "left") if previous is not None else rows.withColumn("vv", empty)
    part = lambda name, kind: F.coalesce(F.transform("c", lambda x: x[name]), F.array().cast(f"array<{kind}>"))
    sizes = part("size", "bigint")
    rows = rows.select(
        "path", F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("size"), F.lit(0o644).alias("mode"), F.lit(moment).alias("mtime"), part("hash", "string").alias("chunks"), sizes.alias("sizes"),
        bump(F.coalesce("vv", empty), F.col("origin")).alias("vv"), "origin", F.lit(moment).alias("created"), F.lit(False).alias("deleted"), F.lit("").alias("note"),
        F.when(F.exists(part("label", "string"), lambda x: x.isNotNull()), part("label", "string")).alias("labels"), F.lit(None).cast("string").alias("ec"),
    )
    return digests(rows)


def publish_coded(files: DataFrame, origin: Column, moment: float, k: int, m: int, previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Manifests whose chunks are coded into k + m fragments each, and the fragments (chunk, idx, hash, fragment, size).

    Files with a structure are not coded. ``ec`` maps each chunk to k, m, the fragments'
    hashes in order, their length and the chunk's.
    """
    plain = publish(files, origin, moment, previous).drop("digest", "content_id")
    unstructured = files.join(plain.where("labels IS NOT NULL").select("path"), "path", "left_anti")
    chunks = gear.chunk_files(unstructured, with_data=True)
    pieces = reed_solomon.encode_files(chunks.dropDuplicates(["hash"]).select(F.col("hash").alias("path"), "data"), k, m)
    pieces = pieces.select(F.col("path").alias("chunk"), "idx", F.sha2("fragment", 256).alias("hash"), "fragment", "size")
    groups = pieces.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"]).alias("frags"), F.max(F.octet_length("fragment")).alias("shard_len"), F.max("size").alias("orig_len"))
    entry = F.struct(F.lit(k).alias("k"), F.lit(m).alias("m"), "frags", "shard_len", "orig_len")
    maps = chunks.select("path", F.col("hash").alias("chunk")).distinct().join(groups, "chunk").groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk", entry)))).alias("ec_map"))
    rows = plain.drop("ec").join(maps, "path", "left").withColumn("ec", F.to_json("ec_map")).drop("ec_map")
    return digests(rows), pieces


_EC = "map<string,struct<k:int,m:int,frags:array<string>,shard_len:bigint,orig_len:bigint>>"


def groups(manifests: DataFrame) -> DataFrame:
    """path, chunk, k, m, frags, shard_len, orig_len of each coded chunk."""
    return manifests.where("ec IS NOT NULL").select("path", F.explode(F.from_json("ec", _EC)).alias("chunk", "g")).select("path", "chunk", "g.*")


def coding_stats(manifests: DataFrame, held: DataFrame) -> DataFrame:
    """path, k, m, overhead, tolerates, n_groups, fragments_present (of ``held``, hash), fragments_total."""
    rows = groups(manifests).select("path", "chunk", "k", "m", F.explode("frags").alias("hash"))
    rows = rows.join(held.select("hash", F.lit(1).alias("here")).distinct(), "hash", "left")
    out = rows.groupBy("path").agg(F.max("k").alias("k"), F.max("m").alias("m"), F.countDistinct("chunk").alias("n_groups"), F.count("here").alias("fragments_present"), F.count("*").alias("fragments_total"))
    return out.select("path", "k", "m", F.round((F.col("k") + F.col("m")) / F.col("k"), 2).alias("overhead"), F.col("m").alias("tolerates"), "n_groups", "fragments_present", "fragments_total")


def repair(manifests: DataFrame, fragments: DataFrame, held: DataFrame, k: int, m: int) -> DataFrame:
    """Coded chunks that are not ``held`` (hash) made again from ``fragments`` (hash, fragment): chunk, data, ok.

    A chunk with under k fragments gives no row; ok is false where the bytes lack the chunk's hash.
    """
    wanted = groups(manifests).select("chunk", "orig_len", F.posexplode("frags").alias("idx", "hash")).dropDuplicates(["chunk", "idx"])
    wanted = wanted.join(held.select(F.col("hash").alias("chunk")), "chunk", "left_anti")
    rows = wanted.join(fragments.select("hash", "fragment").dropDuplicates(["hash"]), "hash")
    made = reed_solomon.decode_files(rows.select(F.col("chunk").alias("path"), F.col("idx").cast("int").alias("idx"), "fragment", F.col("orig_len").alias("size")), k, m)
    return made.where("data IS NOT NULL").select(F.col("path").alias("chunk"), "data", (F.sha2("data", 256) == F.col("path")).alias("ok"))


def edited(data: Column, offset: Column, new: Column) -> Column:
    """Bytes with ``new`` written at ``offset``; a gap behind the old end is filled with zeros."""
    head = F.rpad(F.substring(data, F.lit(1), offset), offset, F.lit(bytearray(1)))
    return F.concat(F.when(offset > 0, head).otherwise(F.lit(bytearray())), new, F.substring(data, offset + F.octet_length(new) + 1, F.octet_length(data)))


def nbytes(manifests: DataFrame) -> DataFrame:
    """path and the size of a manifest as JSON text without blanks."""
    return manifests.select("path", F.octet_length(as_json(manifests)).cast("bigint").alias("manifest_bytes"))


def as_json(manifests: DataFrame) -> Column:
    """A manifest as one line of JSON, nulls included."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})


def add_versions(store: str, manifests: DataFrame) -> DataFrame:
    """Write versions that the store lacks, a line of JSON each under their path's folder; returns those written (path, digest)."""
    spark = manifests.sparkSession
    known = load_versions(spark, store).select("digest")
    new = cut(manifests.dropDuplicates(["digest"]).join(known, "digest", "left_anti"), "new-versions")
    new.select(as_json(new).alias("value")).write.mode("append").text(f"{store}/versions")
    return new.select("path", "digest")


def load_versions(spark, store: str) -> DataFrame:
    """All versions of a store with their digests; lines that aren't a manifest are skipped."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/versions")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], FIELDS + ", digest string, content_id string")
    rows = spark.read.schema(f"{FIELDS}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(f"{store}/versions")
    return digests(rows.select("*").where("path IS NOT NULL AND chunks IS NOT NULL AND _corrupt IS NULL").drop("_corrupt"))


def set_current(store: str, refs: DataFrame, turn: int) -> None:
    """Name the current digest of paths (path, digest). A turn's refs are one folder, added whole; later turns win."""
    refs.select("path", "digest", F.lit(turn).cast("bigint").alias("turn")).write.mode("append").parquet(f"{store}/refs")


def current_refs(spark, store: str) -> DataFrame:
    """path, digest as last set."""
    rows = spark.read.schema("path string, digest string, turn bigint").parquet(f"{store}/refs")
    return rows.groupBy("path").agg(F.max_by("digest", F.struct("turn", "digest")).alias("digest"))


def rollback(manifests: DataFrame, targets: DataFrame, node: Column, moment: float) -> DataFrame:
    """New manifests with the content of older ones: ``targets`` (path, digest); an unknown digest gives none."""
    current = manifests.groupBy("path").agg(F.max_by("vv", "created").alias("now"))
    rows = manifests.join(targets.select("path", "digest"), ["path", "digest"], "left_semi").join(current, "path")
    rows = rows.withColumns({"vv": bump(F.col("now"), node), "origin": node, "created": F.lit(moment), "mtime": F.lit(moment), "note": F.concat(F.lit("rollback to "), F.substring("digest", 1, 8))})
    return digests(rows.drop("now", "digest", "content_id"))


def snapshot(current: DataFrame, note: str) -> DataFrame:
    """One row: the path to digest map of a namespace. It is as large as the namespace, so keep long ones as rows."""
    return current.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "digest")))).alias("entries"), F.lit(note).alias("note"))


def label_map(manifests: DataFrame) -> DataFrame:
    """path, label, hash: the last piece of each label; labels that begin with ``<`` have no entry."""
    rows = manifests.where("labels IS NOT NULL").select("path", F.posexplode(F.arrays_zip("labels", "chunks")).alias("seq", "x")).select("path", "seq", F.col("x.labels").alias("label"), F.col("x.chunks").alias("hash"))
    return rows.where(~F.col("label").startswith("<")).groupBy("path", "label").agg(F.max_by("hash", "seq").alias("hash"))
