"""What nodes tell each other and fetch from each other: adverts, acceptance, holders, transfer state."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.history import compare, merge

ADVERTS = 200


def adverts(current: DataFrame, limit: int = ADVERTS) -> DataFrame:
    """The first ``limit`` current manifests of each node by path (node, path, digest, vv, size, n): what a gossip round sends."""
    order = Window.partitionBy("node").orderBy("path")
    return current.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).drop("k")


def worth_asking(local: DataFrame, told: DataFrame) -> DataFrame:
    """Adverts (path, digest, vv) whose manifest is to be fetched: unknown here, or neither the same nor older."""
    rows = told.join(local.select("path", F.col("digest").alias("mine"), F.col("vv").alias("my_vv")), "path", "left")
    old = (F.col("mine") == F.col("digest")) | compare(F.col("my_vv"), F.col("vv")).isin("after", "equal")
    return rows.where(F.col("mine").isNull() | ~old).drop("mine", "my_vv")


def accept(local: DataFrame, remote: DataFrame) -> DataFrame:
    """What comes of remote manifests, one for each path, here: path, outcome, digest, vv, side_path, loser.

    accepted: there is none here, or the remote one descends from it. duplicate: the same
    manifest. stale: the local one descends from the remote one. conflict: neither does (or equal vectors with
    different digests); the larger digest wins, under the pointwise maximum of both vectors,
    and the other one is kept under a path that names its origin. ``local`` and ``remote``
    have path, digest, vv and origin.
    """
    mine = local.select("path", F.struct("digest", "vv", "origin").alias("a"))
    rows = remote.select("path", F.struct("digest", "vv", "origin").alias("b")).join(mine, "path", "left")
    relation = compare(F.col("a.vv"), F.col("b.vv"))
    outcome = (
        F.when(F.col("a").isNull(), "accepted")
        .when((relation == "equal") & (F.col("a.digest") == F.col("b.digest")), "duplicate")
        .when(relation == "after", "stale")
        .when(relation == "before", "accepted")
        .otherwise("conflict")
    )
    rows = rows.withColumn("outcome", outcome)
    remote_wins = F.col("b.digest") > F.col("a.digest")
    winner = F.when((F.col("outcome") == "accepted") | (F.col("outcome") == "conflict") & remote_wins, F.col("b")).otherwise(F.col("a"))
    loser = F.when(F.col("outcome") == "conflict", F.when(remote_wins, F.col("a")).otherwise(F.col("b")))
    rows = rows.withColumns({"winner": winner, "lost": loser})
    side = F.concat(F.col("path").cast("string"), F.lit(".conflict-"), "lost.origin", F.lit("-"), F.substring("lost.digest", 1, 8))
    vector = F.when(F.col("outcome") == "conflict", merge(F.col("a.vv"), F.col("b.vv"))).otherwise(F.col("winner.vv"))
    return rows.select("path", "outcome", F.col("winner.digest").alias("digest"), vector.alias("vv"), F.col("winner.origin").alias("origin"), side.alias("side_path"), F.col("lost.digest").alias("loser"))


def conflicts(accepted: DataFrame) -> DataFrame:
    """Each path's losing digests, each once."""
    return accepted.where("outcome = 'conflict'").select("path", F.col("loser").alias("digest")).distinct()


def origins(current: DataFrame) -> DataFrame:
    """Nodes that a current manifest comes from."""
    return current.select(F.col("origin").alias("node")).distinct()


def candidates(members: DataFrame, cut_off: DataFrame, origin_nodes: DataFrame, star: bool = False) -> DataFrame:
    """(observer, node) that may be asked: not dead, the observer neither killed nor cut off from it.

    ``members`` (observer, node, state, killed), ``cut_off`` (observer, node). With ``star`` only origins, unless an observer has none.
    """
    rows = members.where("state <> 'DEAD' AND NOT killed").join(cut_off, ["observer", "node"], "left_anti")
    if not star:
        return rows.select("observer", "node")
    rows = rows.join(origin_nodes.select("node", F.lit(True).alias("origin")), "node", "left")
    some = F.max(F.coalesce("origin", F.lit(False))).over(Window.partitionBy("observer"))
    return rows.withColumn("some", some).where("origin OR NOT some").select("observer", "node")


def believed(exact: DataFrame, maybe: DataFrame, denied: DataFrame, now: Column) -> DataFrame:
    """(node, hash) that peers are believed to hold: known exactly or by their filter, unless a denial (node, hash, until) still holds."""
    rows = exact.select("node", "hash").union(maybe.select("node", "hash")).distinct()
    return rows.join(denied.where(F.col("until") > now).select("node", "hash"), ["node", "hash"], "left_anti")


def replica_counts(exact: DataFrame, maybe: DataFrame, filters: DataFrame) -> DataFrame:
    """How many nodes with a filter have each chunk, by the filter or exactly; denials don't count here."""
    rows = exact.select("node", "hash").union(maybe.select("node", "hash")).distinct().join(filters.select("node"), "node", "left_semi")
    return rows.groupBy("hash").agg(F.count("*").alias("holders"))


def forget(known: DataFrame, gone: DataFrame) -> DataFrame:
    """What is known of other nodes than those of ``gone``."""
    return known.join(gone.select("node"), "node", "left_anti")


def plan(wanted: DataFrame, holders: DataFrame, inflight: DataFrame | None = None, origin_nodes: DataFrame | None = None, limit: int = 16, per_peer: int = 4, window: int = 128, salt: int | None = None) -> DataFrame:
    """Transfers of each node: node, hash, peer, rarity, step.

    ``wanted`` (node, hash); ``holders`` (node, hash, peer, rank): whom a node may ask, in order
    of preference; ``inflight`` (node, hash, peer) counts as load and isn't planned again. Of over
    ``window`` chunks a node takes those with the least hash of name and salt, which stands for a random sample.
    Chunks go by rarity, ties by salted hash (or by name); with ``origin_nodes`` (super-seeding), chunks that only
    origins have come last, and origins are asked last. Each goes to the first peer with less than
    ``per_peer`` transfers. Capacity is taken chunk by chunk, so one pass over at most ``window`` rows a node decides.
    """
    todo = wanted.select("node", "hash").distinct()
    if inflight is not None:
        todo = todo.join(inflight.select("node", "hash"), ["node", "hash"], "left_anti")
    draw = F.xxhash64("hash", F.lit(salt or 0))
    todo = todo.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy(draw, "hash"))).where(F.col("k") <= window).drop("k")
    rows = holders
    if origin_nodes is not None:
        rows = rows.join(origin_nodes.select(F.col("node").alias("peer"), F.lit(1).alias("origin")), "peer", "left").withColumn("origin", F.coalesce("origin", F.lit(0)))
    else:
        rows = rows.withColumn("origin", F.lit(0))
    rows = todo.join(rows, ["node", "hash"]).where("peer <> node")
    # the peers of a chunk as one row: as many as can be full before it, and one more
    load = inflight.groupBy("node", "peer").agg(F.count("*").cast("int").alias("load")) if inflight is not None else None
    rows = rows.join(load, ["node", "peer"], "left").fillna(0, ["load"]) if load is not None else rows.withColumn("load", F.lit(0))
    order = Window.partitionBy("node", "hash").orderBy("origin", "rank", "peer")
    full = F.count("*").over(Window.partitionBy("node", "hash"))
    swarm = F.min("origin").over(Window.partitionBy("node", "hash"))
    rows = rows.withColumns({"rarity": full, "late": swarm}).where(F.col("load") < per_peer)
    rows = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit // per_peer + 1)
    key = draw if salt is not None else F.lit(0).cast("bigint")
    chunks = rows.groupBy("node", "hash", "rarity", "late").agg(F.array_sort(F.collect_list(F.struct("k", "peer", "load"))).alias("peers")).withColumn("key", key)
    chunks = chunks.repartition("node").sortWithinPartitions("node", "late", "rarity", "key", "hash")

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, taken, n = None, {}, 0
        for batch in batches:
            out = []
            for own, h, rarity, peers in zip(*(batch.column(c).to_pylist() for c in ("node", "hash", "rarity", "peers"))):
                if own != node:
                    node, taken, n = own, {}, 0
                for p in peers if n < limit else ():
                    if taken.get(p["peer"], p["load"]) < per_peer:
                        taken[p["peer"]] = taken.get(p["peer"], p["load"]) + 1
                        n += 1
                        out.append((own, h, p["peer"], rarity, n))
                        break
            yield pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in range(5)], names=["node", "hash", "peer", "rarity", "step"])

    return chunks.select("node", "hash", "rarity", "peers").mapInArrow(greedy, "node bigint, hash bigint, peer bigint, rarity bigint, step bigint")


def complete(inflight: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After transfers (node, hash, peer, ok) ended: what is still in flight, and the chunks that peers are now known to hold."""
    return inflight.join(done.select("node", "hash"), ["node", "hash"], "left_anti"), done.where("ok").select(F.col("peer").alias("node"), "hash").distinct()


def release_peer(inflight: DataFrame, gone: DataFrame) -> DataFrame:
    """Transfers from other peers than those of ``gone`` (node)."""
    return inflight.join(gone.select(F.col("node").alias("peer")), "peer", "left_anti").select("node", "hash", "peer")


def scheduler_stats(inflight: DataFrame) -> DataFrame:
    return inflight.groupBy("node").agg(F.count("*").alias("inflight"), F.countDistinct("peer").alias("busy_peers"))


def sample_peers(members: DataFrame, k: int, seed: int) -> DataFrame:
    """``k`` of each observer's peers that aren't dead (observer, node, state), by a seeded hash."""
    order = Window.partitionBy("observer").orderBy(F.xxhash64("observer", "node", F.lit(seed)), "node")
    return members.where("state <> 'DEAD'").withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).select("observer", "node")


def peer_records(members: DataFrame) -> DataFrame:
    """Each member as the JSON that gossip carries, with the round trip in four digits."""
    fields = ["id", "host", "port", "rack", "hb", "state", F.round("rtt", 4).alias("rtt"), "have"]
    return members.select("id", F.concat_ws(":", "host", "port").alias("addr"), F.to_json(F.struct(*fields)).alias("record"))


def believed_at(acquired: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(observer, peer, piece) that an observer's snapshot of a peer shows: acquired no later than the snapshot's sequence number."""
    return snapshots.join(acquired.select(F.col("node").alias("peer"), "piece", "seq"), "peer").where("seq <= seen").select("observer", "peer", "piece")


def listing(files: DataFrame) -> DataFrame:
    """path, size in words, chunks, state and origin, as a node's file list shows them."""
    from tessera.operators.faults import human_bytes

    return files.select("path", human_bytes(F.col("size")).alias("size"), "chunks", "state", "origin")
