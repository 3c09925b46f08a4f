"""Queries of what nodes tell each other: acceptance, holders, transfers, roll-ups, coding, stores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import gear
from tessera.operators import catalog, exchange, faults, manifests, merkle, replicas, telemetry
from tessera.plans.registry import query
from tessera.session import cut, shared_dir
from tessera.sources import cluster as c
from tessera.sources import objects
from tessera.sources.cluster import sql


def _local_and_remote(spark, sf):
    """Two sides of each path: a fifth of the paths is unknown here, a seventh has the same digest on both."""
    v = c.vectors(spark, sf)
    name = lambda x: F.sha2(F.concat(F.col("path").cast("string"), x), 256).alias("digest")
    local = v.where("path % 5 <> 0").select("path", name(F.lit("a")), F.col("a").alias("vv"), F.lit("A").alias("origin"))
    return local, v.select("path", name(F.when(F.col("path") % 7 == 0, "a").otherwise("b")), F.col("b").alias("vv"), F.lit("B").alias("origin"))


_SIDES = """, p AS (SELECT path, k, coalesce(sum(v) FILTER (side = 0), 0) AS a, coalesce(sum(v) FILTER (side = 1), 0) AS b FROM vectors GROUP BY ALL),
    s AS (SELECT path, path % 5 <> 0 AS here, bool_or(a < b) AS less, bool_or(a > b) AS more, sum(a)::BIGINT AS ta, sum(b)::BIGINT AS tb, sum(greatest(a, b))::BIGINT AS tm,
          sha256(path || 'a') AS da, sha256(path || CASE WHEN path % 7 = 0 THEN 'a' ELSE 'b' END) AS db FROM p GROUP BY path),
    o AS (SELECT *, CASE WHEN NOT here THEN 'accepted' WHEN NOT less AND NOT more AND da = db THEN 'duplicate' WHEN more AND NOT less THEN 'stale' WHEN less AND NOT more THEN 'accepted' ELSE 'conflict' END AS outcome FROM s)"""


def _with(names: str, body: str) -> str:
    return sql(names, body).replace(" ,", ",", 1) if body.startswith(",") else sql(names, body)


@query(_with("vectors", _SIDES + """ SELECT path, outcome, CASE WHEN outcome = 'accepted' OR outcome = 'conflict' AND db > da THEN db ELSE da END AS digest,
    CASE WHEN outcome = 'accepted' OR outcome = 'conflict' AND db > da THEN 'B' ELSE 'A' END AS origin, CASE outcome WHEN 'accepted' THEN tb WHEN 'conflict' THEN tm ELSE ta END AS changes,
    CASE WHEN outcome = 'conflict' THEN path || '.conflict-' || CASE WHEN db > da THEN 'A-' || substr(da, 1, 8) ELSE 'B-' || substr(db, 1, 8) END END AS side_path,
    CASE WHEN outcome = 'conflict' THEN least(da, db) END AS loser FROM o"""))  # fmt: skip
def accept_manifests(spark, sf):
    rows = exchange.accept(*_local_and_remote(spark, sf))
    changes = F.aggregate(F.map_values("vv"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("path", "outcome", "digest", "origin", changes.alias("changes"), "side_path", "loser")


@query(_with("vectors", _SIDES + " SELECT path, db AS digest FROM o WHERE NOT here OR da <> db AND less"))
def adverts_to_ask(spark, sf):
    return exchange.worth_asking(*_local_and_remote(spark, sf)).select("path", "digest")


@query(_with("vectors", _SIDES + " SELECT path, least(da, db) AS digest FROM o WHERE outcome = 'conflict'"))
def conflict_losers(spark, sf):
    return exchange.conflicts(exchange.accept(*_local_and_remote(spark, sf)))


@query(sql("replicas", "SELECT node, file AS path FROM (SELECT DISTINCT node, file FROM replicas) QUALIFY row_number() OVER (PARTITION BY node ORDER BY file) <= 200"))
def gossip_adverts(spark, sf):
    """The 200 adverts of each node: the limit is that of a gossip round."""
    return exchange.adverts(c.replicas(spark, sf).select("node", F.col("file").alias("path")).distinct())


def _beliefs(spark, sf):
    h = c.holdings(spark, sf)
    side = (F.col("hash") + F.col("node")) % 3
    denied = h.where("hash % 4 = 0").select("node", "hash", F.date_add(F.col("atime").cast("date"), 400).alias("until"))
    return h.where(side == 0), h.where(side == 1), denied


_BELIEFS = ", x AS (SELECT node, hash, atime::DATE + 400 AS until FROM holdings WHERE (hash + node) % 3 < 2)"


@query(_with("holdings", _BELIEFS + " SELECT node, hash FROM x WHERE NOT (hash % 4 = 0 AND until > DATE '1997-06-30')"))
def believed_holders(spark, sf):
    return exchange.believed(*_beliefs(spark, sf), F.lit("1997-06-30").cast("date"))


@query(_with("holdings", _BELIEFS + " SELECT hash, count(*) AS holders FROM x WHERE node % 4 <> 1 GROUP BY hash"))
def believed_rarity(spark, sf):
    exact, maybe, _ = _beliefs(spark, sf)
    return exchange.replica_counts(exact, maybe, c.nodes(spark, sf).where("node % 4 <> 1"))


def _inflight(spark, sf):
    return c.holdings(spark, sf).where("hash % 9 = 0").select("node", "hash", (F.col("hash") % 10).alias("peer"))


@query(sql("holdings", "SELECT node, count(*) AS inflight, count(DISTINCT hash % 10) AS busy_peers FROM holdings WHERE hash % 9 = 0 AND hash % 18 <> 0 AND hash % 10 <> 3 GROUP BY node"))
def scheduler_stats(spark, sf):
    """What is in flight after some transfers ended and one peer left."""
    rows = _inflight(spark, sf)
    left, _ = exchange.complete(rows, rows.where("hash % 18 = 0").withColumn("ok", F.lit(True)))
    return exchange.scheduler_stats(exchange.release_peer(left, spark.range(3, 4).select(F.col("id").alias("node"))))


@query(sql("nodes", "SELECT o.node AS observer, p.node FROM nodes o JOIN nodes p ON o.node <> p.node WHERE p.node % 6 <> 5 AND o.node % 11 <> 3 AND (o.node + p.node) % 13 <> 4 AND p.rack = 3"))
def candidate_origins(spark, sf):
    """Whom each node may ask where only origins serve: the nodes of rack 3."""
    n = c.nodes(spark, sf)
    pairs = replicas.proximity(n, n, F.lit(0)).select("observer", "node")
    state = F.when(F.col("node") % 6 == 5, "DEAD").otherwise("ALIVE")
    members = pairs.withColumns({"state": state, "killed": F.col("observer") % 11 == 3})
    cut_off = pairs.where("(observer + node) % 13 = 4")
    rows = exchange.candidates(members, cut_off, n.where("rack = 3"), star=True)
    return rows.join(n.where("rack = 3").select("node"), "node", "left_semi").select("observer", "node")


@query(_with("holdings", ", a AS (SELECT node, hash AS piece, row_number() OVER (PARTITION BY node ORDER BY atime, hash) AS seq FROM holdings), s AS (SELECT DISTINCT node % 10 AS observer, node AS peer, node % 25 AS seen FROM holdings) SELECT observer, peer, piece FROM s JOIN a ON a.node = peer AND seq <= seen"))
def believed_at(spark, sf):
    from pyspark.sql import Window

    h = c.holdings(spark, sf)
    acquired = h.select("node", F.col("hash").alias("piece"), F.row_number().over(Window.partitionBy("node").orderBy("atime", "hash")).alias("seq"))
    return exchange.believed_at(acquired, h.select((F.col("node") % 10).alias("observer"), F.col("node").alias("peer"), (F.col("node") % 25).alias("seen")).distinct())


@query(_with("replicas holdings", ", f AS (SELECT DISTINCT file AS g, hash FROM replicas), n AS (SELECT g, node, count(*) AS n FROM f JOIN holdings USING (hash) GROUP BY ALL) SELECT g AS \"group\", node, n, row_number() OVER (PARTITION BY g ORDER BY n DESC, node) AS rank FROM n WHERE node <> g % 10 + 1"))
def kill_ranking(spark, sf):
    f = c.replicas(spark, sf).select(F.col("file").alias("group"), "hash").distinct()
    return replicas.kill_ranking(f, c.holdings(spark, sf), f.select("group", (F.col("group") % 10 + 1).alias("node")).distinct())


@query("SELECT event_id AS seq, round((CASE WHEN user_id % 4 = event_id % 4 THEN 0.5 ELSE 12.0 END)::DOUBLE * (1 + (2 * (event_id % 100) / 100.0::DOUBLE - 1) * 0.3) / 1000, 9) AS link_s, round((event_id % 7)::DOUBLE / 1000 + CASE WHEN event_id % 3 > 0 THEN event_id * 10 / ((event_id % 3) * 1e6) ELSE 0 END, 9) AS held_s, (event_id % 5) / 10.0 > 0 AND (event_id % 100) / 100.0 < (event_id % 5) / 10.0 AS lost, event_id % 11 = 0 OR coalesce(event_id % 4 IN (1, 2), false) AS blocked, event_type IN ('kill', 'revive', 'drop') AS ok FROM events")
def fault_effects(spark, sf):
    k = F.col("event_id")
    draw, rate = (k % 100) / 100.0, (k % 5) / 10.0
    return c.table(spark, sf, "events").select(
        k.alias("seq"), F.round(faults.link_delay(F.col("user_id") % 4, k % 4, draw), 9).alias("link_s"), F.round(faults.delay((k % 7).cast("double"), (k % 3) * 1e6, k * 10), 9).alias("held_s"),
        faults.drops(rate, draw).alias("lost"), faults.blocks(k % 11 == 0, F.array(F.lit(1), F.lit(2)), (k % 4).cast("int")).alias("blocked"), faults.reply(F.col("event_type"))["ok"].alias("ok"),
    )


@query(_with("nodes replicas holdings", ", i AS (SELECT DISTINCT node, file FROM replicas), z AS (SELECT file, sum(size) AS bytes FROM replicas GROUP BY file), p AS (SELECT node, sum(bytes)::BIGINT AS presented, count(*) AS files FROM i JOIN z USING (file) GROUP BY node), h AS (SELECT node, count(*) AS chunks, sum(size)::BIGINT AS physical FROM holdings GROUP BY node) SELECT node, rack, node % 8 <> 5 AS up, coalesce(chunks, 0) AS chunks, coalesce(physical, 0) AS store_bytes, coalesce(files, 0) AS files, coalesce(presented, 0) AS logical_bytes, round(presented / nullif(physical, 0), 2) AS ratio, coalesce(physical, 0) > 600 + node % 7 * 100 AS over_budget FROM nodes LEFT JOIN p USING (node) LEFT JOIN h USING (node)"))
def node_rollup(spark, sf):
    rows = c.replicas(spark, sf)
    return telemetry.node_summary(c.nodes(spark, sf), c.holdings(spark, sf), rows, rows.select("node", "file").distinct(), F.col("node") % 8 == 5, F.lit(600) + F.col("node") % 7 * 100)


@query(_with("telemetry", ", t AS (SELECT name, round(sum(value), 4) AS total FROM telemetry GROUP BY name) SELECT name, total, row_number() OVER (ORDER BY CASE name WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END, name) AS place, (SELECT count(*) FROM (SELECT DISTINCT node FROM telemetry WHERE node % 8 <> 5)) AS alive FROM t"))
def ordered_totals(spark, sf):
    t = c.telemetry(spark, sf)
    alive = t.where("node % 8 <> 5").agg(F.countDistinct("node").alias("alive"))
    return telemetry.ordered(telemetry.counters(t), ["purchase", "view"]).join(F.broadcast(alive), how="cross").select("name", "total", "place", "alive")  # one row


_FILES = "SELECT path, size, hex(encode(data)) AS h, CASE WHEN size % 2 = 1 THEN size + 5 ELSE size // 2 END AS o FROM files"


@query(sql("files", f"SELECT path, octet_length(unhex(n))::BIGINT AS size, sha256(unhex(n)) AS sha256 FROM (SELECT path, rpad(substr(h, 1, 2 * o), (2 * o)::INT, '0') || '45444954' || substr(h, 2 * (o + 4) + 1) AS n FROM ({_FILES}))"))
def edited_files(spark, sf):
    """Four bytes written in the middle of a file, or five bytes behind its end."""
    size = F.col("size")
    at = F.when(size % 2 == 1, size + 5).otherwise(F.floor(size / 2)).cast("int")
    rows = c.files(spark, sf).select("path", manifests.edited(F.col("data").cast("binary"), at, F.lit("EDIT").cast("binary")).alias("data"))
    return rows.select("path", F.octet_length("data").cast("bigint").alias("size"), F.sha2("data", 256).alias("sha256"))


@query(sql("files", "SELECT path, size, 2::BIGINT AS versions, true AS current FROM files"))
def manifest_store(spark, sf):
    """Two versions of every manifest in a store beside a broken line, read back; the second one is current."""
    store = f"{shared_dir(spark)}/manifests-{uuid.uuid4().hex}"
    files = c.files(spark, sf).select("path", "data")
    first = cut(manifests.publish(files, F.lit("n1"), 1.0), "first")
    second = cut(manifests.publish(files, F.lit("n1"), 2.0, first), "second")
    for turn, m in enumerate((first, second)):
        manifests.add_versions(store, m)
        manifests.set_current(store, m, turn)
    manifests.add_versions(store, first)  # known ones are left out
    spark.createDataFrame([('{"path": "/broken", "chu',)], "value string").write.mode("append").text(f"{store}/versions")
    loaded = manifests.load_versions(spark, store)
    count = loaded.groupBy("path").agg(F.count("*").alias("versions"))
    now = loaded.join(manifests.current_refs(spark, store), ["path", "digest"]).select("path", "size", (F.col("created") == 2.0).alias("current"))
    return now.join(count, "path").select("path", "size", "versions", "current")


@query(sql("files", "SELECT path, size, sha256(data) AS sha256, 1.5::DOUBLE AS overhead FROM files WHERE size > 0"))
def coded_repair(spark, sf):
    """Files published in 4 + 2 coded fragments, all whole chunks and two fragments of each lost, put together again."""
    files = c.files(spark, sf).select("path", "data")
    m, pieces = manifests.publish_coded(files, F.lit("n1"), 1.0, 4, 2)
    m, pieces = cut(m, "coded"), cut(pieces, "fragments")
    nothing = spark.createDataFrame([], "hash string")
    made = manifests.repair(m, pieces.where("idx NOT IN (0, 4)"), nothing, 4, 2).where("ok")
    parts = m.select("path", F.posexplode("chunks").alias("seq", "chunk")).join(made, "chunk").groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "data"))), lambda x: x["data"]).alias("parts"))
    whole = parts.select("path", F.aggregate("parts", F.to_binary(F.lit("")), lambda a, x: F.concat(a, x)).alias("data"))
    stats = manifests.coding_stats(m, pieces.select("hash"))
    return whole.join(stats, "path").where("fragments_present = fragments_total").select("path", F.octet_length("data").cast("bigint").alias("size"), F.sha2("data", 256).alias("sha256"), "overhead")


@query(sql("files", "SELECT sha256(data) AS hash, size FROM files WHERE size % 3 <> 0 GROUP BY ALL"))
def store_drop(spark, sf):
    """A store of all payloads without those whose size is divisible by three."""
    store = f"{shared_dir(spark)}/objects-{uuid.uuid4().hex}"
    data = c.files(spark, sf)
    objects.put(store, data.select(F.col("data").cast("binary").alias("data")))
    objects.drop(spark, store, data.where("size % 3 = 0").select(F.sha2("data", 256).alias("hash")))
    return objects.scan(spark, store).select("hash", F.octet_length("data").cast("bigint").alias("size"))


def _entries(spark, sf, where="true"):
    return c.versions(spark, sf).where(where).select(F.concat(F.col("path").cast("string"), F.lit("/"), "digest").alias("key"), F.sha2(F.col("size").cast("bigint").cast("string"), 256).alias("value"))


_BUCKETS = """, e AS (SELECT ('0x' || substr(sha256(path || '/' || digest), 1, 8))::BIGINT % 256 AS idx, path FROM versions) SELECT DISTINCT idx FROM e WHERE path % 50 = 3"""


@query(_with("versions", _BUCKETS))
def merkle_descent(spark, sf):
    """Buckets that differ, found from the root down."""
    levels = [cut(merkle.levels(merkle.leaves(_entries(spark, sf, w))), "levels") for w in ("path % 50 <> 3", "true")]
    return merkle.differing_by_level(*levels)


@query(_with("versions", _BUCKETS + " ORDER BY idx LIMIT 16"))
def merkle_round(spark, sf):
    """The 16 buckets that one round of repair asks for."""
    return merkle.round_of(merkle_descent(spark, sf))


@query()
def transfer_rounds(spark, sf):
    """A transfer plan with chunks in flight, super-seeding and salted ties."""
    h = c.holdings(spark, sf)
    wanted = c.replicas(spark, sf).select((F.col("file") % 10 + 1).alias("node"), "hash").distinct()
    wanted = wanted.join(h, ["node", "hash"], "left_anti")
    holders = wanted.join(h.select("hash", F.col("node").alias("peer")), "hash").where("peer <> node").withColumn("rank", F.abs(F.col("peer") - F.col("node")) % 17)
    return exchange.plan(wanted, holders, _inflight(spark, sf), c.nodes(spark, sf).where("rack < 12"), salt=7)


@query(sql("files", "SELECT path, size, octet_length(encode(data)) > 0 AS has_bytes FROM files"))
def chunked_sizes(spark, sf):
    """Sizes as sums of content-defined chunks."""
    rows = catalog.catalog(gear.chunk_files(c.files(spark, sf)).withColumns({"origin": F.lit(""), "size": F.col("size").cast("bigint")}))
    return c.files(spark, sf).select("path").join(rows, "path", "left").select("path", F.coalesce("bytes", F.lit(0)).alias("size"), (F.coalesce("bytes", F.lit(0)) > 0).alias("has_bytes"))
