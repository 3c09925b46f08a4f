"""All queries of the engine's own operators, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import bloom, gear, reed_solomon, structured
from tessera.operators import agreement, catalog, faults, history, manifests, merkle, replicas, simulate, telemetry
from tessera.plans import cluster_queries  # noqa: F401
from tessera.plans.registry import QUERIES, SQL, query
from tessera.session import cut, shared_dir
from tessera.sources import cluster as c
from tessera.sources import objects
from tessera.sources.cluster import sql
from tessera.streaming import membership

FLAGSHIP = "cluster_summary"
MOMENT = "1995-06-30 00:00:00"
DAY = 86400.0

def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)


def _interest(spark, sf):
    """(node, file): nodes that hold a chunk of a file, and one reader for each file."""
    rows = c.replicas(spark, sf)
    n = c.nodes(spark, sf).agg(F.count("*").alias("n"))
    reader = rows.select("file").distinct().crossJoin(F.broadcast(n)).select((F.col("file") % F.col("n") + 1).alias("node"), "file")  # n is one row
    return rows.select("node", "file").union(reader).distinct()


_INTEREST = "interest AS (SELECT node, file FROM replicas UNION SELECT file % (SELECT count(*) FROM supplier) + 1, file FROM replicas)"
_LINES = "chunks AS (SELECT path, origin, sha256(l) AS hash, octet_length(encode(l))::BIGINT AS size FROM (SELECT path, origin, unnest(string_split(data, chr(10))) AS l FROM files))"
_RESIDENCY = f"""{_INTEREST}, manifest AS (SELECT DISTINCT file, hash FROM replicas),
    residency AS (SELECT i.node, i.file, count(h.hash) AS have, count(*) AS want FROM interest i JOIN manifest m USING (file) LEFT JOIN holdings h ON h.node = i.node AND h.hash = m.hash GROUP BY ALL),
    states AS (SELECT *, CASE WHEN have = want THEN 'RESIDENT' WHEN have > 0 THEN 'PARTIAL' ELSE 'PHANTOM' END AS state FROM residency)"""


@query(sql("replicas holdings", "") + f", {_RESIDENCY} SELECT file, count(*) FILTER (state = 'PHANTOM') AS phantom, count(*) FILTER (state = 'PARTIAL') AS partial, count(*) FILTER (state = 'RESIDENT') AS resident, sum(have)::BIGINT AS have, sum(want)::BIGINT AS want FROM states GROUP BY file")
def cluster_summary(spark, sf):
    return telemetry.summary(residency_state(spark, sf))


@query(sql("files", "") + f", {_LINES} SELECT path, count(*) AS n_chunks, count(DISTINCT hash) AS n_distinct, sum(size)::BIGINT AS bytes FROM chunks GROUP BY path")
def line_chunk_catalog(spark, sf):
    return catalog.catalog(catalog.line_chunks(c.files(spark, sf)))


@query(sql("files", "") + f", {_LINES}, e AS (SELECT origin, hash, sum(size) AS l, max(size) AS p FROM chunks GROUP BY ALL) SELECT origin, sum(l)::BIGINT AS logical_bytes, sum(p)::BIGINT AS physical_bytes, round(coalesce(sum(l) / nullif(sum(p), 0), 1.0), 6) AS ratio FROM e GROUP BY origin")
def dedup_ratio_by_origin(spark, sf):
    return catalog.dedup_ratio(catalog.line_chunks(c.files(spark, sf)), "origin")


@query(sql("files", "SELECT path, CASE WHEN size <= 8388608 THEN 2048 WHEN size <= 268435456 THEN 24576 WHEN size <= 4294967296 THEN 196608 ELSE 393216 END::BIGINT AS min_size, CASE WHEN size <= 8388608 THEN 8192 WHEN size <= 268435456 THEN 65536 WHEN size <= 4294967296 THEN 524288 ELSE 1048576 END::BIGINT AS avg_size, greatest(1, size // 8192)::BIGINT AS expected_chunks FROM files"))
def chunk_profile(spark, sf):
    rows = c.files(spark, sf).withColumn("p", catalog.chunk_profile(F.col("size")))
    return rows.select("path", "p.min_size", "p.avg_size", F.greatest(F.lit(1), F.floor(F.col("size") / 8192)).cast("bigint").alias("expected_chunks"))


@query(sql("replicas holdings", "") + f", {_RESIDENCY} SELECT node, file, have, want, state FROM states")
def residency_state(spark, sf):
    return catalog.residency(_interest(spark, sf), c.replicas(spark, sf), c.holdings(spark, sf))


_WANTED = "wanted AS (SELECT DISTINCT i.node, r.hash FROM interest i JOIN replicas r USING (file))"


def _wanted(spark, sf):
    return _interest(spark, sf).join(c.replicas(spark, sf).select("file", "hash"), "file").select("node", "hash")


@query(sql("replicas holdings", "") + f", {_INTEREST}, {_WANTED} SELECT node, hash FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM holdings h WHERE h.node = w.node AND h.hash = w.hash)")
def missing_chunks(spark, sf):
    return catalog.missing(_wanted(spark, sf), c.holdings(spark, sf))


@query(sql("replicas holdings", "") + f", {_INTEREST}, {_WANTED} SELECT node, hash FROM wanted w WHERE EXISTS (SELECT 1 FROM holdings h WHERE h.node = w.node AND h.hash = w.hash)")
def probe_present(spark, sf):
    return catalog.present(_wanted(spark, sf), c.holdings(spark, sf))


_OFFSETS = "o AS (SELECT file, seq, hash, size, coalesce(sum(size) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM replicas)"


@query(sql("replicas", "") + f", {_OFFSETS} SELECT * FROM o")
def chunk_offsets(spark, sf):
    return catalog.offsets(c.replicas(spark, sf))


@query(sql("replicas", "") + f", {_OFFSETS}, r AS (SELECT DISTINCT file, (file % 40)::BIGINT AS start, (file % 60)::BIGINT AS length FROM replicas) SELECT file, start, length, seq, hash, \"offset\", size FROM o JOIN r USING (file) WHERE length > 0 AND \"offset\" < start + length AND \"offset\" + size > start")
def range_read_chunks(spark, sf):
    rows = c.replicas(spark, sf)
    ranges = rows.select("file").distinct().select("file", (F.col("file") % 40).alias("start"), (F.col("file") % 60).alias("length"))
    return catalog.range_read(rows, ranges)


@query(sql("files", "SELECT path, sha256(unhex(substr(hex(data), 2001, 6000))) AS sha256 FROM files WHERE size > 1000"))
def range_read_bytes(spark, sf):
    """Bytes 1000 to 4000 of each file, put together from its content-defined chunks."""
    rows = gear.chunk_files(c.files(spark, sf), with_data=True)
    hit = rows.where((F.col("offset") < 4000) & (F.col("offset") + F.col("size") > 1000))
    parts = hit.groupBy("path").agg(F.min("offset").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "data"))), lambda x: x["data"]).alias("parts"))
    whole = F.aggregate("parts", F.to_binary(F.lit("")), lambda a, x: F.concat(a, x))
    return parts.select("path", F.sha2(F.substring(whole, (F.lit(1001) - F.col("first")).cast("int"), F.lit(3000)), 256).alias("sha256"))


@query(sql("replicas", "SELECT r.file, seq, hash, size FROM replicas r JOIN (SELECT DISTINCT file, file % 3 AS last FROM replicas WHERE file % 3 > 0 AND seq = file % 3) l USING (file) WHERE seq BETWEEN last + 1 AND last + 8"))
def read_ahead(spark, sf):
    rows = c.replicas(spark, sf)
    return catalog.read_ahead(rows, rows.where("seq = file % 3").select("file", "seq"))


@query(sql("versions", "SELECT path, max_by(digest, (created, digest)) AS digest, max(created) AS created, max_by(origin, (created, digest)) AS origin, max_by(size, (created, digest)) AS size FROM versions GROUP BY path"))
def current_manifest(spark, sf):
    return history.current(c.versions(spark, sf))


@query(sql("versions", "SELECT path, digest, created, row_number() OVER w AS ordinal, lag(digest) OVER w AS previous FROM versions WINDOW w AS (PARTITION BY path ORDER BY created, digest)"))
def version_history(spark, sf):
    return history.history(c.versions(spark, sf))


@query(sql("versions", "SELECT path, digest, created FROM versions QUALIFY row_number() OVER (PARTITION BY path ORDER BY created DESC, digest DESC) = 2"))
def rollback_target(spark, sf):
    return history.rollback_target(c.versions(spark, sf))


_AS_OF = f"SELECT path, max_by(digest, (created, digest)) AS digest, max(created) AS created, max_by(origin, (created, digest)) AS origin, max_by(size, (created, digest)) AS size FROM versions WHERE created <= TIMESTAMP '{MOMENT}' GROUP BY path"


def _moment():
    return F.lit(MOMENT).cast("timestamp_ntz")


@query(sql("versions", _AS_OF))
def snapshot_as_of(spark, sf):
    return history.as_of(c.versions(spark, sf), _moment())


@query(sql("versions", f", s AS ({_AS_OF}), n AS (SELECT path, max_by(digest, (created, digest)) AS digest FROM versions GROUP BY path), k AS (SELECT digest FROM versions WHERE path % 7 <> 0) SELECT coalesce(s.path, n.path) AS path, s.digest AS wanted, n.digest AS have, CASE WHEN s.digest IS NULL THEN 'created_since' WHEN s.digest = n.digest THEN 'already' WHEN s.digest NOT IN (SELECT digest FROM k) THEN 'unknown' ELSE 'restored' END AS action FROM s FULL JOIN n USING (path)").replace(" , s AS", ", s AS"))
def restore_plan(spark, sf):
    v = c.versions(spark, sf)
    return history.restore_plan(history.as_of(v, _moment()), history.current(v), v.where("path % 7 <> 0"))


@query("WITH d AS (SELECT doc_id, source, sha256(l) AS hash, octet_length(encode(l))::BIGINT AS size FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents)), o AS (SELECT doc_id, coalesce(lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id), -1) AS old FROM documents), f AS (SELECT doc_id, hash, max(size) AS size FROM d GROUP BY ALL) SELECT f.doc_id AS path, count(*) FILTER (NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = o.old AND d.hash = f.hash)) AS n_new, coalesce(sum(size) FILTER (NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = o.old AND d.hash = f.hash)), 0)::BIGINT AS bytes_moved FROM f JOIN o USING (doc_id) GROUP BY ALL")
def edit_delta(spark, sf):
    """Each document against the one before it of its source, as if an edit of it."""
    from pyspark.sql import Window

    d = c.table(spark, sf, "documents")
    chunks = catalog.line_chunks(d.select(F.col("doc_id").alias("path"), F.col("source").alias("origin"), F.coalesce("text", F.lit("")).alias("data")))
    before = d.select("doc_id", F.lag("doc_id").over(Window.partitionBy("source").orderBy("doc_id")).alias("old")).where("old IS NOT NULL")
    previous = before.join(chunks.select(F.col("path").alias("old"), "hash"), "old").select(F.col("doc_id").alias("path"), "hash")
    return catalog.edit_delta(chunks, previous)


_VV = "p AS (SELECT path, k, coalesce(sum(v) FILTER (side = 0), 0) AS a, coalesce(sum(v) FILTER (side = 1), 0) AS b FROM vectors GROUP BY ALL)"


@query(sql("vectors", f", {_VV} SELECT path, CASE WHEN bool_or(a < b) AND bool_or(a > b) THEN 'concurrent' WHEN bool_or(a < b) THEN 'before' WHEN bool_or(a > b) THEN 'after' ELSE 'equal' END AS causality FROM p GROUP BY path").replace(" , p AS", ", p AS"))
def vv_compare(spark, sf):
    return c.vectors(spark, sf).select("path", history.compare(F.col("a"), F.col("b")).alias("causality"))


@query(sql("vectors", f", {_VV} SELECT path, k, greatest(a, b)::BIGINT AS v FROM p").replace(" , p AS", ", p AS"))
def vv_merge(spark, sf):
    return c.vectors(spark, sf).select("path", F.explode(history.merge(F.col("a"), F.col("b"))).alias("k", "v"))


@query(sql("versions", ", b AS (SELECT path, max(digest) AS winner FROM versions GROUP BY path HAVING count(DISTINCT digest) > 1) SELECT DISTINCT path, winner, digest AS loser, path || '.conflict-' || origin || '-' || substr(digest, 1, 8) AS side_path FROM versions JOIN b USING (path) WHERE digest <> winner").replace(" , b AS", ", b AS"))
def conflict_resolution(spark, sf):
    return history.resolve_conflicts(c.versions(spark, sf))


def _entries(spark, sf):
    return c.versions(spark, sf).select(F.concat(F.col("path").cast("string"), F.lit("/"), "digest").alias("key"), F.sha2(F.col("size").cast("bigint").cast("string"), 256).alias("value"))


def _leaf_sql(name: str, where: str = "") -> str:
    return f"""{name}e AS (SELECT path || '/' || digest AS key, sha256(trunc(size)::BIGINT::VARCHAR) AS value FROM versions {where}),
    {name} AS (SELECT i.idx, coalesce(h.hash, repeat('0', 64)) AS hash FROM (SELECT unnest(range(256)) AS idx) i LEFT JOIN
    (SELECT ('0x' || substr(sha256(key), 1, 8))::BIGINT % 256 AS idx, sha256(string_agg(key || chr(31) || value || chr(31), '' ORDER BY key, value)) AS hash FROM {name}e GROUP BY 1) h ON h.idx = i.idx)"""


@query(sql("versions", "") + f", {_leaf_sql('l')} SELECT idx, hash FROM l")
def merkle_leaves(spark, sf):
    return merkle.leaves(_entries(spark, sf))


def _levels_sql() -> str:
    out, union = _leaf_sql("l0"), "SELECT 0 AS level, idx, hash FROM l0"
    for k in range(1, 9):
        out += f", l{k} AS (SELECT idx // 2 AS idx, sha256(string_agg(hash || chr(31), '' ORDER BY idx)) AS hash FROM l{k - 1} GROUP BY 1)"
        union += f" UNION ALL SELECT {k}, idx, hash FROM l{k}"
    return f", {out} {union}"


@query(sql("versions", "") + _levels_sql())
def merkle_root(spark, sf):
    return merkle.levels(merkle.leaves(_entries(spark, sf)))


@query(sql("versions", "") + f", {_leaf_sql('l', 'WHERE path % 50 <> 3')}, {_leaf_sql('r')} SELECT re.key, r.idx, CASE WHEN le.value IS NULL THEN 'absent' ELSE 'different' END AS why FROM re JOIN r ON r.idx = ('0x' || substr(sha256(re.key), 1, 8))::BIGINT % 256 JOIN l ON l.idx = r.idx AND l.hash <> r.hash LEFT JOIN le ON le.key = re.key WHERE re.value IS DISTINCT FROM le.value")
def merkle_diff(spark, sf):
    remote = _entries(spark, sf)
    return merkle.divergent_keys(remote.where("cast(split(key, '/')[0] as bigint) % 50 <> 3"), remote)


def _roots_sql() -> str:
    out = """, f AS (SELECT node, ('0x' || substr(sha256(label), 1, 8))::BIGINT % 256 AS idx, sha256(string_agg(label || chr(31) || hash || chr(31), '' ORDER BY label, hash)) AS hash FROM labelled GROUP BY ALL),
    l0 AS (SELECT n.node, i.idx, coalesce(f.hash, repeat('0', 64)) AS hash FROM (SELECT DISTINCT node FROM labelled) n CROSS JOIN (SELECT unnest(range(256)) AS idx) i LEFT JOIN f ON f.node = n.node AND f.idx = i.idx)"""
    for k in range(1, 9):
        out += f", l{k} AS (SELECT node, idx // 2 AS idx, sha256(string_agg(hash || chr(31), '' ORDER BY idx)) AS hash FROM l{k - 1} GROUP BY node, idx // 2)"
    return out + ", r AS (SELECT node, hash AS root FROM l8), g AS (SELECT root, count(*) AS n, min(node) AS f FROM r GROUP BY root), m AS (SELECT (SELECT root FROM g ORDER BY n DESC, f LIMIT 1) AS majority, (SELECT count(*) FROM g) AS n_roots) SELECT node, root, majority, n_roots, root = majority AS agrees FROM r, m"


@query(sql("labelled", _roots_sql()).replace(" , f AS", ", f AS"))
def consistency_vote(spark, sf):
    return agreement.consistency(agreement.namespace_roots(c.labelled(spark, sf)))


@query(sql("labelled", ", e AS (SELECT l.label, n.node, x.hash FROM (SELECT DISTINCT label FROM labelled) l CROSS JOIN (SELECT DISTINCT node FROM labelled) n LEFT JOIN labelled x ON x.label = l.label AND x.node = n.node), g AS (SELECT label, hash, count(*) AS n, min(node) AS f FROM e GROUP BY ALL), m AS (SELECT label, hash AS majority_hash, n AS majority_count FROM g QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, f) = 1) SELECT e.label, majority_hash, majority_count, node, hash FROM e JOIN m ON m.label = e.label WHERE e.hash IS DISTINCT FROM majority_hash").replace(" , e AS", ", e AS"))
def config_drift(spark, sf):
    return agreement.drift(c.labelled(spark, sf))


@query(sql("holdings", "SELECT hash, count(*) AS holders FROM holdings GROUP BY hash"))
def replica_rarity(spark, sf):
    return replicas.rarity(c.holdings(spark, sf))


@query(sql("replicas holdings", "") + f", {_INTEREST}, {_WANTED}, r AS (SELECT hash, count(*) AS holders FROM holdings GROUP BY hash) SELECT node, hash, holders, row_number() OVER (PARTITION BY node ORDER BY holders, hash) AS rank FROM wanted w JOIN r USING (hash) WHERE NOT EXISTS (SELECT 1 FROM holdings h WHERE h.node = w.node AND h.hash = w.hash) QUALIFY rank <= 20")
def rarest_first_topk(spark, sf):
    return replicas.rarest_first(_wanted(spark, sf), c.holdings(spark, sf), 20)


@query(sql("nodes", "SELECT o.node AS observer, p.node, (o.rack <> p.rack)::INT AS other_rack, row_number() OVER (PARTITION BY o.node ORDER BY o.rack <> p.rack, abs(o.node - p.node) % 17, p.node) AS rank FROM nodes o JOIN nodes p ON o.node <> p.node"))
def peer_proximity(spark, sf):
    nodes = c.nodes(spark, sf)
    return replicas.proximity(nodes, nodes, F.abs(F.col("observer") - F.col("node")) % 17)


@query()
def transfer_plan(spark, sf):
    return replicas.transfer_plan(_wanted(spark, sf), c.holdings(spark, sf))


@query(sql("replicas holdings", ", r AS (SELECT hash, count(*) AS n FROM holdings GROUP BY hash), m AS (SELECT DISTINCT file, hash FROM replicas) SELECT file, min(coalesce(n, 0)) - 1 AS survives, count(*) AS n_chunks FROM m LEFT JOIN r USING (hash) GROUP BY file").replace(" , r AS", ", r AS"))
def durability_plain(spark, sf):
    return replicas.durability_plain(c.replicas(spark, sf), c.holdings(spark, sf))


_CODED = """, ch AS (SELECT file, hash FROM replicas), c0 AS (SELECT DISTINCT hash FROM replicas WHERE hash % 3 = 0),
    copies AS (SELECT hash, count(*) AS n FROM holdings GROUP BY hash),
    have AS (SELECT c0.hash, h.node, count(*) AS n FROM c0 JOIN holdings h ON h.hash BETWEEN c0.hash + 1 AND c0.hash + 6 GROUP BY ALL),
    free AS (SELECT c0.hash, l.node, coalesce(have.n, 0) AS n FROM c0 CROSS JOIN (SELECT DISTINCT node FROM holdings) l LEFT JOIN have ON have.hash = c0.hash AND have.node = l.node
             WHERE NOT EXISTS (SELECT 1 FROM holdings w WHERE w.hash = c0.hash AND w.node = l.node)),
    remain AS (SELECT c0.hash, count(DISTINCT h.hash) AS r FROM c0 JOIN holdings h ON h.hash BETWEEN c0.hash + 1 AND c0.hash + 6
             WHERE NOT EXISTS (SELECT 1 FROM holdings w WHERE w.hash = c0.hash AND w.node = h.node) GROUP BY c0.hash),
    steps AS (SELECT hash, r - sum(n) OVER (PARTITION BY hash ORDER BY n DESC, node) >= 4 AS stands FROM free JOIN remain USING (hash)),
    fell AS (SELECT hash, count(*) FILTER (stands) AS f FROM steps GROUP BY hash)
    SELECT file, greatest(-1, min(coalesce(n, 0) + coalesce(CASE WHEN ch.hash % 3 = 0 THEN f END, 0) - 1)) AS survives, count(*) AS n_chunks, bool_or(ch.hash % 3 = 0) AS coded
    FROM ch LEFT JOIN copies USING (hash) LEFT JOIN fell USING (hash) GROUP BY file"""


@query(sql("replicas holdings", _CODED).replace(" , ch AS", ", ch AS"))
def durability_coded(spark, sf):
    """Every third chunk is coded: its fragments are the six chunks after it, of which four are needed."""
    rows = c.replicas(spark, sf).select("file", "seq", "hash", F.when(F.col("hash") % 3 == 0, 4).alias("k"))
    fragments = rows.where("k IS NOT NULL").select("hash").distinct().select("hash", F.explode(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.col("hash") + i)).alias("fragment"))
    return replicas.durability(rows, fragments, c.holdings(spark, sf))


_PROTECTED = "protected AS (SELECT node, hash FROM holdings WHERE hash % 11 = 0 OR (hash + node) % 13 = 0 OR hash % 17 = 2)"


def _protected(spark, sf):
    h = c.holdings(spark, sf)
    return replicas.protected(h.where("hash % 11 = 0"), h.where("(hash + node) % 13 = 0"), h.where("hash % 17 = 2"))


@query(sql("holdings", "") + f", {_PROTECTED} SELECT node, hash FROM protected")
def protected_set(spark, sf):
    return _protected(spark, sf)


@query(sql("holdings", "") + f", {_PROTECTED}, t AS (SELECT *, sum(size) OVER (PARTITION BY node) AS physical, floor((600 + node % 7 * 100) * 0.85) AS target FROM holdings), x AS (SELECT t.*, coalesce(sum(size) OVER (PARTITION BY node ORDER BY atime, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS freed FROM t WHERE physical > 600 + node % 7 * 100 AND hash % 5 <> 4 AND NOT EXISTS (SELECT 1 FROM protected g WHERE g.node = t.node AND g.hash = t.hash)) SELECT node, hash, size, freed FROM x WHERE physical - freed > target")
def evict_plan(spark, sf):
    h = c.holdings(spark, sf)
    return replicas.evict(h, _protected(spark, sf), F.lit(600) + F.col("node") % 7 * 100, wanted=h.where("hash % 5 = 4"))


@query(sql("replicas holdings", "") + f", {_INTEREST}, s AS (SELECT file, sum(size) AS bytes FROM replicas GROUP BY file), p AS (SELECT node, sum(bytes)::BIGINT AS presented FROM interest JOIN s USING (file) GROUP BY node), q AS (SELECT node, sum(size)::BIGINT AS physical FROM holdings GROUP BY node) SELECT node, coalesce(presented, 0) AS presented, coalesce(physical, 0) AS physical, round(presented / nullif(physical, 0), 2) AS ratio FROM p FULL JOIN q USING (node)")
def overcommit(spark, sf):
    return catalog.overcommit(c.replicas(spark, sf), c.holdings(spark, sf), _interest(spark, sf))


@query(sql("holdings", ", r AS (SELECT node, hash, row_number() OVER (PARTITION BY node ORDER BY hash) - 1 AS pos, count(*) OVER (PARTITION BY node) AS n FROM holdings), b AS (SELECT *, greatest(16, n // 4 + 1) AS batch FROM r) SELECT node, hash, pos FROM b WHERE ((pos - batch * 3) % n + n) % n < batch").replace(" , r AS", ", r AS"))
def scrub_batch(spark, sf):
    return replicas.scrub_batch(c.holdings(spark, sf), 3, 4)


@query(sql("telemetry", "SELECT name, round(sum(value), 4) AS total, count(*) AS n FROM telemetry GROUP BY name"))
def counter_totals(spark, sf):
    return telemetry.counters(c.telemetry(spark, sf))


@query(sql("telemetry", "SELECT node, name, round(max_by(value, (ts, seq)), 6) AS value FROM telemetry GROUP BY ALL"))
def gauge_last(spark, sf):
    return telemetry.gauges(c.telemetry(spark, sf))


@query(sql("telemetry", "SELECT node, name, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS max FROM telemetry GROUP BY ALL"))
def timer_stats(spark, sf):
    return telemetry.timers(c.telemetry(spark, sf))


@query(sql("telemetry", "SELECT seq, node, name, ts FROM telemetry ORDER BY ts DESC, seq DESC LIMIT 600"))
def recent_events(spark, sf):
    """The newest 600 events: a top-k report."""
    return telemetry.recent(c.telemetry(spark, sf), 600)


@query(sql("telemetry", "SELECT node, seq, name FROM telemetry QUALIFY row_number() OVER (PARTITION BY node ORDER BY seq DESC) <= 5"))
def node_event_ring(spark, sf):
    return telemetry.latest_counts(c.telemetry(spark, sf), 5)


_NOW = "(SELECT max(ts) FROM events)"


@query(sql("telemetry", f", l AS (SELECT node, max(ts) AS last_seen FROM telemetry GROUP BY node) SELECT node, last_seen, CASE WHEN epoch({_NOW}) // 1 - epoch(last_seen) // 1 > 15 * 3600 THEN 'DEAD' WHEN epoch({_NOW}) // 1 - epoch(last_seen) // 1 > 6 * 3600 THEN 'SUSPECT' ELSE 'ALIVE' END AS state FROM l").replace(" , l AS", ", l AS"))
def member_state(spark, sf):
    t = c.telemetry(spark, sf)
    now = t.agg(F.max("ts")).first()[0]
    return telemetry.member_state(t, F.lit(now).cast("timestamp_ntz"), 3600.0)


@query(sql("telemetry", ", v AS (SELECT node, list(value ORDER BY ts, seq) AS v FROM telemetry GROUP BY node) SELECT node, round(list_reduce(list_prepend(0.05::DOUBLE, v), lambda a, x: 0.75 * a + 0.25 * x), 6) AS rtt, len(v)::BIGINT AS n FROM v").replace(" , v AS", ", v AS"))
def rtt_ewma(spark, sf):
    return telemetry.ewma(c.telemetry(spark, sf))


@query(sql("telemetry", "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, name, count(*) AS n, round(sum(value), 4) AS total FROM telemetry GROUP BY ALL"))
def telemetry_tumbling(spark, sf):
    return telemetry.tumbling(c.telemetry(spark, sf), "6 hours")


@query(sql("telemetry", ", g AS (SELECT node, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY node ORDER BY ts) + INTERVAL 6 HOURS THEN 1 ELSE 0 END AS s FROM telemetry), h AS (SELECT node, ts, sum(s) OVER (PARTITION BY node ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT node, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS \"end\", count(*) AS n FROM h GROUP BY node, k").replace(" , g AS", ", g AS"))
def telemetry_session(spark, sf):
    return telemetry.sessions(c.telemetry(spark, sf), "6 hours")


@query(sql("files", "SELECT path, size, sha256(data) AS sha256, true AS hashes_match FROM files WHERE size > 0"))
def cdc_roundtrip(spark, sf):
    """Files put together again from their content-defined chunks."""
    rows = gear.chunk_files(c.files(spark, sf), with_data=True)
    whole = rows.groupBy("path").agg(F.sum(F.col("size").cast("bigint")).alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "data"))), lambda x: x["data"]).alias("parts"), F.bool_and(F.sha2("data", 256) == F.col("hash")).alias("hashes_match"))
    return whole.select("path", "size", F.sha2(F.aggregate("parts", F.to_binary(F.lit("")), lambda a, x: F.concat(a, x)), 256).alias("sha256"), "hashes_match")


@query()
def cdc_chunks(spark, sf):
    pages = c.table(spark, sf, "pages").select(F.concat(F.lit("/pages/"), F.col("page_id").cast("string")).alias("path"), F.col("html").alias("data"))
    return gear.chunk_files(c.files(spark, sf).select("path", "data").unionByName(pages))


@query()
def cdc_dedup(spark, sf):
    """Dedup accounting of content-defined chunks by origin."""
    files = c.files(spark, sf)
    chunks = gear.chunk_files(files).withColumn("origin", F.split_part("path", F.lit("/"), F.lit(2)))
    return catalog.dedup_ratio(chunks.withColumn("size", F.col("size").cast("bigint")), "origin")


def _configs(spark, sf):
    d = c.labelled(spark, sf)
    body = F.array_join(F.array_sort(F.collect_list(F.concat("label", F.lit(": "), F.substring("hash", 1, 8), F.lit("\n")))), "")
    return d.groupBy("node").agg(F.concat(F.lit("# node settings\n"), body).alias("data")).select(F.concat(F.lit("/etc/node-"), F.col("node").cast("string"), F.lit(".yaml")).alias("path"), "data")


@query(sql("labelled", ", k AS (SELECT node, label, row_number() OVER (PARTITION BY node ORDER BY label || ': ' || substr(hash, 1, 8)) AS seq, length(label) + 11 AS n FROM labelled), o AS (SELECT *, 16 + coalesce(sum(n) OVER (PARTITION BY node ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM k) SELECT '/etc/node-' || node || '.yaml' AS path, seq::INT AS seq, label, start, start + n AS \"end\" FROM o UNION ALL SELECT DISTINCT '/etc/node-' || node || '.yaml', 0, '<preamble>', 0, 16 FROM k").replace(" , k AS", ", k AS"))
def structured_split(spark, sf):
    return structured.split_files(_configs(spark, sf))


@query(sql("files", "SELECT path, size, sha256(data) AS sha256 FROM files"))
def rs_roundtrip(spark, sf):
    """Files decoded again after the loss of two of six fragments."""
    fragments = reed_solomon.encode_files(c.files(spark, sf), 4, 2)
    kept = fragments.where(~F.col("idx").isin(1, 3))
    return reed_solomon.decode_files(kept, 4, 2).select("path", F.octet_length("data").cast("bigint").alias("size"), F.sha2("data", 256).alias("sha256"))


@query(sql("holdings", "SELECT count(*) AS n, 0::BIGINT AS misses FROM holdings"))
def bloom_no_false_negatives(spark, sf):
    items = c.holdings(spark, sf).select("node", F.col("hash").cast("string").alias("item"))
    expected = items.groupBy("node").count().agg(F.max("count")).first()[0] or 0
    found = bloom.probe(items, bloom.build(items, expected), expected)
    return found.agg(F.count("*").alias("n"), F.count_if(~F.col("maybe")).alias("misses"))


@query()
def stream_member_state(spark, sf):
    """The state that the stream told of each node with its last event (told), and what it is at the stream's end."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = membership.run_once(membership.track(membership.events_stream(spark, sf), 3600.0), path, "update")
    out = out.groupBy("node").agg(F.max_by(F.struct("heartbeat", "last_seen", "state"), "heartbeat").alias("x")).select("node", "x.heartbeat", "x.last_seen", F.col("x.state").alias("told"))
    out = cut(out, "stream-state")
    now = out.agg(F.max("last_seen").alias("now"))
    age = (F.unix_timestamp("now") - F.unix_timestamp("last_seen")) / 3600.0
    return out.join(F.broadcast(now), how="cross").select("node", "heartbeat", "last_seen", "told", telemetry.state_of_age(age).alias("state"))  # now is one row


@query()
def sim_sweep(spark, sf):
    return simulate.sweep(spark, [10, 25, 50], 4 << 20, 64)


@query(sql("files", "SELECT path, CASE WHEN size * 997 < 1024 THEN (size * 997) || ' B' WHEN size * 997 < 1048576 THEN printf('%.1f KB', size * 997 / 1024.0::DOUBLE) WHEN size * 997 < 1073741824 THEN printf('%.1f MB', size * 997 / 1048576.0::DOUBLE) ELSE printf('%.1f GB', size * 997 / 1073741824.0::DOUBLE) END AS shown FROM files"))
def human_sizes(spark, sf):
    return c.files(spark, sf).select("path", faults.human_bytes(F.col("size") * 997).alias("shown"))


_ACTIONS = "a AS (SELECT user_id AS node, event_id AS seq, CASE event_id % 9 WHEN 0 THEN 'kill' WHEN 1 THEN 'revive' WHEN 2 THEN 'latency' WHEN 3 THEN 'throttle' WHEN 4 THEN 'drop' WHEN 5 THEN 'byzantine' WHEN 6 THEN 'partition' WHEN 7 THEN 'heal' ELSE CASE WHEN event_id % 5 = 0 THEN 'reset' ELSE 'latency' END END AS action, (event_id % 3)::DOUBLE AS value, CASE WHEN event_id % 4 > 0 THEN event_id % 6 END AS peer FROM events)"


def _actions(spark, sf):
    k = F.col("event_id")
    names = ("kill", "revive", "latency", "throttle", "drop", "byzantine", "partition", "heal")
    action = F.when(k % 9 == 8, F.when(k % 5 == 0, "reset").otherwise("latency"))
    for i, name in enumerate(names):
        action = action.when(k % 9 == i, name)
    return c.table(spark, sf, "events").select(F.col("user_id").alias("node"), k.alias("seq"), action.alias("action"), (k % 3).cast("double").alias("value"), F.when(k % 4 > 0, k % 6).alias("peer"))


@query(f"WITH {_ACTIONS}, r AS (SELECT a.*, max(CASE WHEN action = 'reset' THEN seq END) OVER (PARTITION BY node) AS z FROM a), l AS (SELECT * FROM r WHERE z IS NULL OR seq >= z) SELECT node, coalesce(max_by(action, seq) FILTER (action IN ('kill', 'revive')) = 'kill', false) AS killed, coalesce(max_by(value, seq) FILTER (action = 'latency'), 0.0) AS latency_ms, coalesce(max_by(value, seq) FILTER (action = 'throttle'), 0.0) AS throughput_bps, coalesce(max_by(value, seq) FILTER (action = 'drop'), 0.0) AS drop_rate, coalesce(max_by(value, seq) FILTER (action = 'byzantine'), 0.0) > 0 AS byzantine FROM l GROUP BY node")
def chaos_state(spark, sf):
    return faults.fault_state(_actions(spark, sf))


@query(f"WITH {_ACTIONS}, r AS (SELECT a.*, coalesce(max(CASE WHEN action IN ('heal', 'reset') AND (peer IS NULL OR action = 'reset') THEN seq END) OVER (PARTITION BY node), -1) AS z FROM a) SELECT node, peer FROM r WHERE seq > z AND peer IS NOT NULL AND action IN ('partition', 'heal') GROUP BY node, peer HAVING max_by(action, seq) = 'partition'")
def chaos_partitions(spark, sf):
    rows = _actions(spark, sf)
    return faults.partitions(rows.withColumn("peer", F.when(F.col("action") != "reset", F.col("peer"))))


@query("WITH n AS (SELECT max(l_shipdate) AS m FROM lineitem), r AS (SELECT l_suppkey AS node, l_partkey AS hash, max(l_shipdate) AS ts, arg_max(l_orderkey % 3 > 0, (l_shipdate, l_orderkey % 3 > 0)) AS present FROM lineitem GROUP BY ALL) SELECT node, hash, CASE WHEN present THEN 'holds' WHEN epoch(ts) + 86400 * 400 > epoch(m) THEN 'denied' ELSE 'unknown' END AS belief FROM r, n")
def denied_holders(spark, sf):
    """What is known of replicas at the end of the table; a denial holds for 400 days."""
    rows = c.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("hash"), F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") % 3 > 0).alias("present"))
    now = rows.agg(F.max("ts")).first()[0]
    last = rows.groupBy("node", "hash", "ts").agg(F.bool_or("present").alias("present"))
    return faults.known_holders(last, F.lit(now).cast("timestamp_ntz"), 400 * DAY)


@query("WITH r AS (SELECT user_id AS id, event_id % 50 AS hb, event_id AS seq, event_type AS host FROM events) SELECT id, max(hb) AS hb, max_by(host, (hb, -seq)) AS host, min(seq) AS learned FROM r GROUP BY id")
def membership_merge(spark, sf):
    e = c.table(spark, sf, "events")
    return faults.merge_members(e.select(F.col("user_id").alias("id"), (F.col("event_id") % 50).alias("hb"), F.col("event_id").alias("seq"), F.col("event_type").alias("host")))


@query("SELECT l_suppkey AS node, l_partkey AS hash, sum(CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING sum(CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END) > 0")
def pinned_chunks(spark, sf):
    rows = c.table(spark, sf, "lineitem")
    return faults.pins(rows.select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("hash"), F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(-1).alias("delta")))


@query(sql("files", "SELECT path, size, 1::BIGINT AS bumps FROM files UNION ALL SELECT DISTINCT '/etc/node-' || user_id % 12 || '.yaml', NULL, 1 FROM events").replace("NULL", "(SELECT 16 + sum(n)::BIGINT FROM (SELECT DISTINCT user_id % 12 AS u, event_type, length(event_type) + 11 AS n FROM events) q WHERE q.u = user_id % 12)"))
def publish_manifests(spark, sf):
    """All payloads and node settings published: each manifest's size is that of its file."""
    rows = c.files(spark, sf).select("path", "data").unionByName(_configs(spark, sf))
    m = manifests.publish(rows, F.split_part("path", F.lit("/"), F.lit(2)), 1.0)
    return m.select("path", "size", F.try_element_at("vv", F.col("origin")).alias("bumps"))


@query(sql("labelled", "SELECT '/etc/node-' || node || '.yaml' AS path, label, sha256(label || ': ' || substr(hash, 1, 8) || chr(10)) AS hash FROM labelled"))
def manifest_labels(spark, sf):
    return manifests.label_map(manifests.publish(_configs(spark, sf), F.lit("n0"), 1.0))


@query(sql("files", "SELECT sha256(data) AS hash, size FROM files GROUP BY ALL"))
def object_store(spark, sf):
    """All payloads put into an object store twice, and read back."""
    store = f"{shared_dir(spark)}/objects-{uuid.uuid4().hex}"
    data = c.files(spark, sf).select(F.col("data").cast("binary").alias("data"), F.sha2("data", 256).alias("expected"))
    objects.put(store, data)
    objects.put(store, data)
    return objects.scan(spark, store).select("hash", F.octet_length("data").cast("bigint").alias("size"))
