"""Known answers on small clusters."""

import pytest
from pyspark.sql import functions as F
from tessera.functions.bloom import Bloom, sizing
from tessera.operators import exchange, faults, manifests, merkle, replicas
from tessera.plans import catalogue
from tessera.sources import objects

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_eviction_spares_pinned_and_wanted(spark):
    hold = spark.createDataFrame([(1, h, 10, h) for h in (1, 2, 3, 4)], "node bigint, hash bigint, size bigint, atime bigint")
    pair = lambda *h: spark.createDataFrame([(1, x) for x in h], "node bigint, hash bigint")
    safe = replicas.protected(pair(1, 3), pair(3))
    assert rows(safe) == [(1, 1), (1, 3)]
    # 1 pinned, 2 wanted, 3 both, 4 neither: only the last one may go
    assert rows(replicas.evict(hold, safe, F.lit(5), wanted=pair(2, 3))) == [(1, 4, 10, 0)]


def test_coded_durability(spark):
    chunks = spark.createDataFrame([(1, 0, 10, 2), (1, 1, 20, None), (2, 0, 10, 2), (3, 0, 30, 2), (4, 0, 40, None)], "file int, seq int, hash bigint, k int")
    parts = spark.createDataFrame([(10, 11), (10, 12), (10, 13), (30, 31), (30, 32)], "hash bigint, fragment bigint")
    hold = [(1, 10), (2, 11), (3, 12), (4, 12), (4, 13), (5, 20), (6, 20), (7, 20), (5, 31)]
    got = rows(replicas.durability(chunks, parts, spark.createDataFrame(hold, "node bigint, hash bigint")))
    # 10: node 1 falls with the whole copy; of three fragments node 4 has two, and two must remain: none more
    # 30: one fragment of two needed; 40: nobody has it
    assert got == [(1, 0, 2, True), (2, 0, 1, True), (3, -1, 1, True), (4, -1, 1, False)]


def test_acceptance_by_version_vector(spark):
    schema = "path string, digest string, vv map<string,bigint>, origin string"
    local = spark.createDataFrame([("a", "1", {"x": 1}, "x"), ("b", "1", {"x": 2}, "x"), ("c", "1", {"x": 1}, "x"), ("d", "5", {"x": 1}, "x"), ("e", "1", {"x": 1}, "x")], schema)
    remote = spark.createDataFrame([("a", "1", {"x": 1}, "x"), ("b", "2", {"x": 1}, "y"), ("c", "2", {"x": 1, "y": 1}, "y"), ("d", "4", {"y": 3}, "y"), ("e", "2", {"x": 1}, "y"), ("f", "9", {"y": 1}, "y")], schema)
    got = {r.path: r for r in exchange.accept(local, remote).collect()}
    assert {p: r.outcome for p, r in got.items()} == {"a": "duplicate", "b": "stale", "c": "accepted", "d": "conflict", "e": "conflict", "f": "accepted"}
    assert got["d"].digest == "5" and got["d"].vv == {"x": 1, "y": 3} and got["d"].side_path == "d.conflict-y-4" and got["d"].loser == "4"
    assert got["e"].digest == "2" and got["e"].side_path == "e.conflict-x-1" and got["c"].side_path is None
    assert {r.path for r in exchange.worth_asking(local, remote).collect()} == {"c", "d", "f"}


def test_plan_keeps_capacity_and_prefers_the_swarm(spark):
    wanted = spark.createDataFrame([(1, h) for h in range(20)], "node bigint, hash bigint")
    holders = spark.createDataFrame([(1, h, p, p) for h in range(20) for p in (2, 3, 4, 1) if p != 2 or h % 2], "node bigint, hash bigint, peer bigint, rank bigint")
    flying = spark.createDataFrame([(1, 0, 3), (1, 1, 3)], "node bigint, hash bigint, peer bigint")
    origin = spark.createDataFrame([(2,)], "node bigint")
    got = exchange.plan(wanted, holders, flying, origin, limit=16).collect()
    load = {p: sum(r.peer == p for r in got) for p in (1, 2, 3, 4)}
    assert load == {1: 0, 2: 4, 3: 2, 4: 4} and not {0, 1} & {r.hash for r in got}
    assert sorted(r.step for r in got) == list(range(1, 11)) and all(r.rarity == 2 + r.hash % 2 for r in got)
    left, known = exchange.complete(flying, flying.withColumn("ok", F.col("hash") == 1))
    assert rows(left) == [] and rows(known) == [(3, 1)]
    assert len(exchange.plan(wanted, holders, limit=16, salt=3).collect()) == 12
    assert exchange.plan(wanted.limit(0), holders).count() == 0


def test_peers(spark):
    members = spark.createDataFrame([(o, n, "DEAD" if n == 3 else "ALIVE") for o in range(4) for n in range(9) if o != n], "observer bigint, node bigint, state string")
    got = rows(exchange.sample_peers(members, 3, 1))
    assert len(got) == 12 and all(n != 3 for _, n in got) and got == rows(exchange.sample_peers(members, 3, 1))
    one = spark.createDataFrame([("n1", "h", 70, "r0", 4, "ALIVE", 0.123456, 9)], "id string, host string, port int, rack string, hb int, state string, rtt double, have int")
    assert rows(exchange.peer_records(one)) == [("n1", "h:70", '{"id":"n1","host":"h","port":70,"rack":"r0","hb":4,"state":"ALIVE","rtt":0.1235,"have":9}')]
    nodes = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "node bigint, rack int")
    near = replicas.proximity(nodes, nodes.where("node = 1"), F.lit(0), F.when(F.col("node") == 2, 5).otherwise(0))
    assert [r.node for r in near.orderBy("rank").collect()] == [3, 2]
    files = spark.createDataFrame([("/a", 2048, 1, "RESIDENT", "n1")], "path string, size bigint, chunks int, state string, origin string")
    assert rows(exchange.listing(files)) == [("/a", "2.0 KB", 1, "RESIDENT", "n1")]
    assert rows(exchange.forget(nodes, nodes.where("node < 3"))) == [(3, 1)]


def test_fault_replies_and_addresses(spark):
    df = spark.createDataFrame([("kill", "h:80"), ("explode", "90"), (None, "x:1")], "action string, at string")
    assert rows(df.select("at", faults.reply(F.col("action")).alias("r"), faults.address(F.col("at")).alias("a")).select("at", "r.*", "a.*")) == [
        ("90", False, "unknown action explode", "127.0.0.1", 90), ("h:80", True, None, "h", 80), ("x:1", False, None, "x", 1)
    ]


def test_bloom_codec():
    m, k = sizing(100, 0.02)
    b = Bloom(m, k)
    for x in "abc":
        b.add(x)
    again = Bloom.from_dict(b.to_dict())
    assert again.to_dict() == b.to_dict() and "a" in again and again.nbytes() == (m + 7) // 8


def test_descent_of_unlike_trees_and_namespace_roots(spark):
    entries = spark.createDataFrame([(n, f"k{i}", f"v{i * (n > 1)}") for n in (1, 2, 3) for i in range(20)], "node int, key string, value string")
    a, b = (merkle.levels(merkle.leaves(entries.where(f"node = {n}"), s), s) for n, s in ((1, 8), (2, 16)))
    assert rows(merkle.differing_by_level(a, b, 8)) == [(i,) for i in range(8)]
    own = dict(rows(merkle.roots(entries, "node", 16)))
    top = lambda n: merkle.levels(merkle.leaves(entries.where(f"node = {n}"), 16), 16).where("level = 4").first().hash
    assert own == {n: top(n) for n in (1, 2, 3)} and own[1] != own[2] == own[3]


def test_store_scrub(spark, tmp_path):
    store = f"{tmp_path}/store"
    data = spark.createDataFrame([(bytearray(x.encode()),) for x in ("one", "two", "three")], "data binary")
    assert objects.put(store, data).count() == 3 and objects.put(store, data).count() == 0
    digest = objects.scan(spark, store).where("data = cast('two' AS binary)").first().hash
    assert objects.get(spark, store, digest).first().data == b"two"
    bad = spark.createDataFrame([("ab" * 32, 3, bytearray(b"bad"), "ab")], objects.SCHEMA)
    bad.write.mode("append").partitionBy("h2").parquet(store)
    assert rows(objects.scrub(spark, store)) == [("ab" * 32,)] and rows(objects.damaged(spark, store)) == []
    assert objects.scan(spark, store).count() == 3
    with pytest.raises(Exception, match="hash mismatch"):
        objects.put(store, spark.createDataFrame([(bytearray(b"x"), "00")], "data binary, expected string"))


def test_manifest_digests_and_sizes(spark):
    m = manifests.publish(spark.createDataFrame([("/a", "hello")], "path string, data string"), F.lit("n1"), 1.5).first()
    import hashlib
    import json

    chunk = hashlib.sha256(b"hello").hexdigest()
    full = {"path": "/a", "size": 5, "mode": 420, "mtime": 1.5, "chunks": [chunk], "sizes": [5], "vv": {"n1": 1}, "origin": "n1", "created": 1.5, "deleted": False, "note": "", "labels": None, "ec": None}
    say = lambda d: hashlib.sha256(json.dumps(d, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert m.digest == say(full) and m.content_id == say({k: full[k] for k in ("path", "size", "chunks", "sizes", "labels", "ec")})
    assert manifests.nbytes(manifests.publish(spark.createDataFrame([("/a", "hello")], "path string, data string"), F.lit("n1"), 1.5)).first().manifest_bytes == len(json.dumps(full, separators=(",", ":")))


def test_rollback_and_snapshot(spark):
    files = lambda x: spark.createDataFrame([("/a", x)], "path string, data string")
    one = manifests.publish(files("first"), F.lit("n1"), 1.0)
    two = manifests.publish(files("second"), F.lit("n1"), 2.0, one)
    back = manifests.rollback(one.unionByName(two), one, F.lit("n2"), 3.0).first()
    assert back.vv == {"n1": 2, "n2": 1} and back.chunks == one.first().chunks and back.note.startswith("rollback to ")
    assert manifests.snapshot(two, "x").first().entries == {"/a": two.first().digest}


def test_stream_state_is_that_of_the_batch(spark):
    q = catalogue.queries()
    stream = {r.node: (r.last_seen, r.state) for r in q["stream_member_state"](spark, SF).collect()}
    batch = {r.node: (r.last_seen, r.state) for r in q["member_state"](spark, SF).collect()}
    assert stream == batch
