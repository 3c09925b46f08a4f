"""Known answers, and plain versions of the vectorised functions."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F
from tessera.functions import bloom, gear, reed_solomon, structured
from tessera.operators import agreement, catalog, history, merkle, replicas


def plain_cuts(data, c):
    out, start = [], 0
    while start < len(data):
        end = min(start + c.most, len(data))
        if len(data) - start > c.least:
            h = 0
            for i in range(start + c.least, end):
                h = ((h << 1) + int(gear.GEAR[data[i]])) % 2**64
                if not h & (c.strict if i < start + c.usual else c.lenient):
                    end = i + 1
                    break
        else:
            end = len(data)
        out.append(end)
        start = end
    return out


def test_gear_table():
    assert hashlib.sha256(b"".join(int(x).to_bytes(8, "big") for x in gear.GEAR)).hexdigest() == "3ed29779cecb10b71cefadfdf335d900b7f6aeba2ef4ab011806f220d4b130b2"


def test_known_cuts():
    data = b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(4096))
    cuts = gear.Chunker().cuts(data)
    assert len(cuts) == 14 and cuts[:6] == [10997, 20851, 30363, 39957, 50442, 55331] and cuts[-2:] == [127195, 131072]


@pytest.mark.parametrize("seed", range(6))
def test_cuts_against_plain_version(seed):
    rng = random.Random(seed)
    c = gear.Chunker(*[(16, 64, 256), (1, 16, 100), (64, 64, 64), (200, 1024, 4096), (10, 32, 5000), (128, 256, 300)][seed])
    for n in (0, 1, 15, 63, 64, 65, 5000):
        data = bytes(rng.choices(range(4 if seed % 2 else 256), k=n))
        assert c.cuts(data) == plain_cuts(data, c)


def test_chunker_refuses_bad_sizes():
    with pytest.raises(ValueError):
        gear.Chunker(10, 5, 20)


def test_profiles(spark):
    sizes = [0, 8 << 20, (8 << 20) + 1, 256 << 20, 4 << 30, (4 << 30) + 1]
    rows = spark.createDataFrame([(s,) for s in sizes], "size bigint").select(catalog.chunk_profile(F.col("size")).alias("p")).collect()
    assert [r.p.min_size >> 10 for r in rows] == [2, 2, 24, 24, 192, 384]


def test_structured():
    yaml = b"# a comment line of text, 33 long.\nmax: 1\nreplication:\n  factor: 3\n\"quoted\": x\n"
    got = structured.split("/a.yml", yaml)
    assert [p[0] for p in got] == ["<preamble>", "max", "replication", "quoted"] and got[-1][2] == len(yaml)
    ini = b"[one]\nkey=1\n; note\n[two]\nkey = 2\n"
    assert [p[0] for p in structured.split("x.ini", ini)] == ["one", "key", "two", "key"]
    js = b' {"a": {"b": [1, "}"]}, "c\\"d": 2,\n "e": null}\n'
    assert [(p[0], js[p[1] : p[2]]) for p in structured.split("x.json", js)][1:3] == [("a", b'"a": {"b": [1, "}"]},'), ('c\\"d', b' "c\\"d": 2,')]
    for path, data in (("x.json", b"[1, 2]"), ("x.json", b'{"a": 1}'), ("x.txt", yaml), ("x.yml", b""), ("x.conf", b"nothing here"), ("x.yml", b"a: 1\n")):
        assert structured.split(path, data) is None


def test_reed_solomon():
    assert [x.hex() for x in reed_solomon.encode(b"hello, erasure!!", 4, 2)[4:]] == ["765cf57b", "d048e5b6"]
    assert reed_solomon.generator(4, 2)[4:].tolist() == [[31, 37, 200, 190], [37, 31, 190, 200]]
    rng = random.Random(0)
    for k, m, n in [(4, 2, 997), (3, 3, 4096), (1, 3, 17), (5, 1, 0), (2, 0, 33)]:
        data = rng.randbytes(n)
        shards = dict(enumerate(reed_solomon.encode(data, k, m)))
        for have in itertools.combinations(shards, k):
            assert reed_solomon.decode(k, m, {i: shards[i] for i in have})[:n] == data
        with pytest.raises(ValueError):
            reed_solomon.decode(k, m, {i: shards[i] for i in range(k - 1)})


def test_bloom():
    assert bloom.sizing(64, 0.02) == (522, 6) and bloom.sizing(1000, 0.01) == (9586, 7)
    assert sorted(bloom.indices("a", 522, 6)) == [196, 259, 322, 385, 448, 511]
    b = bloom.Bloom(522, 6)
    b.add("a")
    assert "a" in b and "b" not in b and b.fill_ratio() == pytest.approx(6 / 522)


def test_merkle_roots(spark):
    entries = spark.createDataFrame([("/a", hashlib.sha256(b"x").hexdigest())], "key string, value string")
    root = lambda e: merkle.levels(merkle.leaves(e)).where("level = 8").first().hash
    assert root(entries.limit(0)) == "cf54bfbfc938cefc99a774ca8f0980a635f6e4fea50645c25475060b12ed4726"
    assert root(entries) == "c828ec698dd7eea5089f132294f29e411b36769f33c307ed93aae65dca983d0b"


def test_version_vectors(spark):
    rows = [({"a": 1}, {"a": 1}, "equal"), ({}, {"a": 1}, "before"), ({"a": 2}, {"a": 1}, "after"), ({"a": 1}, {"b": 1}, "concurrent"), ({}, {"z": 0}, "equal"), ({"a": 1, "b": 1}, {"a": 1}, "after")]
    df = spark.createDataFrame(rows, "a map<string,bigint>, b map<string,bigint>, want string")
    a, b = F.col("a"), F.col("b")
    got = df.select("want", history.compare(a, b).alias("got"), history.descends(a, b).alias("d"), history.merge(a, b).alias("m"), history.bump(a, F.lit("a")).alias("n")).collect()
    assert all(r.want == r.got and r.d == (r.want in ("equal", "after")) for r in got)
    assert got[3].m == {"a": 1, "b": 1} and got[4].m == {} and got[5].n == {"a": 2, "b": 1} and got[1].n == {"a": 1}


def test_replica_toys(spark):
    hold = spark.createDataFrame([(1, 10, 50, 1), (1, 11, 50, 2), (1, 12, 50, 3), (2, 10, 50, 1)], "node bigint, hash bigint, size bigint, atime bigint")
    none = hold.limit(0)
    files = spark.createDataFrame([(7, 10, 1), (7, 13, 2), (8, 10, 1)], "file bigint, hash bigint, seq bigint")
    assert {r.file: r.survives for r in replicas.durability_plain(files, hold).collect()} == {7: -1, 8: 1}
    assert [r.hash for r in replicas.evict(hold, none, F.lit(120)).collect()] == [10]
    assert replicas.evict(hold, hold, F.lit(120)).count() == 0 and replicas.evict(hold, none, F.lit(150)).count() == 0
    frags = spark.createDataFrame([(1, h) for h in (20, 21, 22, 23, 24, 25)], "group bigint, hash bigint")
    on = lambda *nodes: spark.createDataFrame([(n, 20 + i, 1, 1) for i, n in enumerate(nodes)], "node bigint, hash bigint, size bigint, atime bigint")
    assert replicas.durability_coded(frags, on(1, 2, 3, 4, 5, 6), F.lit(4)).first().survives == 1
    assert replicas.durability_coded(frags, on(1, 1, 1, 4, 5, 6), F.lit(4)).first().survives == -1


def test_drift_counts_an_absent_key_as_a_group(spark):
    rows = [(1, "x", "a"), (2, "x", "a"), (3, "y", "b"), (1, "y", "b"), (2, "y", "b")]
    got = agreement.drift(spark.createDataFrame(rows, "node bigint, label string, hash string")).collect()
    assert [(r.label, r.majority_hash, r.majority_count, r.node, r.hash) for r in got] == [("x", "a", 2, 3, None)]
