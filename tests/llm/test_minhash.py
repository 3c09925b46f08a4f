import re

import pytest
from tessera.llm.minhash import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs):
    sets = {}
    for i, t in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(4000))
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (6, long), (7, long + " tail"), (8, "ä ö ü ß é"), (9, "Ä ö ü ß é"), (10, long.replace("w17 ", "x "))]
    df = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in docs], "doc_id bigint, text string, signature string, id int, component int")
    assert {tuple(r) for r in near_duplicates(df).collect()} == brute(docs)
    assert near_duplicates(df.limit(0)).count() == 0
    twice = near_duplicates(df.unionByName(df)).collect()
    assert len(twice) == 20 and {tuple(r) for r in twice} == brute(docs)


@pytest.mark.parametrize("small", [False, True])
def test_chain_and_star_of_near_copies(spark, monkeypatch, small):
    import random

    import tessera.llm.minhash as m

    if small:  # crowded regions and components of several blocks
        monkeypatch.setattr(m, "REGION", 30)
        monkeypatch.setattr(m, "SHINGLES", 3000)
    rng = random.Random(3)
    base = [rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(120)]
    docs = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    docs += [(100 + i, " ".join(f"v{i}x{k}" for k in range(50))) for i in range(20)]
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == brute(docs)


def test_sparse_pairs_in_a_crowded_region(spark):
    import numpy as np
    from tessera.llm.minhash import REGION, STEPS, TREES, _forest_edges

    rng = np.random.default_rng(8)
    n, pairs = 2 * REGION + 900, 60
    sig = rng.integers(0, 2**32, (n, TREES * STEPS), dtype=np.uint32)
    sig[:, :STEPS] = 7  # one region of the first tree holds all, and no other tree joins any
    a, b = np.arange(pairs), np.arange(pairs) + n // 2
    sig[b] = sig[a]
    sig[b, STEPS + 1 :: STEPS] ^= np.uint32(1)
    sig[a, STEPS] = 0  # the ends of the region's order
    sig[b, STEPS] = 255
    rows = [(i, sig[i].tobytes()) for i in range(n)]
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, 500)
    try:
        edges = _forest_edges(spark.createDataFrame(rows, "id bigint, signature binary")).collect()
    finally:
        spark.conf.set(batch, before)
    assert {(min(r), max(r)) for r in map(tuple, edges)} == set(zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("region", [4096, 40, 8])
def test_recall_of_sparse_links_in_a_hot_group(spark, monkeypatch, region):
    """300 pairs at a similarity just over 0.75, all of which share two thirds of their shingles with every other text."""
    import random

    import tessera.llm.minhash as m

    monkeypatch.setattr(m, "REGION", region)
    rng = random.Random(9)
    words = lambda n: [f"q{rng.randrange(10**9)}" for _ in range(n)]
    common, docs = words(84), []
    for i in range(300):
        w = common + words(40)
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:-16] + words(16)))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    want = {i: c for i, _, c, _ in brute(docs)}
    assert sum(want[i] != i for i in want) == 300
    assert got == want  # a miss here has a chance of about 300 * 12 in a million
