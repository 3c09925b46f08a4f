import hashlib
import random

import numpy as np
import pytest
import tessera.llm.substrings as m


def brute(docs):
    seen, out = set(), []
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - m.LENGTH + 1):
            w = b[k : k + m.LENGTH]
            if w in seen:
                gone[k : k + m.LENGTH] = True
            seen.add(w)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed,small", [(1, False), (2, True)])
def test_against_brute_force(spark, monkeypatch, seed, small):
    if small:  # many splits, tiny groups, frequent strings
        monkeypatch.setattr(m, "SPLIT_BYTES", 3000)
        monkeypatch.setattr(m, "_TOGETHER", 500)
        monkeypatch.setattr(m, "FREQUENT", 3)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé\n ", k=rng.randint(1, 5)))
    passage = [" ".join(word() for _ in range(60)) for _ in range(3)]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 3))]
        parts += rng.choices(passage, k=rng.randint(0, 2)) + rng.choices(["ab" * 90, "z" * 300, "ü" * 120, "x" * 100], k=rng.randint(0, 2))
        rng.shuffle(parts)
        docs.append((i * 3, "".join(parts)))
    docs += [(500 + i, t) for i, t in enumerate([None, "", "short", docs[5][1], docs[5][1], "y" * 99, "y" * 100, "y" * 101])]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id bigint, text string, kept_bytes string, at int").repartition(5)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.removed_spans), hashlib.sha256(r.kept_bytes).hexdigest()) for r in m.substring_dedup(df).collect())
    assert got == brute(docs)


def test_repeated_rows_null_ids_and_empty_table(spark):
    t = "".join(random.Random(1).choices("abcdef ", k=400))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (None, None)], "doc_id bigint, text string")
    assert sorted((r.doc_id or 9, r.n_removed) for r in m.substring_dedup(df).collect()) == [(1, 0), (1, 400), (9, 0), (9, 400)]
    assert m.substring_dedup(df.limit(0)).count() == 0


def test_a_hot_and_a_null_id_spread_over_splits(spark, monkeypatch):
    monkeypatch.setattr(m, "SPLIT_BYTES", 2000)
    rng = random.Random(3)
    shared = "".join(rng.choices("abcdef ", k=150))
    rows = [(i, "".join(rng.choices("ghijkl ", k=rng.randint(0, 120))) + shared) for i in [7, None] * 40 + [np.iinfo(np.int64).max] * 5]
    df = spark.createDataFrame([(None if i is None else int(i), t) for i, t in rows], "doc_id bigint, text string")
    got = m.substring_dedup(df).collect()
    whole = [r for r in got if r.n_removed < 150]
    assert len(got) == len(rows) and [(r.doc_id, r.n_removed) for r in whole] == [(7, 0)]
    assert all(len(r.kept_bytes) == r.n_bytes - r.n_removed for r in got)
