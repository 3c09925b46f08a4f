import random
import re

import pytest
import tessera.llm.decontaminate as m
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def norm(t):
    return WORD.findall(re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))


def brute(docs, items):
    out = {}
    for i, t in docs:
        w, hit, found = norm(t), set(), set()
        for k, x in items:
            g = norm(x)
            n = min(len(g), 10)
            if not n:
                continue
            for window in {tuple(g[j : j + n]) for j in range(len(g) - n + 1)}:
                for j in range(len(w) - n + 1):
                    if tuple(w[j : j + n]) == window:
                        hit |= set(range(j, j + n))
                        found.add(k)
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("seed,small,least", [(1, False, 1), (2, False, 4), (3, True, 1), (4, True, 11)])
def test_against_brute_force(spark, monkeypatch, seed, small, least):
    if small:  # several benchmark blocks
        monkeypatch.setattr(m, "BLOCK_BYTES", 300)
    rng = random.Random(seed)
    words = ["a", "B", "c", "dé", "e1"]
    items = [(f"i{k}", " ".join(rng.choices(words, k=rng.randint(least, 25)))) for k in range(12)] + [("n", None), ("e", " .!"), ("i0b", "c")][: 3 if least == 1 else 2]
    docs = [(i, ", ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(40)] + [(50, None), (51, ""), (52, "…")]
    docs += [(60 + k, "zz. " + (t or "").upper().replace("É", "é") + " yy") for k, (_, t) in enumerate(items)]
    df = spark.createDataFrame([(i, t, 5, "z") for i, t in docs], "doc_id bigint, text string, n_words int, Items string")
    got = m.decontaminate(df, spark.createDataFrame(items, "item_id string, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == brute(docs, items)
    for r in got:
        text = (r.text or "").encode()
        assert sum(len(norm(text[s.start : s.end].decode())) for s in r.hit_spans) == r.n_hit
        if not r.n_hit:
            assert r.cleaned_text == r.text and r.kept


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id string, text string")
    assert [r.n_hit for r in m.decontaminate(docs, none).collect()] == [0, 0]
    assert m.decontaminate(docs.limit(0), none).count() == 0
    assert m.decontaminate(docs.where(F.lit(False)), docs.select(F.lit("x").alias("item_id"), "text")).count() == 0
