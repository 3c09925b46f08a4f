"""The pipeline against a plain version of its stages that shares none of their code."""

import re

import numpy as np
import pytest
from tests.llm.test_decontaminate import norm
from tests.llm.test_minhash import brute as near

import corpus_pipeline
from tessera.llm.packing import tokenizer_path

SF = "/root/testdata/sf0.001"
SPACE = "[ \t\n\x0b\f\r]"


def line_fails(x):
    t = re.sub(rf"^{SPACE}+|{SPACE}+$", "", x)
    letters = [c for c in t if c.isalpha()]
    if len(re.findall(r"[#*$%&|<>{}~^=_\\]", t)) * 20 > len(t) or len(letters) >= 10 and sum(c.isupper() for c in letters) * 2 > len(letters):
        return True
    if len(t) < 60 and re.match(r"(?i)(home|menu|next|previous|back to top|skip to content|log ?in|sign ?up|sitemap|share this)\b", t):
        return True
    if re.search(r"(?i)(cookie policy|privacy policy|terms of (use|service)|all rights reserved|subscribe to our|enable javascript|lorem ipsum|click here)", t):
        return True
    return not re.search(r"""[.!?:;…"'”’»)\]]$""", t) and len(re.split(f"{SPACE}+", t)) < 3


def rules(docs):
    out = []
    for i, t in docs:
        w = re.findall("[^ \t\n\x0b\f\r]+", t)
        windows = {}
        for k in range(len(w) - 7):
            windows.setdefault(tuple(w[k : k + 8]), []).append(k)
        repeated = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(8)}
        lines = t.split("\n")
        good = [x for x in lines if not x.strip(" \t\n\x0b\f\r") or not line_fails(x)]
        size = lambda z: sum(len(x) for x in z if x.strip(" \t\n\x0b\f\r"))
        if len(w) >= 20 and 100 * len(repeated) <= 30 * len(w) and (size(lines) - size(good)) * 2 <= size(lines):
            out.append((i, "\n".join(good)))
    return out


def substrings(docs):
    seen, out = set(), []
    for i, t in docs:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        out.append((i, bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")))
    return out


def clean(docs, items):
    windows = {tuple(g[k : k + min(10, len(g))]) for g in map(norm, items) if g for k in range(max(1, len(g) - 9))}
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        low = re.sub("[A-Z]", lambda x: x[0].lower(), t)
        found = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))
        w, hit = [m[0] for m in found], np.zeros(len(found) + 1, bool)
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit[k : k + n] = True
        if hit.sum() > 0.5 * len(w):
            continue
        text, at, k = "", 0, 0
        while k < len(w):
            e = k
            while hit[e]:
                e += 1
            if e - k >= 10:
                text += t[at : found[k].start()]
                at = found[e - 1].end()
            k = max(e, k + 1)
        out.append((i, text + t[at:]))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_stages_against_brute_force(spark, docs):
    got = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = lambda rows: [(i, t) for i, t in rows if t.strip(" \t\n\x0b\f\r")]

    def kept_near(rows):
        kept = {x[0] for x in near(rows) if x[3]}
        return [(i, t) for i, t in rows if i in kept]

    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], [rules, kept_near, substrings, lambda d: clean(d, items)]):
        got = stage(spark, got, SF)
        assert got.columns == corpus_pipeline.COLUMNS
        docs = seen(plain(docs))
        rows = got.collect()
        got = spark.createDataFrame(rows, got.schema)
        assert sorted((r.doc_id, r.text) for r in rows) == docs, name
        assert all(r.n_chars == len(r.text) for r in rows)
    from tokenizers import Tokenizer

    tok, whole = Tokenizer.from_file(tokenizer_path()), {}
    for r in sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: (r.doc_id, r.start)):
        whole[r.doc_id] = whole.get(r.doc_id, b"") + r.ids
    assert whole == {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for i, t in docs}


def test_edge_cases_pass_all_stages(spark, tmp_path):
    import random

    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(80)) + "."
    one, two, three = text(), text(), text()
    rows = [(1, one), (1, one), (2, one + " tail"), (3, None), (4, ""), (None, two), (5, two), (None, None), (6, three * 200), (7, "x " * 10)]
    docs = spark.createDataFrame([(i, t, None, None, None, "extra", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, component_id int")
    spark.read.parquet(f"{SF}/benchmark.parquet").limit(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs, empty = stage(spark, docs, str(tmp_path)), stage(spark, empty, str(tmp_path))
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        empty = spark.createDataFrame(empty.collect(), empty.schema)
        assert empty.count() == 0 and docs.count() > 0, name
        if name == "minhash_near_dedup":
            assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "1", "5", "None"]
        elif name == "suffix_array_dedup":
            assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "5"]
    assert {r.doc_id for r in docs.collect()} == {1, 5}
