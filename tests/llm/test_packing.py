import zlib

import numpy as np
import pytest
from tessera.llm.packing import SIZE, op6_packing, pack, plan_cuts, tokenizer_path, tokens

TEXTS = [None, "", "one", "a  b   c\n \n d ", "it's <|endoftext|> here.\n\nAnd\tthere ", " lead. Two! Three?", "x" * 5000, "Wörter über  é  z  end", "A sentence here. " * 900, "a\n\n b\n c.\n"]


def check(rows, texts, size=SIZE):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    padding = total = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= size
        total += at
        padding += 0 if at & (at - 1) == 0 else size - at
    for doc_id, text in texts.items():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert (r.ids == part) if "ids" in r.__fields__ else r.ids_crc32 == zlib.crc32(part)
            at += r.length
        assert at == len(ids)
    return padding / max(total, 1)


def test_round_trip_of_awkward_texts(spark):
    texts = dict(enumerate(TEXTS)) | {len(TEXTS) + i: t for i, t in enumerate(TEXTS)}
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id bigint, text string, ids string, start int")
    check(pack(docs, tokenizer_path()).collect(), texts)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id bigint, text string"), tokenizer_path()).count() == 0


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check(op6_packing(spark, sf).collect(), texts) < 0.005


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_optimal(seed):
    rng = np.random.default_rng(seed)
    at = [0, *np.cumsum(rng.integers(1, 9, 40)).tolist()]
    cost = [0, *rng.integers(0, 4, 40).tolist()]
    place, value, _, _ = plan_cuts(at, cost, 10, 3)
    n = at[-1]
    price = [3] * (n + 1)  # brute force over every position
    for p, c in zip(at, cost):
        price[p] = c
    best = [0] + [10**9] * n
    for i in range(1, n + 1):
        for j in range(max(0, i - 10), i):
            best[i] = min(best[i], best[j] + 10 - (i - j) + price[i])
    assert min(v - p for p, v in zip(place, value) if p == n) == best[n]


def test_null_and_large_ids_stay_as_they_are(spark):
    docs = [(1, "one two."), (None, "three"), (2**60 + 1, "four five six"), (None, None)]
    got = pack(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1), tokenizer_path()).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0] == [d for d, _ in docs]
    assert all(r.start == 0 and r.length == r.doc_tokens for r in got if r.doc_id is None)


def test_words_and_whole_texts_have_equal_ids():
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = [*TEXTS, " ", "a  b  c", "tab \tend", "é \u0085x", "it 's\nit's", "a <| b", "x\x1c y \x1cz", "中文 字 ", "ends with space ", "😀 😀😀"] * 2
    tok = tokens(tokenizer_path())
    ids, at = tok.encode(pa.array(texts))
    plain = Tokenizer.from_file(tokenizer_path())
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids, t
    assert len(tok.encode(pa.array([], pa.string()))[1]) == 1
