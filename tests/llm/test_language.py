import itertools

import numpy as np
import pytest
from tessera.llm.language import Model, constant_is_best, identify, op1_language, train, viterbi


def brute(scores, switch):
    best = max(itertools.product(range(scores.shape[1]), repeat=len(scores)), key=lambda p: sum(scores[i, k] for i, k in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:])))
    return sum(scores[i, k] for i, k in enumerate(best)) - switch * sum(a != b for a, b in zip(best, best[1:]))


@pytest.mark.parametrize("seed", range(20))
def test_viterbi_is_optimal(seed):
    rng = np.random.default_rng(seed)
    scores = rng.normal(0, 3, (7, 3))
    worth = lambda p: sum(scores[i, k] for i, k in enumerate(p)) - 4.0 * sum(a != b for a, b in zip(p, p[1:]))
    best = brute(scores, 4.0)
    assert worth(viterbi(scores, 4.0)) == pytest.approx(best)
    top = scores.sum(0).argmax()
    if constant_is_best(scores, np.array([0, 7]), np.array([top]), 4.0)[0]:
        assert worth([top] * 7) == pytest.approx(best)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in op1_language(spark, sf).collect() if r.held_out]
    assert len(rows) > 100 and np.mean([truth[r.doc_id] == r.lang_pred for r in rows]) > 0.98


def test_mixed_text_and_edge_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train(docs)
    long = {lang: docs.where(f"lang = '{lang}' AND n_chars BETWEEN 900 AND 3000").orderBy("doc_id").first().text for lang in ("de", "en")}
    rows = [(1, long["de"] + "\n" + long["en"]), (2, None), (3, ""), (4, "12 … —"), (None, "été"), (6, "слово"), (6, "слово")]
    got = identify(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, score string"), model).collect()
    by = {(r.doc_id, r.text): r for r in got}
    assert {s.lang for s in by[1, rows[0][1]].spans} >= {"de", "en"} and len(got) == 7
    for k in rows[1:4]:
        assert by[k].lang_pred == "und" and by[k].score == 0
    assert by[None, "été"].held_out and by[6, "слово"].lang_pred in model.langs
    assert identify(spark.createDataFrame(rows, "doc_id bigint, text string"), Model([])).where("lang_pred <> 'und'").count() == 0
    assert identify(docs.limit(0), model).count() == 0
