import itertools

import numpy as np
import pytest
from tessera.llm.quality_crf import Field, FEATURES, chances, op4_quality, quality
from tessera.llm.quality_rules import quality_rules


@pytest.mark.parametrize("seed", range(6))
def test_marginals_against_enumeration(seed):
    rng = np.random.default_rng(seed)
    at = np.array([0, 4, 4, 5, 11])
    odds, t = rng.normal(0, 2, 11), rng.normal(0, 1, (2, 2))
    good, joint, inner = chances(odds, at, t, True)
    for a, b in zip(at, at[1:]):
        if a == b:
            continue
        weight = {y: np.exp(sum(odds[a + i] * v for i, v in enumerate(y)) + sum(t[p, q] for p, q in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=int(b - a))}
        z = sum(weight.values())
        for i in range(b - a):
            assert good[a + i] == pytest.approx(sum(w for y, w in weight.items() if y[i]) / z)
            if i:
                k = int(np.flatnonzero(inner == a + i)[0])
                for p, q in itertools.product((0, 1), repeat=2):
                    assert joint[k, 2 * p + q] == pytest.approx(sum(w for y, w in weight.items() if y[i - 1 : i + 1] == (p, q)) / z)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op4_quality(spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([truth[r.doc_id] == r.predicted for r in rows]) > 0.95


def test_crf_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, "a\n\nb"), (None, "x " * 50000), (4, "a\n\nb")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, score string")
    got = quality(df, Field(3 * FEATURES + 2)).collect()
    assert sorted((r.doc_id or 9, r.score, len(r.line_scores)) for r in got) == [(1, 0.0, 0), (2, 0.0, 0), (3, 0.0, 0), (4, 0.5, 2), (4, 0.5, 2), (9, 0.5, 1)]
    assert quality(df.limit(0), Field(3 * FEATURES + 2)).count() == 0


def test_rules(spark):
    good = "This is a clean line of plain text.\n" + "And here is another one, with more words than that.\n" + "The third line ends the document as it should do."
    rows = [(1, None), (2, ""), (3, good), (4, good + "\nHome | About | Contact\nbuy *** now $$$"), (5, "one two three four. " * 10), (6, good.upper()), (7, "a\na\n b\n \n\n"), (None, good)]
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id bigint, text string, n_words int")
    by = {r.doc_id: r for r in quality_rules(df).collect()}
    assert by[1].base_failed and by[1].n_words == 0 and by[1].cleaned_text == "" and not by[2].kept
    assert by[3].kept and by[None].kept and by[3].cleaned_text == good and by[3].n_lines_removed == 0
    assert by[4].kept and by[4].cleaned_text == good and by[4].n_symbols == 8 and by[4].n_lines_removed == 2
    assert by[5].n_repeat_words == 40 and by[5].base_failed
    assert not by[6].base_failed and not by[6].kept
    assert (by[7].n_dup_lines, by[7].n_lines, by[7].word_chars) == (1, 3, 3)
    assert quality_rules(df.limit(0)).count() == 0
