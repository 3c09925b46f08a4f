import random
import re

from tessera.llm.quality_rules import quality_rules
from tests.llm.test_pipeline import line_fails

SPACE = "[ \t\n\x0b\f\r]"


def brute(t):
    t = t or ""
    w, lines = re.findall("[^ \t\n\x0b\f\r]+", t), t.split("\n")
    windows = {}
    for k in range(len(w) - 7):
        windows.setdefault(tuple(w[k : k + 8]), []).append(k)
    repeated = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(8)}
    full = [x for x in lines if re.search("[^ \t\n\x0b\f\r]", x)]
    good = [x for x in full if not line_fails(x)]
    size = lambda z: sum(map(len, z))
    failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
    kept = not failed and (size(full) - size(good)) * 2 <= size(full)
    text = "\n".join(x for x in lines if x not in full or x in good)
    return (len(w), size(w), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(repeated), failed, len(full), len(full) - len(good), text, kept)


def test_against_brute_force(spark):
    rng = random.Random(3)
    lines = ["Home | News", "HOME", "A Cookie Policy applies here.", "all RIGHTS reserved", "SHOUTING IS NOT ALLOWED HERE.", "It ends well.", "no end", "two words", "x", "", " \t", "## $$ %%", "Ünï ÉÀÈ ÖÄÜ ÉÀÈÖÄÜ.", "a b c d e f g h i j.", "log in", "Login-page for all.", "tail \x0b", "“quoted”", "中文没有空格。", "AbAbAbAbAbAbA."]
    texts = [None, "", " ", "\n\n", "word " * 30, "a b c d e f g h " * 4, "one. " * 20 + "\n" + "x" * 9000, *("\n".join(rng.choices(lines, k=rng.randint(1, 14))) for _ in range(300))]
    texts += [" ".join(rng.choices("abc", k=rng.randint(15, 80))) + "." for _ in range(100)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in enumerate(texts)], "doc_id bigint, text string, kept int, n_words string, score double").repartition(3)
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.n_lines, r.n_lines_removed, r.cleaned_text, r.kept) == brute(t), repr(t)
        assert r.text == t and r.score == 2.0


def test_empty_table_null_ids_and_filters(spark):
    docs = spark.createDataFrame([(None, "a b c."), (None, "a b c."), (1, None)], "doc_id bigint, text string")
    assert quality_rules(docs.limit(0)).count() == 0
    assert sorted((str(r.doc_id), r.kept) for r in quality_rules(docs).collect()) == [("1", False), ("None", False), ("None", False)]
    assert quality_rules(docs).where("kept").count() == 0
