import random
import re

from tessera.llm.line_dedup import dedup_lines, op7_line_dedup


def brute(docs):
    seen, out = set(), {}
    for i, t in docs:
        kept, gone = [], []
        for k, x in enumerate((t or "").split("\n")):
            c = re.sub(r"[ \t\n\x0B\f\r]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), x)).strip(" ")
            if len(c.split(" ")) >= 3 and c in seen:
                gone.append(k)
            else:
                kept.append(x)
            seen.add(c)
        out[i] = ("\n".join(kept), gone)
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    lines = ["A line of text", "a  LINE of\ttext ", "b c", "", " ", "ünï code line here", "x y z", "x y z w"]
    docs = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 6)))) for i in range(40)] + [(50, None), (51, ""), (52, "a b c\n" * 3000)]
    df = spark.createDataFrame([(i, t, "r", 1) for i, t in docs], "doc_id bigint, text string, removed string, unit int").repartition(3)
    got = dedup_lines(df).collect()
    assert {r.doc_id: (r.kept_text, [x.unit for x in r.removed]) for r in got} == brute(docs)
    for r in got:
        for x in r.removed:
            assert r.text[x.start : x.end] == r.text.split("\n")[x.unit]


def test_edge_cases(spark):
    df = spark.createDataFrame([(None, "a b c\na b c"), (1, "a b c\nq"), (1, "a b c\nq"), (2, "A b  c")], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_removed_units, r.kept_text) for r in dedup_lines(df).collect())
    assert got == [(0, 0, "a b c\na b c"), (1, 0, "a b c\nq"), (1, 0, "a b c\nq"), (2, 1, "")]
    assert dedup_lines(df.limit(0)).count() == 0


def test_query_removes_repeated_short_lines(spark, tmp_path):
    docs = [(1, "一个没有空格的段落\nTwo words\n \n"), (2, "new\n一个没有空格的段落\ntwo  WORDS\n "), (3, "NEW\nhttp://a.b/c\nhttp://a.b/c")]
    spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_units, r.n_removed_units, r.n_removed) for r in op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (4, 0, 0), 2: (4, 2, 39), 3: (3, 2, 17)}


def test_paragraphs(spark):
    docs = [(1, "First one.\nIt has two lines.\n\nSecond."), (2, "new\n\nfirst ONE. It\nhas two  lines.\n\nthird"), (3, "second.\n\nSECOND.")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r for r in dedup_lines(df, min_words=1, unit="paragraph").collect()}
    assert {i: (r.n_units, r.n_removed_units, r.kept_text) for i, r in got.items()} == {1: (2, 0, docs[0][1]), 2: (3, 1, "new\n\nthird"), 3: (2, 2, "")}
    assert all(docs[i - 1][1][x.start : x.end] == docs[i - 1][1].split("\n\n")[x.unit] for i, r in got.items() for x in r.removed)
