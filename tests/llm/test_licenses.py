import random
import re

import pytest
from tessera.llm.licenses import CONFIRM, LEAST_CHANCE, SLACK, TEMPLATES, op2_licenses, scan_licenses, train

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

NOTICES = {"gpl": "This work is licensed under the GNU General Public License, version 3.", "reserved": "All rights reserved.", "cc-by-nc": "Licensed under CC BY-NC 4.0.", "mit": "Released under the MIT License.", "apache": "Licensed under the Apache License, Version 2.0."}


def test_every_notice_of_the_corpus_and_nothing_else(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.families for r in op2_licenses(spark, sf).collect()}
    want = {i: ",".join(sorted(f for f, n in NOTICES.items() if n in re.split("\n", t))) for i, t in texts.items()}
    assert sum(map(bool, want.values())) > 5 and got == want


def test_templates_unknown_and_edge_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train(docs)
    rows = [(k, "Some text before.\n" + t + "\nand after.") for k, t in enumerate(t for own in TEMPLATES.values() for t in own)]
    rows += [(90, None), (91, ""), (92, "The license of a driver is under the seat of the work."), (None, "Released under the MIT License."), (94, "x " * 30000 + "\nReleased under the MIT License.")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, licenses int")
    got = {r.doc_id: r for r in scan_licenses(df, model).collect()}
    k = 0
    for family, own in TEMPLATES.items():
        for t in own:
            assert [x.family for x in got[k].licenses] == [family], t
            x = got[k].licenses[0]
            assert rows[k][1].encode()[x.start : x.end].decode() in t
            k += 1
    assert not got[90].licenses and not got[91].licenses and not got[92].licenses
    assert [x.family for x in got[None].licenses] == [x.family for x in got[94].licenses] == ["mit"]
    assert scan_licenses(df.limit(0), model).count() == 0


def test_notices_inside_long_lines_and_over_line_breaks(spark):
    model = train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    bsd = TEMPLATES["bsd"][0].replace("with or without ", "with or without\n * ")
    long = " ".join(f"word{i % 37} of prose" for i in range(70))
    texts = [f"{long} Released under the MIT License. {long}", f"/*\n * {bsd}\n */", "Released under\n\nthe MIT License.", f"{long} All rights\nreserved. {long} Licensed under the AGPL-3.0. {long}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: [(x.family, texts[r.doc_id].encode()[x.start : x.end].decode()) for x in r.licenses] for r in scan_licenses(df, model).collect()}
    assert got == {0: [("mit", "Released under the MIT License")], 1: [("bsd", bsd[:-1])], 2: [], 3: [("reserved", "All rights\nreserved"), ("agpl", "Licensed under the AGPL-3.0")]}


def brute(model, text):
    """All windows of all paragraphs, one by one, each scored from its own text."""
    data = (text or "").encode()
    grams = lambda w: list(zip(w, w[1:]))
    templates = [(f, set(grams(WORD.findall(t.lower().encode())))) for f, own in TEMPLATES.items() for t in own]
    found, begin = [], 0
    for gap in [*re.finditer(rb"\n[\x00-\x20]*\n", data), None]:
        paragraph = [(x[0], x.start(), x.end()) for x in WORD.finditer(data.lower(), begin, gap.start() if gap else len(data))]
        begin = gap.end() if gap else begin
        pairs = grams([w for w, _, _ in paragraph])
        for family, own in templates:
            places = [i for i, g in enumerate(pairs) if g in own]
            for i in places:
                for j in places:
                    had = set(pairs[i : j + 1]) & own
                    if i <= j < i + 2 * (len(own) + 1) + SLACK - 1 and pairs[j] not in pairs[i:j] and len(had) >= CONFIRM * len(own) - 1e-9:
                        a, b = paragraph[i][1], paragraph[j + 1][2]
                        chance = model._softmax(model._counts([data[a:b].decode()]) @ model.weights / model.temperature)[0]
                        if model.families[chance.argmax()] == family and chance.max() >= LEAST_CHANCE:
                            found.append((-len(had), -len(had) / len(own), -round(chance.max(), 9), a, b, family))
    out = []
    for _, share, chance, a, b, family in sorted(found):
        if all(b <= x or a >= y for x, y, *_ in out):
            out.append((a, b, family, -share, -chance))
    return sorted(out)


def test_against_all_windows_one_by_one(spark):
    rng = random.Random(5)
    sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    notices = [t for own in TEMPLATES.values() for t in own]
    texts = [r.text for r in sf.collect()] + [None, "", "\n\n"]
    for _ in range(150):
        words = [w for t in rng.choices(notices, k=rng.randint(1, 3)) for w in t.split() + rng.choices(["prose", "the", "License", "é"], k=rng.randint(0, 5))]
        words = [w for w in words if rng.random() > 0.1]
        texts.append("".join(w + rng.choices([" ", "\n", ", ", "\n\n", "\n \t\n"], [60, 4, 4, 1, 1])[0] for w in words))
    got = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()
    assert sum(len(r.licenses) for r in got) > 100
    for r in got:
        want = brute(model, r.text)
        assert [(x.start, x.end, x.family) for x in r.licenses] == [x[:3] for x in want], r.text
        for x, y in zip(r.licenses, want):
            assert (x.template_share, x.chance) == pytest.approx(y[3:], abs=1e-6)
