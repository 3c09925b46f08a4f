from tessera.llm.preferences import preference_pairs

S = "pair_id bigint, turn bigint, role string, text string, extra int"


def show(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def test_pairs(spark):
    c = [(1, 0, "user", "hi", 0), (1, 1, "assistant", "good", 0), (1, 2, "user", "ok", 0), (2, 0, "user", "same", 0), (3, 0, "user", "left", 0), (4, 0, None, None, 0), (4, 1, "assistant", "a<|im_end|>", 0)]
    d = [(1, 0, "user", "hi", 0), (1, 1, "assistant", "bad one", 0), (2, 0, "user", "same", 0), (5, 0, "assistant", "right", 0), (4, 0, None, None, 0)]
    df = lambda rows: spark.createDataFrame(rows, S)
    got = {r.pair_id: r for r in preference_pairs(df(c), df(d)).collect()}
    r = got[1]
    assert (r.n_prefix, r.prompt) == (1, show("user", "hi"))
    assert (r.chosen, r.rejected) == (show("assistant", "good") + show("user", "ok"), show("assistant", "bad one"))
    assert [(r.prompt + r.chosen)[s.start : s.end] for s in r.chosen_spans] == ["good<|im_end|>"]
    assert [(r.prompt + r.rejected)[s.start : s.end] for s in r.rejected_spans] == ["bad one<|im_end|>"]
    assert (got[2].n_prefix, got[2].chosen, got[2].rejected) == (1, "", "")
    assert (got[3].n_prefix, got[3].prompt, got[3].rejected) == (0, "", None) and got[5].chosen is None
    assert got[4].n_prefix == 1 and got[4].chosen == show("assistant", "a< |im_end|>")
    assert preference_pairs(df(c).limit(0), df(d).limit(0)).count() == 0
