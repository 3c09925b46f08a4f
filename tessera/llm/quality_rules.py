"""Operator 8, quality rules: line-first cleaning with DataFrame functions only.

Every ``\\n``-separated line that has a word is judged by itself (symbols, shouting,
navigation, boilerplate, missing punctuation); failing lines go, and a document that
loses too much of its text goes too. Beside this stand whole-document base counts.

Nothing leaves a row: words, windows and lines are arrays of one document, so there is
no shuffle at all and one task's memory is that of its longest text.

Edge cases: a null or empty text has no words, fails the base rules and has an empty
cleaned text; blank lines are kept and count neither as text nor as loss; repeated rows
are judged one by one; columns of the input other than the id and the text stay as they
are, also if they carry names used here, as all working columns are prefixed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules' patterns and limits.
SPACE = r"[ \t\n\x0B\f\r]"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
LINE_SYMBOLS = r"[#*$%&|<>{}~^=_\\]"
SYMBOL_SHARE = 20  # a line fails if more than one character in 20 is such a symbol
NAVIGATION = r"(?i)^(home|menu|next|previous|back to top|skip to content|log ?in|sign ?up|sitemap|share this)\b"
NAVIGATION_CHARS = 60
BOILERPLATE = ["cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "subscribe to our", "enable javascript", "lorem ipsum", "click here"]
BOILERPLATE_LINE = f"(?i)({'|'.join(BOILERPLATE)})"
ENDS = """.!?:;…"'”’»)]"""
SHOUT_LETTERS = 10
SHORT_WORDS = 3
MIN_WORDS = 20
WINDOW = 8
REPEAT_PERCENT = 30
LOSS_PERCENT = 50

_P = "__qr_"
_BLANK, _GOOD, _FAILS = 0, 1, 2


def _without(line: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(line, pattern, ""))


def line_fails(line: Column, symbols: Column | None = None, boilerplate: Column | None = None) -> Column:
    """Whether a line, with no white space at its ends, fails one of the line rules.

    ``symbols`` and ``boilerplate`` may say of the whole text whether it has what those rules look
    for at all. The tests stand in the order of their cost.
    """
    yes = F.lit(True)
    chars = F.length(line)
    upper = chars - _without(line, r"\p{Lu}+")
    letters = _without(line, r"[^\p{L}]+")
    return (
        (~F.substring(line, -1, 1).isin(list(ENDS)) & (F.size(F.split(line, rf"{SPACE}+")) < SHORT_WORDS))
        | ((chars < NAVIGATION_CHARS) & line.rlike(NAVIGATION))
        | (yes if symbols is None else symbols) & ((chars - _without(line, LINE_SYMBOLS + "+")) * SYMBOL_SHARE > chars)
        # over half of ten letters are six at least: only then all letters are counted
        | ((upper * 2 > SHOUT_LETTERS) & (letters >= SHOUT_LETTERS) & (upper * 2 > letters))
        | (yes if boilerplate is None else boilerplate) & line.rlike(BOILERPLATE_LINE)
    )


def _window_hashes(hashes: Column) -> Column:
    """A hash for each ``WINDOW`` words in a row, from one hash for each word."""
    of = F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)]))
    return F.when(F.size(hashes) >= WINDOW, F.slice(of, F.lit(1), F.size(hashes) - (WINDOW - 1))).otherwise(F.array().cast("array<bigint>"))


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lines, n_lines_removed, cleaned_text and kept.

    Columns of these names in the input are replaced.
    """
    c = lambda name: F.col(_P + name)
    others = [x for x in docs.columns if x not in _NAMES or x == text]
    d = docs.select(*others).withColumn(_P + "text", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn(_P + "low", F.lower(c("text")))
    d = d.withColumns({
        _P + "words": F.array_remove(F.split(c("text"), SPACE + "+"), ""),
        _P + "trimmed": F.transform(F.split(c("text"), "\n"), lambda x: F.btrim(x, F.lit(SPACES))),
        _P + "symbols": c("text").rlike(LINE_SYMBOLS),
        _P + "boilerplate": reduce(lambda a, b: a | b, [c("low").contains(x) for x in BOILERPLATE]),
    })
    d = d.withColumns({
        _P + "n": F.size(c("words")),
        _P + "hashes": F.transform(c("words"), lambda w: F.xxhash64(w)),
        # of each line whether it is blank, good or failing
        _P + "kinds": F.transform(c("trimmed"), lambda t: F.when(t == "", _BLANK).when(line_fails(t, c("symbols"), c("boilerplate")), _FAILS).otherwise(_GOOD)),
    })
    d = d.withColumn(_P + "windows", _window_hashes(c("hashes")))
    # a distinct count finds the few texts that repeat a window
    empty = F.array().cast("array<struct<h:bigint,p:int>>")
    d = d.withColumn(
        _P + "sorted",
        F.when(
            F.size(F.array_distinct(c("windows"))) < F.size(c("windows")),
            F.array_sort(F.transform(c("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        ).otherwise(empty),
    )
    same = lambda e, i: (F.get(c("sorted"), i - 1)["h"] == e["h"]) | (F.get(c("sorted"), i + 1)["h"] == e["h"])
    d = d.withColumn(
        _P + "at",
        F.array_sort(F.transform(F.filter(c("sorted"), lambda e, i: F.coalesce(same(e, i), F.lit(False))), lambda e: e["p"])),
    )
    repeat = F.aggregate(
        c("at"),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).cast("bigint").alias("n"), (p + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    # characters of the lines of a kind: line breaks stand between the lines of an array
    of_kind = lambda kind: F.zip_with(F.split(c("text"), "\n"), c("kinds"), lambda x, k: F.when(kind(k), x))
    chars = lambda kind: F.length(F.array_join(of_kind(kind), "")).cast("bigint")
    d = d.withColumns({
        _P + "repeat": repeat,
        _P + "all_chars": chars(lambda k: k != _BLANK),
        _P + "lost_chars": chars(lambda k: k == _FAILS),
    })
    failed = (c("n") < MIN_WORDS) | (100 * c("repeat") > REPEAT_PERCENT * c("n"))
    # what is found is one value, told once by a generator of one row: a filter on any part of it stays above it, and isn't
    # copied with all of the above to the scan
    told = F.struct(
        c("n").cast("bigint").alias("n_words"),
        F.length(F.array_join(c("words"), "")).cast("bigint").alias("word_chars"),
        (F.length(c("text")) - _without(c("text"), f"[{SYMBOLS}]+")).cast("bigint").alias("n_symbols"),
        F.when(
            F.size(c("kinds")) > 1, F.size(of_full := F.array_compact(of_kind(lambda k: k != _BLANK))) - F.size(F.array_distinct(of_full))
        ).otherwise(0).cast("bigint").alias("n_dup_lines"),
        c("repeat").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (F.size(c("kinds")) - F.size(F.filter(c("kinds"), lambda k: k == _BLANK))).cast("bigint").alias("n_lines"),
        F.size(F.filter(c("kinds"), lambda k: k == _FAILS)).cast("bigint").alias("n_lines_removed"),
        F.array_join(of_kind(lambda k: k != _FAILS), "\n").alias("cleaned_text"),
        (~failed & ~(c("lost_chars") * 100 > c("all_chars") * LOSS_PERCENT)).alias("kept"),
    )
    return d.select(*others, F.inline_outer(F.array(told)))


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_lines_removed", "cleaned_text", "kept"]


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_removed"
    )


def _sql() -> str:
    quote = lambda x: x.replace("'", "''")
    strip = lambda x: f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"
    has = "regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')"
    t = strip("x")
    left = lambda p: f"length(regexp_replace({t}, '{p}', '', 'g'))"
    fails = (
        f"((length({t}) - {left(quote(LINE_SYMBOLS))}) * {SYMBOL_SHARE} > length({t})"
        f" OR ({left('[^\\p{L}]')} >= 10 AND {left('[^\\p{Lu}]')} * 2 > {left('[^\\p{L}]')})"
        f" OR (length({t}) < {NAVIGATION_CHARS} AND regexp_matches({t}, '{quote(NAVIGATION)}'))"
        f" OR regexp_matches({t}, '{quote(BOILERPLATE_LINE)}')"
        f" OR (NOT regexp_matches({t}, '[{quote(ENDS.replace(']', chr(92) + ']'))}]$') AND len(regexp_split_to_array({t}, '{SPACE}+')) < {SHORT_WORDS}))"
    )
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                 regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w,
                 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {has}) AS f FROM documents),
    win AS (SELECT doc_id, i, list_slice(w, i, i + {WINDOW - 1}) AS k
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM d WHERE len(w) >= {WINDOW})),
    dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
    rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, (SELECT unnest(range({WINDOW})) AS j) GROUP BY doc_id),
    base AS (SELECT d.doc_id, len(w)::BIGINT AS n_words,
                list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS wc,
                (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                (len(f) - len(list_distinct(f)))::BIGINT AS n_dup_lines,
                coalesce(rep.n, 0)::BIGINT AS n_repeat_words, f,
                list_filter(f, lambda x: NOT {fails}) AS g FROM d LEFT JOIN rep USING (doc_id)),
    s AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
             coalesce(list_sum(list_transform(f, lambda x: length(x))), 0) AS ac,
             coalesce(list_sum(list_transform(g, lambda x: length(x))), 0) AS gc FROM base)
    SELECT doc_id, n_words, coalesce(wc, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT ((ac - gc) * 100 > ac * {LOSS_PERCENT}) AS kept,
           len(f)::BIGINT AS n_lines, (len(f) - len(g))::BIGINT AS n_lines_removed FROM s"""


SQL = _sql()
