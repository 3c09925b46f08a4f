"""Operator 7, substring dedup by lines or paragraphs: normalised units, global digests, the earliest stays.

A text is cut into units at line breaks (or at empty lines: ``unit="paragraph"``). Each unit that isn't blank
is normalised (a-z for A-Z, single spaces, also over line breaks) and digested; ``dedup_lines``
can leave out units of fewer than ``min_words`` words, the query takes all. For each digest the earliest (doc_id, unit) is found by a minimum that is combined
before the shuffle, so a unit of a third of all documents costs no more than others; all
later occurrences go. Only ids, lengths and digests travel, and each text once at the end.

What the method can't reach: a passage that begins or ends within a unit, and whole units that differ by a word.
It also takes every repeated unit, however short.

Edge cases: null is empty text; blank units (and those under ``min_words``) always stay; rows with a null id
are left whole; repeated rows are one document, and each of them keeps what that keeps;
an empty table gives no rows; other columns pass through, unless they have a result's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

SPACES = r"[ \t\n\x0B\f\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_WORDS = 3
SEPARATOR = {"line": "\n", "paragraph": "\n\n"}
_REMOVED = "array<struct<unit:int,start:bigint,end:bigint>>"
_NAMES = ["n_units", "n_removed_units", "n_removed", "removed", "kept_text"]


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, unit: str = "line") -> DataFrame:
    """``docs`` with n_units, n_removed_units, n_removed (bytes, with the separators that go), removed (unit, start and end in characters of the text) and kept_text."""
    sep, gap = SEPARATOR[unit], len(SEPARATOR[unit])
    text = F.coalesce("text", F.lit(""))
    body = docs.drop(*_NAMES).withColumns({"__ld_text": text, "__ld_key": F.xxhash64(text)})
    units = body.where("doc_id IS NOT NULL").select("doc_id", "__ld_key", F.posexplode(F.split("__ld_text", sep)).alias("unit", "raw"))
    clean = F.btrim(F.regexp_replace(F.translate("raw", UPPER, LOWER), SPACES, " "))
    counted = F.size(F.split(clean, " ")) >= min_words if min_words > 1 else F.lit(True)
    units = units.select("doc_id", "__ld_key", "unit", F.length("raw").cast("bigint").alias("len"), F.when(counted & (clean != ""), F.unhex(F.md5(clean))).alias("digest"))
    before = Window.partitionBy("doc_id", "__ld_key").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    units = units.dropDuplicates(["doc_id", "__ld_key", "unit"]).withColumn("start", F.coalesce(F.sum(F.col("len") + gap).over(before), F.lit(0)))
    units = units.where("digest IS NOT NULL").select("doc_id", "__ld_key", "unit", "start", (F.col("start") + F.col("len")).alias("end"), "digest")
    # written, units are made once, and both sides of the join are plain: adaptive execution can split partitions of a very common unit
    units = cut(units, "units")
    place = F.struct("doc_id", "__ld_key", "unit")
    first = units.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    later = units.join(cut(first, "digests"), "digest").where(place != F.col("first"))
    gone = later.groupBy("doc_id", "__ld_key").agg(F.array_sort(F.collect_set(F.struct("unit", "start", "end"))).alias("removed"))
    joined = body.join(gone, ["doc_id", "__ld_key"], "left").withColumn("removed", F.coalesce("removed", F.array().cast(_REMOVED)))
    # pieces between removed units; a unit goes with the separator after it, the last one with that before it
    size = F.length("__ld_text").cast("bigint")
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("removed", lambda r: r["end"] + gap))
    ends = F.concat(F.transform("removed", lambda r: r["start"]), F.array(size + gap))
    joined = joined.withColumn("__ld_pieces", F.arrays_zip(begins.alias("a"), ends.alias("b")))
    pieces = F.transform("__ld_pieces", lambda p: F.substring(F.concat("__ld_text", F.lit(sep)), (p["a"] + 1).cast("int"), F.greatest(p["b"] - p["a"], F.lit(0)).cast("int")))
    kept = F.array_join(pieces, "")
    joined = joined.withColumn("kept_text", F.when(F.size("removed") == 0, F.col("__ld_text")).otherwise(F.substring(kept, F.lit(1), F.greatest(F.length(kept) - gap, F.lit(0)))))
    return joined.withColumns({
        "n_units": F.size(F.split("__ld_text", sep)).cast("bigint"),
        "n_removed_units": F.size("removed").cast("bigint"),
        "n_removed": (F.octet_length("__ld_text") - F.octet_length("kept_text")).cast("bigint"),
    }).drop("__ld_text", "__ld_key", "__ld_pieces")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, min_words=1).select("doc_id", "n_units", "n_removed_units", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_CLEAN = f"trim(regexp_replace(translate(x, '{UPPER}', '{LOWER}'), '{SPACES}', ' ', 'g'), ' ')"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
u AS (SELECT doc_id, t, i, x, {_CLEAN} AS c FROM (SELECT doc_id, t, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM d)),
f AS (SELECT *, c <> '' AND row_number() OVER (PARTITION BY c ORDER BY doc_id, i) > 1 AS gone FROM u),
k AS (SELECT doc_id, any_value(t) AS t, count(*) AS n, count(*) FILTER (gone) AS g, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM f GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_units, g::BIGINT AS n_removed_units, (strlen(t) - strlen(kept))::BIGINT AS n_removed, sha256(kept) AS kept_sha256 FROM k"""
