"""Operator 3, preference formatting with DataFrame functions only.

A chosen and a rejected conversation of one pair share their first turns. The longest common
prefix of turns is rendered once as the prompt; what follows on either side is its completion, with
the character spans (in prompt + completion) that a loss may count: the texts of
assistants and the marks that end them.

Offsets are a running sum over a conversation's turns, so that each conversation is shuffled
once, by its pair, and no array is built step by step.

Edge cases: null roles and texts render as empty; turns are ordered by turn, role and text, which
settles ties and repeated rows; a pair with one side only has an empty prompt and a null other
side; equal conversations have empty completions; marks within a text are broken up, so no
text can end its turn; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of the rendered format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
_TURN = ["turn", "role", "text"]


def _safe(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|im_"), F.lit("< |im_"))


def _side(conversations: DataFrame, name: str) -> DataFrame:
    rendered = F.concat(F.lit(OPEN), _safe(F.col("role")), F.lit("\n"), _safe(F.col("text")), F.lit(CLOSE + "\n"))
    before = Window.partitionBy("pair_id").orderBy(*_TURN).rowsBetween(Window.unboundedPreceding, -1)
    rows = conversations.select("pair_id", *_TURN, rendered.alias("r"))
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("r")).over(before), F.lit(0)))
    head = len(OPEN) + F.length(_safe(F.col("role"))) + 1
    span = F.when(F.col("role") == TRAINED_ROLE, F.struct((F.col("start") + head).alias("start"), (F.col("start") + F.length("r") - 1).alias("end")))
    return rows.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct(*_TURN, "r", span.alias("span")))).alias(name))


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, n_prefix (turns), prompt, and chosen, rejected, chosen_spans and rejected_spans.

    Both inputs have pair_id, turn, role and text.
    """
    both = _side(chosen, "c").join(_side(rejected, "d"), "pair_id", "full")
    same = F.zip_with("c", "d", lambda a, b: F.coalesce((a["r"] == b["r"]), F.lit(False)))
    both = both.withColumn("same", F.coalesce(same, F.array(F.lit(False))))
    first = F.array_position("same", False)
    both = both.withColumn("n", F.when(first == 0, F.size("same")).otherwise(first - 1).cast("int"))
    text = lambda turns: F.array_join(F.transform(turns, lambda t: t["r"]), "")
    rest = lambda c: F.slice(F.col(c), F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    spans = lambda turns: F.filter(F.transform(turns, lambda t: t["span"]), lambda s: s.isNotNull())
    return both.select(
        "pair_id",
        F.col("n").cast("bigint").alias("n_prefix"),
        text(F.slice(F.coalesce("c", "d"), F.lit(1), F.col("n"))).alias("prompt"),
        text(rest("c")).alias("chosen"), text(rest("d")).alias("rejected"),
        spans(rest("c")).alias("chosen_spans"), spans(rest("d")).alias("rejected_spans"),
    )


def stale_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen: each conversation up to its last assistant's turn. Rejected: the same, but that turn repeats the assistant's reply before (empty if there is none)."""
    own = Window.partitionBy("conv_id")
    order = own.orderBy(*_TURN)
    assistant = F.coalesce(F.col("role") == TRAINED_ROLE, F.lit(False))
    reply = F.when(assistant, F.coalesce("text", F.lit("")))
    rows = conversations.select("conv_id", *_TURN).withColumns({
        "k": F.sum(assistant.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "last": F.sum(assistant.cast("int")).over(own),
        "stale": F.last(reply, True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
    })
    final = assistant & (F.col("k") == F.col("last"))
    rows = rows.where((F.col("k") < F.col("last")) | final)
    wrong = F.when(final, F.coalesce("stale", F.lit(""))).otherwise(F.col("text"))
    return rows.select(F.col("conv_id").alias("pair_id"), *_TURN), rows.select(F.col("conv_id").alias("pair_id"), "turn", "role", wrong.alias("text"))


def op3_preferences(spark, sf_dir: str) -> DataFrame:
    pairs = preference_pairs(*stale_replies(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return pairs.select(
        F.col("pair_id").alias("conv_id"), "n_prefix", F.sha2("prompt", 256).alias("prompt_sha256"), F.sha2("chosen", 256).alias("chosen_sha256"), F.sha2("rejected", 256).alias("rejected_sha256"),
        shown("chosen_spans").alias("chosen_spans"), shown("rejected_spans").alias("rejected_spans"),
    )


def _r(text: str) -> str:
    safe = lambda c: f"replace(coalesce({c}, ''), '<|im_', '< |im_')"
    return f"'{OPEN}' || {safe('role')} || chr(10) || {safe(text)} || '{CLOSE}' || chr(10)"


SQL = f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p FROM conversations),
a AS (SELECT conv_id, max(p) AS e FROM n WHERE role = '{TRAINED_ROLE}' GROUP BY conv_id),
s AS (SELECT conv_id, coalesce(max_by(coalesce(text, ''), p), '') AS old FROM n JOIN a USING (conv_id) WHERE role = '{TRAINED_ROLE}' AND p < e GROUP BY conv_id),
t AS (SELECT conv_id, p, e, role, {_r("text")} AS c, CASE WHEN p = e THEN {_r("coalesce(old, '')")} ELSE {_r("text")} END AS d
      FROM n JOIN a USING (conv_id) LEFT JOIN s USING (conv_id) WHERE p <= e),
g AS (SELECT conv_id, any_value(e) AS e, bool_and(c = d) AS whole, string_agg(c, '' ORDER BY p) FILTER (p < e) AS prompt,
             max(c) FILTER (p = e) AS c, max(d) FILTER (p = e) AS d FROM t GROUP BY conv_id),
h AS (SELECT *, coalesce(prompt, '') AS q, length(coalesce(prompt, '')) AS x, {len(OPEN) + len(TRAINED_ROLE) + 1} AS y FROM g)
SELECT conv_id, CASE WHEN whole THEN e ELSE e - 1 END::BIGINT AS n_prefix, sha256(CASE WHEN whole THEN q || c ELSE q END) AS prompt_sha256,
  sha256(CASE WHEN whole THEN '' ELSE c END) AS chosen_sha256, sha256(CASE WHEN whole THEN '' ELSE d END) AS rejected_sha256,
  CASE WHEN whole THEN '' ELSE (x + y) || '-' || (x + length(c) - 1) END AS chosen_spans,
  CASE WHEN whole THEN '' ELSE (x + y) || '-' || (x + length(d) - 1) END AS rejected_spans FROM h"""
