"""Injected faults, what nodes know of each other, and small formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def human_bytes(n: Column) -> Column:
    """``12 B``, ``1.5 KB`` and so on up to TB; halves go to the even digit."""
    out = F.when(F.abs(n) < 1024, F.format_string("%d B", n.cast("bigint")))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(F.abs(n) < 1024.0 ** (k + 1), F.format_string(f"%.1f {unit}", F.bround(n / 1024.0**k, 1)))
    return out.otherwise(F.format_string("%.1f TB", F.bround(n / 1024.0**4, 1)))


def address(text: Column, default_host: str = "127.0.0.1") -> Column:
    """host and port of ``host:port`` or ``port``."""
    host, port = F.regexp_extract(text, r"^(.*):", 1), F.regexp_extract(text, r"(\d+)$", 1)
    return F.struct(F.when(host == "", default_host).otherwise(host).alias("host"), port.cast("int").alias("port"))


def fault_state(actions: DataFrame) -> DataFrame:
    """State of each node after all actions (node, seq, action, value): the last word on each field since the last reset."""
    own = Window.partitionBy("node")
    reset = F.coalesce(F.max(F.when(F.col("action") == "reset", F.col("seq"))).over(own), F.lit(-1))
    rows = actions.withColumn("reset", reset).where("seq > reset OR action = 'reset'")
    last = lambda *names: F.max_by(F.when(F.col("action") == names[-1], F.lit(0.0)).otherwise(F.col("value")) if len(names) == 2 else F.col("value"), F.when(F.col("action").isin(*names), F.col("seq")))
    killed = F.max_by("action", F.when(F.col("action").isin("kill", "revive"), F.col("seq")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.groupBy("node").agg(F.coalesce(killed == "kill", F.lit(False)).alias("killed"), zero(last("latency")).alias("latency_ms"), zero(last("throttle")).alias("throughput_bps"), zero(last("drop")).alias("drop_rate"), (zero(last("byzantine")) > 0).alias("byzantine"))


ACTIONS = ("kill", "revive", "partition", "heal", "latency", "throttle", "drop", "byzantine", "reset")


def reply(action: Column) -> Column:
    """What a node answers to a fault action: ok, and the reason if it doesn't know the action."""
    known = action.isin(*ACTIONS)
    return F.struct(F.coalesce(known, F.lit(False)).alias("ok"), F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("unknown action "), action)).alias("reason"))


def blocks(killed: Column, cut_off: Column, peer: Column) -> Column:
    """Whether a node, killed or cut off from the peers in an array, can't reach ``peer``."""
    return killed | F.coalesce(F.array_contains(cut_off, peer), F.lit(False))


def drops(drop_rate: Column, draw: Column) -> Column:
    """Whether a message is lost: ``draw`` is uniform in [0, 1)."""
    return (drop_rate > 0) & (draw < drop_rate)


def delay(latency_ms: Column, throughput_bps: Column, nbytes: Column) -> Column:
    """Seconds that a node holds back ``nbytes``: its latency, and the bytes at its throughput if that is limited."""
    return latency_ms / 1000.0 + F.when((throughput_bps > 0) & (nbytes > 0), nbytes / throughput_bps).otherwise(0.0)


def link_delay(rack_a: Column, rack_b: Column, draw: Column, intra_ms: float = 0.5, inter_ms: float = 12.0, jitter: float = 0.3) -> Column:
    """Seconds between two racks, with a jitter of ``draw`` (uniform in [0, 1))."""
    base = F.when(rack_a == rack_b, intra_ms).otherwise(inter_ms)
    return F.greatest(F.lit(0.0), base * (1 + (2 * draw - 1) * jitter)) / 1000.0


def partitions(actions: DataFrame) -> DataFrame:
    """(node, peer) that are cut off after all actions (node, seq, action, peer); a heal or reset without peer mends all."""
    own = Window.partitionBy("node")
    healed = F.coalesce(F.max(F.when(F.col("action").isin("heal", "reset") & F.col("peer").isNull(), F.col("seq"))).over(own), F.lit(-1))
    rows = actions.withColumn("healed", healed).where("seq > healed AND peer IS NOT NULL AND action IN ('partition', 'heal')")
    return rows.groupBy("node", "peer").agg(F.max_by("action", "seq").alias("a")).where("a = 'partition'").select("node", "peer")


def known_holders(reports: DataFrame, now: Column, deny_seconds: float = 20.0) -> DataFrame:
    """(node, hash) that a peer is believed to have from reports (node, hash, ts, present): denials count for ``deny_seconds``, then nothing is known."""
    last = reports.groupBy("node", "hash").agg(F.max_by("present", "ts").alias("present"), F.max("ts").alias("ts"))
    denied = ~F.col("present") & (F.unix_timestamp("ts") + deny_seconds > F.unix_timestamp(now))
    return last.select("node", "hash", F.when(F.col("present"), "holds").when(denied, "denied").otherwise("unknown").alias("belief"))


def merge_members(records: DataFrame) -> DataFrame:
    """The record of each id with the largest heartbeat; an equal one doesn't replace an earlier one (id, hb, seq, host)."""
    return records.groupBy("id").agg(F.max_by(F.struct("hb", "host"), F.struct("hb", -F.col("seq"))).alias("x"), F.min("seq").alias("learned")).select("id", "x.hb", "x.host", "learned")


def pins(changes: DataFrame) -> DataFrame:
    """Hashes that are pinned more often than unpinned (node, hash, delta)."""
    return changes.groupBy("node", "hash").agg(F.sum("delta").alias("n")).where("n > 0")
