"""Roll-ups of counters, timers, events and heartbeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUSPECT_AFTER, DEAD_AFTER = 6.0, 15.0


def counters(t: DataFrame) -> DataFrame:
    return t.groupBy("name").agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


def gauges(t: DataFrame) -> DataFrame:
    """The last value of each node's gauge."""
    return t.groupBy("node", "name").agg(F.round(F.max_by("value", F.struct("ts", "seq")), 6).alias("value"))


def timers(t: DataFrame) -> DataFrame:
    return t.groupBy("node", "name").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("max"))


def recent(t: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` events: each task keeps n, and no more meet."""
    return t.orderBy(F.desc("ts"), F.desc("seq")).limit(n).select("seq", "node", "name", "ts")


def state_of_age(age: Column) -> Column:
    return F.when(age > DEAD_AFTER, "DEAD").when(age > SUSPECT_AFTER, "SUSPECT").otherwise("ALIVE")


def member_state(t: DataFrame, now: Column, unit_seconds: float) -> DataFrame:
    """ALIVE, SUSPECT or DEAD by the age of the last heartbeat, in units of ``unit_seconds``."""
    last = t.groupBy("node").agg(F.max("ts").alias("last_seen"))
    age = (F.unix_timestamp(now) - F.unix_timestamp("last_seen")) / unit_seconds
    return last.select("node", "last_seen", state_of_age(age).alias("state"))


def ewma(t: DataFrame, keep: float = 0.75, first: float = 0.05) -> DataFrame:
    """An exponentially weighted mean of each node's values in order of time."""
    values = F.array_sort(F.collect_list(F.struct("ts", "seq", "value")))
    folded = F.aggregate(values, F.lit(first), lambda a, x: keep * a + (1 - keep) * x["value"])
    return t.groupBy("node").agg(F.round(folded, 6).alias("rtt"), F.count("*").alias("n"))


def tumbling(t: DataFrame, width: str) -> DataFrame:
    return t.groupBy(F.window("ts", width), "name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "name", "n", "total")


def sessions(t: DataFrame, gap: str) -> DataFrame:
    return t.groupBy("node", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("node", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def summary(residency: DataFrame) -> DataFrame:
    """Files by state on all nodes, with chunks held and wanted."""
    state = lambda s: F.count_if(F.col("state") == s).alias(s.lower())
    return residency.groupBy("file").agg(state("PHANTOM"), state("PARTIAL"), state("RESIDENT"), F.sum("have").alias("have"), F.sum("want").alias("want"))


def latest_counts(t: DataFrame, n: int) -> DataFrame:
    """The last ``n`` events of each node."""
    order = Window.partitionBy("node").orderBy(F.desc("seq"))
    return t.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).select("node", "seq", "name")


def ordered(totals: DataFrame, first: list[str]) -> DataFrame:
    """Counter totals (name, total) with their place in a report: those of ``first`` in that order, then the others by name."""
    place = F.array_position(F.array(*[F.lit(x) for x in first]), F.col("name"))
    order = Window.orderBy(F.when(place > 0, place).otherwise(len(first) + 1), "name")  # one row for each counter's name
    return totals.withColumn("place", F.row_number().over(order).cast("bigint"))


def node_summary(nodes: DataFrame, holdings: DataFrame, manifests: DataFrame, known: DataFrame, killed: Column, capacity: Column) -> DataFrame:
    """A row for each node (node, rack): up, chunks and bytes stored, files and bytes it presents (``known``: node, file), their ratio, and whether it is over its capacity."""
    sizes = manifests.groupBy("file").agg(F.sum("size").alias("bytes"))
    shown = known.join(sizes, "file").groupBy("node").agg(F.sum("bytes").alias("logical_bytes"), F.count("*").alias("files"))
    stored = holdings.groupBy("node").agg(F.count("*").alias("chunks"), F.sum("size").alias("store_bytes"))
    rows = nodes.join(shown, "node", "left").join(stored, "node", "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
    ratio = F.round(F.col("logical_bytes") / F.when(F.col("store_bytes") > 0, F.col("store_bytes")), 2)
    return rows.select("node", "rack", (~killed).alias("up"), zero("chunks"), zero("store_bytes"), zero("files"), zero("logical_bytes"), ratio.alias("ratio"), (F.coalesce("store_bytes", F.lit(0)) > capacity).alias("over_budget"))
