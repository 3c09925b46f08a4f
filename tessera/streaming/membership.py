"""Failure detection as a stream: heartbeats in, states of members out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.telemetry import DEAD_AFTER, SUSPECT_AFTER

SCHEMA = "node bigint, heartbeat bigint, last_seen timestamp, state string"
_STATE = "heartbeat bigint, last_seen timestamp"


def track(heartbeats: DataFrame, unit_seconds: float, late: str = "1 day") -> DataFrame:
    """The newest heartbeat of each node (node, hb, ts) and its state by the watermark.

    A heartbeat that isn't larger than the known one is ignored, like a late one. A node without
    news gets a timer for the next change of its state.
    """
    suspect, dead = (int(1000 * unit_seconds * x) for x in (SUSPECT_AFTER, DEAD_AFTER))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        beat, seen = state.get if state.exists else (-1, pd.Timestamp(0))
        if not state.hasTimedOut:
            for f in frames:
                if len(f) and f["hb"].max() > beat:
                    best = f.loc[f["hb"].idxmax()]
                    beat, seen = int(best["hb"]), best["ts"]
        now = state.getCurrentWatermarkMs()
        ms = int(seen.timestamp() * 1000)
        name = "DEAD" if now - ms > dead else "SUSPECT" if now - ms > suspect else "ALIVE"
        state.update((beat, seen))
        if name != "DEAD":
            state.setTimeoutTimestamp(max(ms + (dead if name == "SUSPECT" else suspect) + 1, now + 1))
        yield pd.DataFrame({"node": [key[0]], "heartbeat": [beat], "last_seen": [seen], "state": [name]})

    return heartbeats.withWatermark("ts", late).groupBy("node").applyInPandasWithState(step, SCHEMA, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of heartbeats."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a stream reads a pattern or a folder, not a file
    return raw.select(F.col("user_id").alias("node"), F.col("event_id").alias("hb"), F.col("ts").cast("timestamp").alias("ts"))


def run_once(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, exactly once, into a folder, and read what it wrote."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")  # a batch that is run again replaces itself

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out/batch=*")


def telemetry_windows(events: DataFrame, width: str, late: str) -> DataFrame:
    """Counts of events (name, ts) in tumbling windows, closed once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "name").count().select(F.col("window.start").alias("start"), "name", F.col("count").alias("n"))
