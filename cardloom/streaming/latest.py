"""Latest observation per key, batch and streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.deals import decide


def latest(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The value of the last observation (ts, then event_id) of each key; the same plan for batch and stream.

    State is one row a key. In a stream the sink takes complete or updated rows."""
    return events.groupBy(*keys).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("observed_at"))


def fresh(observations: DataFrame, now: Column, hours: int = 12) -> DataFrame:
    """Observations whose time to live has not run out: it ends ``hours`` after they were made."""
    return observations.where(F.col("observed_at") + F.make_interval(hours=F.lit(hours)) > now)


def start_latest(stream: DataFrame, keys: Sequence[str], name: str, checkpoint: str):
    """Run ``latest`` over what a streaming source holds now, into the in-memory table ``name``."""
    return (
        latest(stream, keys).writeStream.outputMode("complete").format("memory").queryName(name)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def start_decisions(offers: DataFrame, values: DataFrame, name: str, checkpoint: str):
    """Decide over what a stream of offers holds now, against static values, into the in-memory table ``name``; no state."""
    return (
        decide(offers, values).writeStream.outputMode("append").format("memory").queryName(name)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
