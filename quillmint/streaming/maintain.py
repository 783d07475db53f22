"""Structured Streaming paths: windowed counts, deduplicated intake, change-log merges and keyed autonomy states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """Audit events as they land, their time as a timestamp that a watermark can follow."""
    return spark.readStream.schema(schema).parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events and their value by window and action; windows close once the watermark passes them."""
    span = F.window("at", width, slide) if slide else F.window("at", width)
    g = events.withWatermark("at", late).groupBy(span, "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("value"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A person's sessions: events no more than a gap apart."""
    g = events.withWatermark("at", late).groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(arrivals: DataFrame, key: list[str], late: str = "7 days") -> DataFrame:
    """Arrivals whose content was not seen within the watermark."""
    return arrivals.withWatermark("at", late).dropDuplicatesWithinWatermark(key)


def running_counts(events: DataFrame, keys: list[str]) -> DataFrame:
    """Counts kept as events come, for complete or update mode."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"))


AUTONOMY = "user_id long, event_id long, state string, clean long"
MEMORY = "state string, clean long"


def autonomy(events: DataFrame, needed: int = 5, floor: float = 2.0) -> DataFrame:
    """A supplier's state after each outcome: supervised until ``needed`` clean ones in a row, then autonomous; held by a fault.

    Outcomes of a batch are taken in (ts, event_id) order; state is two values a key.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], memory: GroupState) -> Iterator[pd.DataFrame]:
        state, clean = memory.get if memory.exists else ("supervised", 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        out = []
        for event, value in zip(rows["event_id"], rows["value"], strict=True):
            if value < floor:
                state, clean = ("held" if state == "autonomous" else "supervised"), 0
            else:
                clean += 1
                if clean >= needed:
                    state = "autonomous"
            out.append((key[0], event, state, clean))
        memory.update((state, clean))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "state", "clean"])

    return events.groupBy("user_id").applyInPandasWithState(step, AUTONOMY, MEMORY, "append", GroupStateTimeout.NoTimeout)


def merged(state: DataFrame, batch: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The table after a change-log batch: each key's row of the greatest sequence; the body of a foreachBatch merge."""
    rest = [c for c in state.columns if c not in keys]
    rows = state.unionByName(batch)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), sequence).alias("x")).select(*keys, *(F.col(f"x.{c}").alias(c) for c in rest))


def run_to(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is now, write it, and stop; the next run goes on from the checkpoint."""
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
