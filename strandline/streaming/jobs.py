"""Continuous forms of the pollers, as Structured Streaming jobs.

Versions, state changes and new files keep their memory in the state store (`keyed`); rows behind the watermark are in `late`, the
upkeep of stale artifacts in `upkeep`. Jobs in foreachBatch write under the number of the micro-batch, so a repeated one replaces its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

P = "project_id"
NODE = ["project_id", "node_id"]


def activity_windows(events: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events per window, actor and kind; `slide` gives overlapping windows."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (events.groupBy(window, "actor", "event").agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").alias("start"), "actor", "event", "n"))


def growth_stream(marks: DataFrame) -> DataFrame:
    """Running totals per project and kind (nodes, versions); use update mode."""
    return marks.groupBy(P, "kind").agg(F.count(F.lit(1)).alias("n"))


def heartbeat_timeouts(beats: DataFrame, seconds: int = 60, delay: str = "0 seconds") -> DataFrame:
    """(job_id, last_beat) of jobs without a heartbeat for `seconds`, once event time has passed that point."""
    def silent(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "last_ms": [last]})
            return
        newest = max(int(frame["ms"].max()) for frame in frames)
        last = max(newest, state.get[0]) if state.exists else newest
        state.update((last,))
        state.setTimeoutTimestamp(max(last + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    marked = beats.withWatermark("ts", delay).select("job_id", "ts", F.unix_millis("ts").alias("ms"))
    quiet = marked.groupBy("job_id").applyInPandasWithState(
        silent, "job_id string, last_ms long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return quiet.select("job_id", F.timestamp_millis("last_ms").alias("last_beat"))


def autosave_batch(saves_path: str, log_path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch over state changes (with mode): managed changes ask for a new version, others are logged."""
    def run(batch: DataFrame, n: int) -> None:
        batch = batch.where(F.col("state").isin("modified", "missing"))
        saves = (F.col("state") == "modified") & (F.col("mode") == "managed")
        batch.where(saves).select(*NODE, "ts", F.lit("autosave (watch)").alias("message"), F.lit("watch").alias("actor")
                                  ).write.mode("overwrite").parquet(f"{saves_path}/batch={n}")
        event = F.when(F.col("state") == "missing", "missing_on_disk").otherwise("modified_on_disk")
        batch.where(~saves).select(*NODE, "ts", event.alias("event"), F.lit("watch").alias("actor")
                                   ).write.mode("overwrite").parquet(f"{log_path}/batch={n}")

    return run
