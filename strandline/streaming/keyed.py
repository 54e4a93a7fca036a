"""Pollers whose memory is one entry per artifact or file, kept in the state store.

Every function takes a stream and returns a stream; no micro-batch reads what earlier ones wrote. The rows of a key that
arrive in one micro-batch are ordered in one task, so the size of micro-batches (maxFilesPerTrigger) bounds its memory. The state
store is RocksDB, which these functions set on the session before the stream starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from strandline.functions.paths import folder_of

P = "project_id"
NODE = ["project_id", "node_id"]
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed(rows: DataFrame, keys: list[str]):
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return rows.groupBy(*keys)


# The processors are defined inside the functions, so that workers get them with the job and need not find this package.


def version_stream(shots: DataFrame) -> DataFrame:
    """(node_id, v, ts, seq, hash) of the snapshots (node_id, ts, seq, hash) whose content differs from the one before.

    Numbers follow arrival: a snapshot of a later micro-batch gets a later number whatever its time says; within one, ts and seq
    give the order. State: the last hash and number per artifact.
    """
    class Numbers(StatefulProcessor):
        def init(self, handle) -> None:
            self.last = handle.getValueState("last", "v int, hash string")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            frame = pd.concat([f[["us", "seq", "hash"]] for f in rows]).sort_values(["us", "seq"], kind="stable").astype(object)
            frame = frame.where(frame.notna(), None)
            v, last = self.last.get() if self.last.exists() else (0, None)
            found = []
            for us, seq, content in frame.itertuples(index=False):
                if v == 0 or content != last:
                    v, last = v + 1, content
                    found.append((*key, v, us, seq, content))
            self.last.update((v, last))
            if found:
                yield pd.DataFrame(found, columns=[*NODE, "v", "us", "seq", "hash"])

    rows = shots.select(*NODE, F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), "hash")
    numbered = _keyed(rows, NODE).transformWithStateInPandas(
        Numbers(), "project_id string, node_id string, v int, us long, seq long, hash string", "Append", "None")
    return numbered.select(*NODE, "v", F.timestamp_micros("us").alias("ts"), "seq", "hash")


def state_change_stream(states: DataFrame, forget_seconds: int | None = None) -> DataFrame:
    """(node_id, ts, seq, state) whenever the state of an artifact differs from the one last reported; a first `ok` is silent.

    A null state says that the artifact was removed: it is forgotten at once, without a report. With `forget_seconds` an artifact
    is also forgotten when the watermark of `states` is that far past its last row; Spark then drops rows behind the
    watermark. State: the last state per artifact, and its timer.
    """
    class Changes(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "state string")
            self.timer = handle.getValueState("timer", "at long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            frame = pd.concat([f[["us", "seq", "state"]] for f in rows]).sort_values(["us", "seq"], kind="stable").astype(object)
            frame = frame.where(frame.notna(), None)
            last = self.last.get()[0] if self.last.exists() else None
            found = []
            for us, seq, state in frame.itertuples(index=False):
                if state is not None and state != (last or "ok"):
                    found.append((*key, us, seq, state))
                last = state
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
                self.timer.clear()
            if last is None:
                self.last.clear()
            else:
                self.last.update((last,))
                if forget_seconds is not None:
                    at = int(frame["us"].max()) // 1000 + 1000 * forget_seconds
                    self.handle.registerTimer(at)
                    self.timer.update((at,))
            if found:
                yield pd.DataFrame(found, columns=[*NODE, "us", "seq", "state"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.last.clear()
            self.timer.clear()
            return iter([])

    rows = states.select(*NODE, "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), "state")
    changed = _keyed(rows, NODE).transformWithStateInPandas(
        Changes(), "project_id string, node_id string, us long, seq long, state string", "Append",
        "None" if forget_seconds is None else "EventTime")
    return changed.select(*NODE, F.timestamp_micros("us").alias("ts"), "seq", "state")


def new_file_stream(files: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(path, size, mtime, round, changed_since_seen) of files that are new or have another size or time than remembered.

    `files` are listings (project_id, path, size, mtime, round). The first round of a project has number 0 and only fills the
    memory. `seen` (project_id, path, size, mtime) is a memory from before the stream, loaded when it first starts. State: size and
    time per path, in one map per folder.
    """
    class Seen(StatefulProcessor):
        def init(self, handle) -> None:
            self.seen = handle.getMapState("seen", "path string", "what string")

        def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
            for path, what in initialState[["path", "what"]].itertuples(index=False):
                self.seen.updateValue((path,), (what,))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            frame = pd.concat([f[["round", "path", "what"]] for f in rows]).sort_values("round", kind="stable").astype(object)
            frame = frame.where(frame.notna(), None)
            found = []
            for n, path, what in frame.itertuples(index=False):
                before = self.seen.getValue((path,))[0] if self.seen.containsKey((path,)) else None
                if before != what:
                    self.seen.updateValue((path,), (what,))
                    if n > 0:
                        found.append((key[0], path, what, n, before is not None))
            if found:
                yield pd.DataFrame(found, columns=[P, "path", "what", "round", "changed_since_seen"])

    # size and time as one text: numbers that may be null lose digits on their way through pandas
    kind = "size long, mtime long"
    pair = F.to_json(F.struct(F.col("size").cast("long").alias("size"), F.col("mtime").cast("long").alias("mtime")))
    place = [P, folder_of(F.col("path")).alias("folder"), "path", pair.alias("what")]
    known = seen.dropDuplicates([P, "path"]).select(*place).groupBy(P, "folder") if seen is not None else None
    rows = files.select(*place, F.col("round").cast("long").alias("round"))
    found = _keyed(rows, [P, "folder"]).transformWithStateInPandas(
        Seen(), "project_id string, path string, what string, round long, changed_since_seen boolean", "Append", "None", known)
    return found.select(P, "path", F.from_json("what", kind).alias("w"), "round", "changed_since_seen").select(
        P, "path", "w.size", "w.mtime", "round", "changed_since_seen")
