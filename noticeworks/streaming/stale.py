"""Runs that stay in progress for too long, found while status updates stream in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from noticeworks.operators.verdicts import STALE_SECONDS

UPDATES = "expediente string, status string, updated_at timestamp"
# Runs are kept together in so many groups by their keys, so that a call into Python serves many of them.
GROUPS = 1024
# Of fewer keys than this each is looked up, of more the whole group is read.
FEW = 16
IDLE = STALE_SECONDS * 1000 + 1
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OpenRuns(StatefulProcessor):
    """Keeps, for a group of keys, when every open run counts as abandoned, and a timer for the first of them.

    A key without an open run has no state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "expediente string", "due bigint")

    def _held(self, keys) -> dict[str, int]:
        """When the runs of these keys, or of the whole group, are due."""
        if len(keys) < FEW:
            return {key: self.runs.getValue((key,))[0] for key in keys if self.runs.containsKey((key,))}
        return {key: due for (key,), (due,) in self.runs.iterator()} if self.runs.exists() else {}

    def _wake(self, due: int) -> None:
        """Sets the timer, unless an earlier one is set."""
        timers = list(self.handle.listTimers())
        if all(due < timer for timer in timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest: dict[str, tuple[str, int]] = {}
        for batch in rows:
            timed = batch.dropna(subset=["updated_at"]).sort_values("updated_at", ascending=False, kind="stable")
            last = timed.drop_duplicates("expediente")
            # The first millisecond at which a run has been idle for longer than it may be.
            due = last["updated_at"].to_numpy("datetime64[ms]").astype("int64") + IDLE
            for name, status, at in zip(last["expediente"], last["status"], due.tolist()):
                if name not in newest or at >= newest[name][1]:
                    newest[name] = (status, at)
        held = self._held(newest)
        begun = []
        for name, (status, at) in newest.items():
            if at < held.get(name, at):
                continue
            if status == "in_progress":
                begun.append(at)
                self.runs.updateValue((name,), (at,))
            elif name in held:
                self.runs.removeKey((name,))
        if begun:
            self._wake(min(begun))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = {name: due for (name,), (due,) in self.runs.iterator()}
        over = [name for name, due in held.items() if due <= now]
        updated = pd.to_datetime([held[name] - IDLE for name in over], unit="ms")
        failed = pd.DataFrame({"expediente": over, "status": ["failed"] * len(over)}, dtype=object)
        for name in over:
            self.runs.removeKey((name,))
            del held[name]
        if held:
            self.handle.registerTimer(min(held.values()))
        if over:
            yield failed.assign(updated_at=updated)

    def close(self) -> None:
        pass


def stale_runs(updates: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """A failed row for every run the event time has passed by more than the allowed idle time.

    `updates` is a stream of (expediente, status, updated_at). The state holds one small row
    per open run, which goes when the run ends, and one timer per group of keys. The session's state store must be
    the RocksDB one, see `start_stale`.
    """
    return (
        updates.withWatermark("updated_at", lateness)
        .withColumn("keys", F.pmod(F.xxhash64("expediente"), F.lit(GROUPS)))
        .groupBy("keys")
        .transformWithStateInPandas(OpenRuns(), UPDATES, "append", "eventTime")
    )


def start_stale(spark: SparkSession, source: str, out: str, checkpoint: str, lateness: str = "0 seconds") -> StreamingQuery:
    """Reads all updates that landed in a folder, writes the failed runs, and stops."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        updates = spark.readStream.schema(UPDATES).parquet(source)
        failed = stale_runs(updates, lateness).withColumn("found_at", F.current_timestamp())
        return (
            failed.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(_PROVIDER, before)
