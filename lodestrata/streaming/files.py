"""The state of every file of an ingest, as a stream of its events: real times, failures, time limits, and state that ends."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.state import ERROR_CHARS
from ..sources.keyed import KeyedTable

STATES = "collection string, file_hash string, status string, started_at timestamp, updated_at timestamp, error string"
HELD = "status string, started_us long, updated_us long, error string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(at: pd.Timestamp) -> int:
    return at.value // 1000


def after(held: tuple | None, status: str, at: int, error: str | None) -> tuple:
    """(status, started, updated, error) after an event: a start takes back a failure, not a completion, and keeps the first start."""
    was, started, updated, _ = held or (None, at, at, None)
    if status == "started":
        status, error = ("completed" if was == "completed" else "in_progress"), None
    if status != "failed":
        error = None
    elif error and len(error) > ERROR_CHARS:
        error = error[: ERROR_CHARS - 1] + "…"
    return status, started, max(at, updated), error or None


class FileStates(StatefulProcessor):
    """A file that was started and doesn't end within ``limit`` fails; what has ended is forgotten after ``memory``. Both in seconds of event time."""

    def __init__(self, limit: int, memory: int):
        self.limit, self.memory = limit, memory

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)

    def told(self, key: Any, held: tuple) -> pd.DataFrame:
        self.held.update(held)
        status, started, updated, error = held
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(updated // 1000 + 1000 * (self.limit if status == "in_progress" else self.memory))
        times = [pd.Timestamp(x, unit="us") for x in (started, updated)]
        return pd.DataFrame([(*key, status, *times, error)], columns=["collection", "file_hash", "status", "started_at", "updated_at", "error"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.held.get() if self.held.exists() else None
        rank = {"started": 0, "completed": 1, "failed": 2}
        events = sorted(((micros(r.at), rank[r.status], r.status, r.error) for pdf in rows for r in pdf.itertuples() if r.status in rank), key=lambda x: x[:2])
        for at, _, status, error in events:
            held = after(held, status, at, error if isinstance(error, str) else None)
        if events:
            yield self.told(key, tuple(held))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.held.exists():
            return
        held = self.held.get()
        if held[0] == "in_progress":
            yield self.told(key, after(held, "failed", expiredTimerInfo.getExpiryTimeInMs() * 1000, f"no end within {self.limit} seconds"))
        else:
            self.held.clear()


def file_states(events: DataFrame, late: str = "10 minutes", limit: int = 3600, memory: int = 86_400) -> DataFrame:
    """A row for each change of a file's state. events: a stream of (collection, file_hash, status, at, error), status being
    started, completed or failed.

    Events without collection, hash or time are none. Those later than ``late`` behind the newest are dropped, so that the state holds
    the files of about ``limit`` or ``memory`` seconds, whatever is replayed; needs the RocksDB state store (see with_states).
    """
    e = events.select("collection", "file_hash", "status", F.col("at").cast("timestamp").alias("at"), "error")
    e = e.where("collection <> '' and file_hash <> '' and at is not null").withWatermark("at", late)
    return e.groupBy("collection", "file_hash").transformWithStateInPandas(FileStates(limit, memory), STATES, "Update", "EventTime")


def with_states(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


def manifest_table(path: str, buckets: int = 64) -> KeyedTable:
    return KeyedTable(path, STATES, ("collection", "file_hash"), ("updated_at", "status"), buckets)


def follow(events: DataFrame, manifest: KeyedTable, checkpoint: str, **how: Any) -> StreamingQuery:
    """Keep the manifest up to date with a stream of events. A batch that is run again leaves the same table."""
    with_states(events.sparkSession)
    states = file_states(events, **how)
    return states.writeStream.outputMode("update").foreachBatch(lambda batch, _: manifest.upsert(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(manifest: DataFrame, collection: str) -> DataFrame:
    return manifest.where((F.col("collection") == collection) & (F.col("status") == "in_progress")).select("file_hash", "started_at")


def completed(manifest: DataFrame, collection: str) -> DataFrame:
    return manifest.where((F.col("collection") == collection) & (F.col("status") == "completed")).select("file_hash")


def failed(manifest: DataFrame, collection: str) -> DataFrame:
    return manifest.where((F.col("collection") == collection) & (F.col("status") == "failed")).select("file_hash", "error")
