"""Keyed state: the reflection queue an entity at a time, and results that a session has seen.

Both keep what they know of a key in the state store, so a micro-batch touches only the keys it
has rows of, and a restart goes on from the checkpoint. Rows of a key are taken in order of time within a
batch, and in order of arrival between batches. Timers are of event time: they fire when the watermark
passes them. The session needs the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marlstone.functions.scoring import priority_of

TTL_MINUTES, STALE_HOURS, RETRIES = 30, 2.0, 3
SEEN_SCHEMA = "session_id string, item string, at timestamp"
ITEM_SCHEMA = "key long, evidence long, status string, priority double, retries long, retrieval_count long"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


def _ms(at: pd.Series) -> list[int]:
    return (at.astype("datetime64[us]").astype("int64") // 1000).tolist()


class SeenResults(StatefulProcessor):
    """Passes each item of a session once, until the session rests for longer than ``ttl_ms``; then its state goes."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")
        self.seen = handle.getMapState("seen", "item string", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows, ["at", "item"])
        before = last = self.last.get()[0] if self.last.exists() else None
        passed = []
        for i, (item, at) in enumerate(zip(batch["item"], _ms(batch["at"]))):
            if last is not None and at - last > self.ttl_ms:
                self.seen.clear()
            last = at if last is None else max(last, at)
            if not self.seen.containsKey((item,)):
                self.seen.updateValue((item,), (at,))
                passed.append(i)
        if before is not None and before != last:
            self.handle.deleteTimer(before + self.ttl_ms + 1)
        self.last.update((last,))
        self.handle.registerTimer(last + self.ttl_ms + 1)
        if passed:
            yield batch.iloc[passed][["session_id", "item", "at"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def unseen(results: DataFrame, ttl_minutes: float = TTL_MINUTES, late: str = "10 minutes") -> DataFrame:
    """A stream of (session_id, item, at) without what its session has seen; rows of a null session or item are dropped."""
    rows = results.select(F.col("session_id").cast("string").alias("session_id"), F.col("item").cast("string").alias("item"), "at").where("session_id IS NOT NULL AND item IS NOT NULL AND at IS NOT NULL")
    grouped = rows.withWatermark("at", late).groupBy("session_id")
    return grouped.transformWithStateInPandas(SeenResults(int(ttl_minutes * 60_000)), SEEN_SCHEMA, "append", "EventTime")


class ReflectionQueue(StatefulProcessor):
    """The queue item of one entity and its counts.

    Events: extraction (one more evidence, pending), deletion (urgent, pending, no retries), retrieval
    (counts, renews the priority), claim (a pending item is processing), complete, fail (a retry, or dead_letter
    at the last). A claim that is neither completed nor failed within ``stale_ms`` is pending again.
    """

    def __init__(self, stale_ms: int, retries: int) -> None:
        self.stale_ms, self.retries = stale_ms, retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "evidence long, status string, priority double, retries long, claimed long")
        self.counts = handle.getValueState("counts", "mentions long, retrievals long")

    def _counts(self) -> tuple[int, int]:
        return tuple(self.counts.get()) if self.counts.exists() else (1, 1)

    def _row(self, key, item) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *item[:4], self._counts()[1])], columns=["key", "evidence", "status", "priority", "retries", "retrieval_count"])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        if not pd.isna(r["mention_count"]):  # counts are kept of entities only
            self.counts.update((int(r["mention_count"]), 0 if pd.isna(r["retrieval_count"]) else int(r["retrieval_count"])))
        if not pd.isna(r["status"]):
            self.item.update((int(r["evidence"]), r["status"], float(r["priority"]), int(r["retries"]), 0))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        item = tuple(self.item.get()) if self.item.exists() else None
        batch = _in_order(rows, ["at", "kind"])
        known = self.counts.exists()
        mentions, retrievals = self._counts()
        changed = False
        for kind, at in zip(batch["kind"], _ms(batch["at"])):
            evidence, status, priority, tries, claimed = item or (0, "pending", 0.0, 0, 0)
            if kind == "retrieval":
                retrievals += int(known)
                item = item and (evidence, status, priority_of(evidence, mentions, retrievals), tries, claimed)
            elif kind == "extraction":
                item = (evidence + 1, "pending", priority_of(evidence + 1, mentions, retrievals), tries, 0)
            elif kind == "deletion":
                item = (evidence, "pending", 1.0, 0, 0)
            elif kind == "claim" and item and status == "pending":
                item = (evidence, "processing", priority, tries, at)
            elif kind in ("complete", "fail") and item and status == "processing":
                tries += kind == "fail"
                item = (evidence, "completed" if kind == "complete" else "dead_letter" if tries >= self.retries else "pending", priority, tries, 0)
            else:
                continue
            changed = True
        if known:
            self.counts.update((mentions, retrievals))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if item:
            self.item.update(item)
            if item[1] == "processing":
                self.handle.registerTimer(item[4] + self.stale_ms)
            if changed:
                yield self._row(key, item)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.item.exists():
            evidence, status, priority, tries, claimed = self.item.get()
            if status == "processing" and claimed + self.stale_ms <= expiredTimerInfo.getExpiryTimeInMs():
                item = (evidence, "pending", priority, tries, 0)
                self.item.update(item)
                yield self._row(key, item)

    def close(self) -> None:
        pass


def reflection_queue(events: DataFrame, entities: DataFrame, queue: DataFrame | None = None, stale_hours: float = STALE_HOURS, retries: int = RETRIES, late: str = "1 hour") -> DataFrame:
    """A stream of the items that (key, kind, at) changes, each as it is after a batch: the last row of a key holds.

    ``entities`` (key, mention_count, retrieval_count) and ``queue`` (key, evidence, status, priority, retries) are where a new checkpoint begins.
    """
    start = entities.select("key", F.col("mention_count").cast("long").alias("mention_count"), F.col("retrieval_count").cast("long").alias("retrieval_count"))
    empty = start.limit(0).select("key", F.lit(0).cast("long").alias("evidence"), F.lit("").alias("status"), F.lit(0.0).alias("priority"), F.lit(0).cast("long").alias("retries"))
    start = start.join(empty if queue is None else queue.select("key", "evidence", "status", "priority", "retries"), "key", "full")
    grouped = events.select(F.col("key").cast("long").alias("key"), "kind", "at").where("key IS NOT NULL AND at IS NOT NULL").withWatermark("at", late).groupBy("key")
    return grouped.transformWithStateInPandas(ReflectionQueue(int(stale_hours * 3_600_000), retries), ITEM_SCHEMA, "update", "EventTime", start.groupBy("key"))
