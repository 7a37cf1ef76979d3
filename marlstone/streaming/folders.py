"""Changes of a folder as a stream: the difference of scans, kept as state of each path.

A scan lists all files of a folder at one time (``scan``); scans are appended to a log, which is read as a stream. A file
counts as changed when it has rested for the debounce, and as deleted when no scan has listed it for the absence. What
is due is settled by event time, before the row that comes later or by a timer, so how scans fall into micro-batches makes no difference.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marlstone.sources.readers import files
from marlstone.streaming.keyed import _in_order, _ms

SCAN_SCHEMA = "path string, modified timestamp, at timestamp"
CHANGE_SCHEMA = "path string, change string, modified timestamp, at timestamp"
BEAT = ""  # the path of the row that each scan has besides its files: time goes on in an empty folder too


def scan(spark: SparkSession, path: str, at: datetime, pattern: str = "*") -> DataFrame:
    """(path, modified, at): the files of a folder now, and one row for the scan itself. Append it to the log as one file, or take an absence longer than the writing."""
    here = files(spark, path, pattern).select("path", F.col("modificationTime").cast("timestamp").alias("modified"), F.lit(at).cast("timestamp").alias("at"))
    return here.unionByName(spark.range(1).select(F.lit(BEAT).alias("path"), F.lit(None).cast("timestamp").alias("modified"), F.lit(at).cast("timestamp").alias("at")))


class FolderChanges(StatefulProcessor):
    """State of a path: what was told of it (null: nothing yet), whether it is gone, what waits since when, and when it was listed last (milliseconds)."""

    def __init__(self, debounce_ms: int, absence_ms: int) -> None:
        self.debounce_ms, self.absence_ms = debounce_ms, absence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", "told long, gone boolean, waiting long, since long, last long")

    def _settle(self, file: tuple, until: int) -> tuple[tuple, list[tuple[str, int | None, int]]]:
        """The state and the changes when all that is due by ``until`` has been told; absence is due when ``until`` is behind it, rest when it is reached."""
        told, gone, waiting, since, last = file
        out = []
        rested = None if waiting is None else since + self.debounce_ms
        if rested is not None and rested <= until and rested <= last + self.absence_ms:
            if gone or told is None or waiting > told:
                out.append(("returning" if gone else "new" if told is None else "changed", waiting, rested))
            told, gone, waiting, since = waiting, False, None, None
        if last + self.absence_ms < until and not (gone and waiting is None):
            if told is not None and not gone:
                out.append(("deleted", None, last + self.absence_ms))
                gone = True
            waiting = since = None
        return (told, gone, waiting, since, last), out

    def _keep(self, file: tuple) -> None:
        told, gone, waiting, since, last = file
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if told is None and waiting is None:
            self.file.clear()
            return
        self.file.update(file)
        if waiting is not None:
            self.handle.registerTimer(since + self.debounce_ms + 1)
        if waiting is not None or not gone:
            self.handle.registerTimer(last + self.absence_ms + 1)

    def _rows(self, path: str, out: list[tuple[str, int | None, int]]) -> Iterator[pd.DataFrame]:
        if out:
            pdf = pd.DataFrame([(path, *o) for o in out], columns=["path", "change", "modified", "at"])
            pdf["modified"], pdf["at"] = (pd.to_datetime(pdf[c], unit="ms", utc=True) for c in ("modified", "at"))
            yield pdf

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows, ["at", "modified"])
        if key[0] == BEAT:
            return
        file = tuple(self.file.get()) if self.file.exists() else (None, False, None, None, None)
        out = []
        for modified, at in zip(_ms(batch["modified"]), _ms(batch["at"])):
            if file[4] is not None:
                if at < file[4]:  # an older scan than what is known
                    continue
                file, due = self._settle(file, at)
                out += due
            told, gone, waiting, since, _ = file
            if waiting is not None and modified != waiting or waiting is None and (gone or told is None or modified > told):
                waiting, since = modified, at
            file, due = self._settle((told, gone, waiting, since, at), at)
            out += due
        self._keep(file)
        yield from self._rows(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.file.exists():
            file, out = self._settle(tuple(self.file.get()), expiredTimerInfo.getExpiryTimeInMs())
            self._keep(file)
            yield from self._rows(key[0], out)

    def close(self) -> None:
        pass


def changes(scans: DataFrame, debounce_seconds: float = 2.0, absence_seconds: float = 90.0, late: str = "0 seconds") -> DataFrame:
    """A stream of (path, change, modified, at) of a stream of scans: new, changed (a later time), returning (deleted and there again), deleted.

    Take an absence of at least the time between two scans. Times are in milliseconds. Rows without a path, a time of change or a time of scan are
    dropped; a file listed twice in a scan counts by both rows; a file that goes before it has rested was never there.
    """
    rows = scans.select(F.col("path").cast("string").alias("path"), F.when(F.col("path") == BEAT, F.col("at")).otherwise(F.col("modified")).alias("modified"), "at")
    rows = rows.where("path IS NOT NULL AND modified IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    processor = FolderChanges(int(debounce_seconds * 1000), int(absence_seconds * 1000))
    return rows.groupBy("path").transformWithStateInPandas(processor, CHANGE_SCHEMA, "append", "EventTime")
