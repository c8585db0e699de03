"""Streaming page state with stuck-page timers.

Keyed state per page in the RocksDB state store; keys are spread by hash, one
small value per page. Late rows (behind the watermark) are dropped by the
engine before they reach the processor.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leafgrade.schemas import ACTIVE_STAGES

OUTPUT = "book_id string, page_number int, ts timestamp, event string, status string"
_STATE = "status string, ts timestamp"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PageStateProcessor(StatefulProcessor):
    """Per page: status changes, granted or refused claims, and a stuck alarm after ``limit_seconds``."""

    def __init__(self, limit_seconds: int = 60) -> None:
        self.limit_ms = limit_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("page", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, since = self.state.get() if self.state.exists() else (None, None)
        # a page has few rows per batch; the order inside a batch is by time, then id
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for r in batch.itertuples():
            if r.status is not None:
                status, since, event = r.status, r.ts, "status"
            elif status is None or status == "FAILED" or (status == "READY" and bool(r.refresh)):
                status, since, event = "PENDING", r.ts, "claim_granted"
            else:
                event = "claim_refused"
            out.append((key[0], key[1], r.ts, event, status))
        self.state.update((status, since))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if status in ACTIVE_STAGES:
            self.handle.registerTimer(int(pd.Timestamp(since).timestamp() * 1000) + self.limit_ms)
        yield pd.DataFrame(out, columns=["book_id", "page_number", "ts", "event", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        status, since = self.state.get()
        if status in ACTIVE_STAGES:
            yield pd.DataFrame([(key[0], key[1], since, "stuck", status)],
                               columns=["book_id", "page_number", "ts", "event", "status"])

    def close(self) -> None:
        pass


def stream_page_state(log: DataFrame, limit_seconds: int = 60, watermark: str = "10 minutes") -> DataFrame:
    """E1 + E3 on a stream (book_id, page_number, event_id, ts, status, refresh); needs the RocksDB provider."""
    typed = log.select("book_id", F.col("page_number").cast("int"), "event_id", "ts", "status",
                       F.coalesce("refresh", F.lit(False)).alias("refresh"))
    return typed.withWatermark("ts", watermark).groupBy("book_id", "page_number").transformWithStateInPandas(
        statefulProcessor=PageStateProcessor(limit_seconds), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
