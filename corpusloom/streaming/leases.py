"""Leases that run out by a timer: a claimed track that nobody finishes becomes pending again without a claim in sight."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.manifest import TRACK_KEY
from ..sources.keyed import BucketTable

#: What a lease event says.
CLAIMED, ENDED = "claimed", "ended"
EXPIRED = "source string, source_id string, leased_until long"


class Leases(StatefulProcessor):
    """One lease a key: a claim sets its end (ms) and a timer there, a newer claim moves both, an end clears them; the timer emits the key.

    With `event_time`, an event that comes at or after a lease's end finds it run out, so what runs out does not depend on how events fall into batches.
    """

    def __init__(self, event_time: bool = True):
        self.event_time = event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def _clear(self) -> None:
        if self.until.exists():
            self.handle.deleteTimer(int(self.until.get()[0]))
            self.until.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        events = pd.concat(list(rows)).sort_values("ts", kind="stable")  # a track's events in one batch
        over = []
        for kind, until, at in zip(events["event"], events["leased_until"], events["ts"], strict=True):
            if self.event_time and self.until.exists() and int(self.until.get()[0]) <= at.value // 1_000_000:
                over.append(int(self.until.get()[0]))
            self._clear()
            if kind == CLAIMED and not pd.isna(until):
                self.until.update((int(until),))
                self.handle.registerTimer(int(until))
        if over:
            yield pd.DataFrame({"source": [key[0]] * len(over), "source_id": [key[1]] * len(over), "leased_until": over})

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        until = expiredTimerInfo.getExpiryTimeInMs()
        if self.until.exists() and int(self.until.get()[0]) == until:
            self.until.clear()
            yield pd.DataFrame({"source": [key[0]], "source_id": [key[1]], "leased_until": [until]})

    def close(self) -> None:
        pass


def expired_leases(events: DataFrame, late: str = "0 seconds", by_clock: bool = False) -> DataFrame:
    """(source, source_id, leased_until) of each lease that runs out, from a stream of events (source, source_id, event, ts, leased_until in ms).

    Time is the watermark of `ts`, or the clock with `by_clock`. A claim whose end has passed already runs out at once. State and timers
    are in the checkpoint; the stream must be started within `timers`.
    """
    timed = events.withWatermark("ts", late)
    return timed.groupBy(*TRACK_KEY).transformWithStateInPandas(statefulProcessor=Leases(not by_clock), outputStructType=EXPIRED, outputMode="Append", timeMode="ProcessingTime" if by_clock else "EventTime")


def released(tracks: DataFrame, expired: DataFrame) -> DataFrame:
    """The manifest after leases ran out: a track that is still downloading under that very lease is pending."""
    gone = expired.groupBy(*TRACK_KEY).agg(F.max("leased_until").alias("_until"))
    open_ = (F.col("status") == "downloading") & (F.col("leased_until") <= F.col("_until"))
    joined = tracks.join(gone, TRACK_KEY, "left")
    back = F.coalesce(open_, F.lit(False))
    return joined.select(*[F.when(back, F.lit("pending")).otherwise(F.col("status")).alias(c) if c == "status" else F.when(~back, F.col(c)).alias(c) if c == "leased_until" else F.col(c) for c in tracks.columns])


def lease_stream(events: DataFrame, table: str, checkpoint: str, late: str = "0 seconds", by_clock: bool = False) -> StreamingQuery:
    """Release expired leases in the manifest by buckets (`BucketTable` at `table`, with a column leased_until), under each batch's number."""
    manifest = BucketTable(events.sparkSession, table, TRACK_KEY)

    def run(batch: DataFrame, number: int) -> None:
        gone = batch.persist()
        try:
            if manifest.version() is not None and not gone.isEmpty():
                manifest.merge(gone, released)
        finally:
            gone.unpersist()

    stream = expired_leases(events, late, by_clock).writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint)
    with timers(events.sparkSession):
        return (stream if by_clock else stream.trigger(availableNow=True)).start()


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """Streams that start within it keep their state in RocksDB, which timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)
