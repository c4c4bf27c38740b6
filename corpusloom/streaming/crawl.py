"""Streaming forms: admission, page and manifest sinks, seen-set, budgets, delays and windowed counters.

A micro-batch runs the batch operators and writes by key, so a replayed batch changes nothing; state that must outlive a batch is
kept by Spark's state store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.admission import accepted_counts, admit, decode_edges, tasks
from ..operators.manifest import PAGE_KEY, TRACK_KEY, latest, merge_tracks, page_rows, result_tracks
from ..plans.options import Admission
from ..sources import sinks
from ..sources.keyed import BucketTable, KeyIndex
from ..sources.retry import RetryLane


def edges(raw: DataFrame, payload: str = "value") -> tuple[DataFrame, DataFrame]:
    """(edges, malformed) of messages that hold an array of edges or one edge."""
    parsed = raw.withColumn("_e", decode_edges(F.col(payload)))
    return parsed.filter("_e is not null").select(F.explode("_e").alias("e")).select("e.*"), parsed.filter("_e is null").select(payload)


def admission_stream(raw: DataFrame, jobs: Callable[[], DataFrame], pages: Callable[[], DataFrame | KeyIndex | None], out: str, checkpoint: str, options: Admission = Admission(), publish: bool = False) -> StreamingQuery:
    """Admit each micro-batch against the jobs and pages as they are then, and the tasks written so far; refused rows go beside the tasks.

    Budgets hold over the life of the stream: each batch starts from what the earlier ones accepted, which is kept as counts by
    domain and job, added up every `TOTALS` batches. What was admitted before is told by a key index, whose runs a batch neither shuffles nor sorts; `pages`
    may be one too (`result_stream` keeps one beside its pages). A batch's tasks, counts and keys are written under its number, and a replay
    overwrites them, so a crash between write and commit leaves no repeats. Any failure in the existence check fails the batch, which is then replayed. With
    `publish`, the tasks are also written as messages by batch number, in the form that `tables.messages` reads.
    """
    seen = KeyIndex(raw.sparkSession, f"{out}/seen")
    key = ["url_norm"] if options.url_across_jobs else ["job_id", "url_norm"]

    def run(batch: DataFrame, number: int) -> None:
        good, bad = edges(batch)
        good = good.withColumn("seq", F.monotonically_increasing_id())
        kept: list[DataFrame] = []
        existing = pages()
        earlier = lambda rows, columns: seen.hits(rows, columns, number)
        rows = admit(good, jobs(), existing, earlier, options, used=_used(batch.sparkSession, out, number), kept=kept).persist()
        kept.append(rows)
        try:
            done = tasks(rows, options)
            accepted_counts(rows).write.mode("overwrite").parquet(f"{out}/counts/batch={number}")
            done.select("*", F.col("url").alias("url_norm")).write.mode("overwrite").parquet(f"{out}/tasks/batch={number}")
            if publish:
                sinks.published(done, f"{out}/messages/batch={number}", "overwrite")
            rows.filter("reason is not null").select("url", "job_id", "reason").write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")
            bad.write.mode("overwrite").parquet(f"{out}/malformed/batch={number}")
            seen.add(rows.filter("reason is null"), key, number)
        finally:
            for frame in kept:
                frame.unpersist()
            for index in (seen, existing):
                if isinstance(index, KeyIndex):
                    index.close()

    return raw.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Batches after which the counts by domain and job are added up.
TOTALS = 32


def _used(spark: SparkSession, out: str, number: int) -> DataFrame | None:
    """(root, job_id, n) of all batches before this one: the totals of the full rounds of `TOTALS` batches, and the counts since.

    The first batch after a round adds it up from the counts of that round and the totals before it alone; a total without rows counts as made.
    """

    def read(kind: str, batches: range) -> DataFrame | None:
        paths = [f"{out}/{kind}/batch={n}" for n in batches if sinks.exists(spark, f"{out}/{kind}/batch={n}")]
        return spark.read.schema("root string, job_id string, n long").parquet(*paths) if paths else None

    def both(a: DataFrame | None, b: DataFrame | None) -> DataFrame | None:
        return a if b is None else b if a is None else a.union(b)

    since = number // TOTALS * TOTALS
    if since and not sinks.exists(spark, f"{out}/totals/batch={since}/_SUCCESS"):
        whole = both(read("counts", range(since - TOTALS, since)), read("totals", range(since - TOTALS, since - TOTALS + 1)))
        if whole is not None:
            whole.groupBy("root", "job_id").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{out}/totals/batch={since}")
    return both(read("counts", range(since, number)), read("totals", range(since, since + 1)))


def result_stream(results: DataFrame, table: str, checkpoint: str, now: Callable[[], F.Column] = F.current_timestamp) -> StreamingQuery:
    """Append page rows of new keys, batch by batch, and merge media rows into the buckets of the manifest that they fall in.

    Pages are never written again: a batch adds its own rows, whose keys are not in the key index of earlier batches (`page_index`). The manifest's other
    buckets keep their files. Each step is under the batch's number and starts from what the batch before left, so a replay does the same again.
    A merge into the manifest that fails does not hold up the pages: its rows wait in a retry lane and go with the next batches.
    """
    spark = results.sparkSession
    known, tracks, lane = page_index(spark, table), BucketTable(spark, f"{table}/tracks", TRACK_KEY), RetryLane(spark, f"{table}/retries")

    def run(batch: DataFrame, number: int) -> None:
        rows = page_rows(batch, now()).withColumn("seq", F.monotonically_increasing_id())
        fresh = known.unseen(latest(rows, PAGE_KEY, ["seq"], first=True), PAGE_KEY, number).drop("seq").persist()
        try:
            sinks.write_batch(fresh, f"{table}/pages", number)
            known.add(fresh, PAGE_KEY, number)
        finally:
            fresh.unpersist()
            known.close()

        def merge(rows: DataFrame) -> None:
            ordered = rows.withColumn("seq", F.monotonically_increasing_id())
            tracks.merge(ordered, lambda old, new: merge_tracks(old, new, order="seq"), number, empty=rows)

        lane.step(result_tracks(batch), number, merge)

    return results.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page_index(spark: SparkSession, table: str) -> KeyIndex:
    """The keys (domain, job_id, url) of a table of pages that `result_stream` writes; `admission_stream` takes it in place of the pages."""
    return KeyIndex(spark, f"{table}/page_keys")


def first_seen(urls: DataFrame, key: list[str], event_time: str | None = None, within: str | None = None) -> DataFrame:
    """First occurrence of each key over the whole stream, or within a watermark so that state is bounded."""
    if event_time is None or within is None:
        return urls.dropDuplicates(key)
    return urls.withWatermark(event_time, within).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, ts: str, window: str, late: str, by: list[str]) -> DataFrame:
    """Counts per event-time window and key, final once the watermark has passed."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", window).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


class Budget(StatefulProcessor):
    """Accepts the first `cap` rows of a key over the life of the stream; the counter is durable state."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        used = int(self.used.get()[0]) if self.used.exists() else 0
        for part in rows:
            part = part.copy()
            part["admitted"] = [used + i < self.cap for i in range(len(part))]
            used = min(self.cap, used + len(part))
            yield part
        self.used.update((used,))

    def close(self) -> None:
        pass


class Delays(StatefulProcessor):
    """Schedules requests of a domain: max(arrival, last scheduled + period), the period only ever growing."""

    def __init__(self, default_ms: int):
        self.default_ms = default_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "last double, longest double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        last, longest = self.state.get() if self.state.exists() else (None, None)
        for part in rows:
            part, out = part.sort_values("seq"), []
            for arrival, delay in zip(part["arrival_ms"], part["delay_ms"], strict=True):
                if not pd.isna(delay) and (longest is None or delay > longest):
                    longest = float(delay)
                period = float(self.default_ms) if longest is None else 1000.0 if longest == 0 else max(1.0, longest)
                last = float(arrival) if last is None else max(float(arrival), last + period)
                out.append(last)
            yield part.assign(scheduled_ms=out)
        self.state.update((last, longest))

    def close(self) -> None:
        pass


def budget_stream(rows: DataFrame, key: str, cap: int) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", admitted boolean"
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=Budget(cap), outputStructType=schema, outputMode="Append", timeMode="None")


def delay_stream(rows: DataFrame, default_ms: int, key: str = "domain") -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", scheduled_ms double"
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=Delays(default_ms), outputStructType=schema, outputMode="Append", timeMode="None")
