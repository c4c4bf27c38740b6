"""Progress and observed values of streaming queries as metric samples."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..plans.schemas import SAMPLE

#: Names of observed values begin with what they are.
COUNTER, GAUGE = "counter_", "gauge_"


def observed(rows: DataFrame, name: str, counters: dict[str, Column] | None = None, gauges: dict[str, Column] | None = None) -> DataFrame:
    """`rows` with named aggregates that are taken as they pass: counters add up over a stream's batches, gauges hold the last batch's value.

    No further job runs for them; a `MetricsListener` of the session gets them with the progress of each batch.
    """
    named = [c.alias(f"{COUNTER}{k}") for k, c in (counters or {}).items()] + [c.alias(f"{GAUGE}{k}") for k, c in (gauges or {}).items()]
    return rows.observe(f"corpusloom_{name}", *named)


class MetricsListener(StreamingQueryListener):
    """Keeps the last samples of each query; `frame` makes them a table for the metric operators, `flush` writes those that are new."""

    def __init__(self, component: str, keep: int = 10_000):
        self.component, self.keep, self.samples, self.totals = component, keep, [], {}
        self.lock, self.fresh = threading.Lock(), []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        ts = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
        values = {f"{p.name or p.id}_{k}": float(v) for k, v in {"rows_total": p.numInputRows, "batch_duration_ms": p.batchDuration, "state_rows": sum(s.numRowsTotal for s in p.stateOperators)}.items()}
        for name, row in p.observedMetrics.items():
            if not name.startswith("corpusloom_"):
                continue
            for key, value in row.asDict().items():
                if key.startswith(COUNTER):
                    metric = key.removeprefix(COUNTER)
                    self.totals[p.runId, metric] = values[metric] = self.totals.get((p.runId, metric), 0.0) + float(value or 0)
                elif key.startswith(GAUGE) and value is not None:
                    values[key.removeprefix(GAUGE)] = float(value)
        self.add(ts, values)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        for key in [k for k in self.totals if k[0] == event.runId]:
            del self.totals[key]

    def add(self, ts: datetime, values: dict[str, float]) -> None:
        rows = [(ts, self.component, metric, None, value) for metric, value in values.items()]
        with self.lock:
            self.samples += rows
            del self.samples[: -self.keep]
            self.fresh += rows
            del self.fresh[: -self.keep]

    def frame(self, spark: SparkSession) -> DataFrame:
        with self.lock:
            return spark.createDataFrame(list(self.samples), SAMPLE)

    def flush(self, spark: SparkSession, path: str) -> int:
        """Append the samples that were not written yet to the table of samples; they stay to be written if that fails."""
        with self.lock:
            rows = list(self.fresh)
        if rows:
            spark.createDataFrame(rows, SAMPLE).coalesce(1).write.mode("append").parquet(path)
            with self.lock:
                del self.fresh[: len(rows)]
        return len(rows)


def refresh_stream(spark: SparkSession, listener: MetricsListener, path: str, gauges: dict[str, Callable[[], float]] | None = None, every: str = "15 seconds", checkpoint: str | None = None) -> StreamingQuery:
    """Take the gauges and write new samples to `path` at every trigger of the clock.

    A gauge that fails is left out of that tick, as the others go on.
    """

    def run(batch: DataFrame, number: int) -> None:
        values = {}
        for name, read in (gauges or {}).items():
            try:
                values[name] = float(read())
            except Exception as problem:  # noqa: BLE001  a gauge of another system may fail for a while
                print(f"gauge {name} left out: {problem}")
        listener.add(datetime.now(timezone.utc), values)
        listener.flush(batch.sparkSession, path)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    stream = ticks.writeStream.queryName(f"refresh_{uuid.uuid4().hex[:8]}").foreachBatch(run).trigger(processingTime=every)
    return (stream.option("checkpointLocation", checkpoint) if checkpoint else stream).start()
