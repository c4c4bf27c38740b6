"""Leases by timers, the retry lane, observed metrics."""

import json
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import metrics
from corpusloom.plans.schemas import RESULT
from corpusloom.sources import sinks
from corpusloom.sources.keyed import BucketTable
from corpusloom.sources.retry import RetryLane
from corpusloom.streaming import crawl, leases
from corpusloom.streaming.listener import MetricsListener, observed, refresh_stream

EVENT = "source string, source_id string, event string, ts timestamp, leased_until long"


def land(path, *rows):
    path.mkdir(exist_ok=True)
    (path / f"{len(list(path.iterdir())):04d}.json").write_text("\n".join(map(json.dumps, rows)))


def event(i, kind, second, until=None):
    return {"source": "s", "source_id": str(i), "event": kind, "ts": f"2024-01-01T00:00:{second:02d}Z", "leased_until": None if until is None else 1704067200000 + until * 1000}


def test_a_lease_that_runs_out_becomes_pending(spark, tmp_path):
    raw, table = tmp_path / "events", BucketTable(spark, str(tmp_path / "t"), ["source", "source_id"], buckets=4)
    rows = [("s", str(i), "downloading", 1704067200000 + 10_000) for i in range(1, 5)]
    table.merge(spark.createDataFrame(rows, "source string, source_id string, status string, leased_until long"), lambda old, new: new)
    stream = lambda: leases.lease_stream(spark.readStream.schema(EVENT).json(str(raw)), str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination()
    state = lambda: {r.source_id: (r.status, r.leased_until) for r in table.read().collect()}
    land(raw, event(1, "claimed", 0, 10), event(2, "claimed", 0, 10), event(3, "claimed", 0, 10), event(3, "claimed", 1, 30), event(4, "claimed", 2, 10))
    stream()
    assert {s for s, _ in state().values()} == {"downloading"}
    land(raw, event(2, "ended", 5))
    stream()  # a restart keeps the timers
    land(raw, event(9, "ended", 12))  # no claim in sight: time alone
    stream()
    assert {k for k, (s, _) in state().items() if s == "pending"} == {"1", "4"} and state()["1"] == ("pending", None)
    land(raw, event(9, "ended", 40))
    stream()
    # the manifest still shows track 3 under its first lease, which is over too
    assert {k for k, (s, _) in state().items() if s == "pending"} == {"1", "3", "4"} and state()["2"][0] == "downloading"


def test_release_leaves_newer_leases_alone(spark):
    tracks = spark.createDataFrame([("s", "1", "downloading", 5), ("s", "2", "downloading", 9), ("s", "3", "done", 5), ("s", "4", "downloading", None)], "source string, source_id string, status string, leased_until long")
    gone = spark.createDataFrame([("s", "1", 5), ("s", "2", 5), ("s", "3", 5), ("s", "4", 5)], leases.EXPIRED)
    assert {r.source_id: r.status for r in leases.released(tracks, gone).collect()} == {"1": "pending", "2": "downloading", "3": "done", "4": "downloading"}


def test_what_fails_twice_is_not_lost(spark, tmp_path):
    lane, written, broken = RetryLane(spark, str(tmp_path / "lane")), [], [True]
    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")

    def write(rows):
        if broken[0]:
            raise OSError("store is away")
        written.extend(r.v for r in rows.collect())

    for batch in (0, 1):
        for _ in range(2):  # a replay
            lane.step(frame(batch * 2, batch * 2 + 1), batch, write)
    assert sorted((r.v, r._attempts, r._since) for r in lane.pending().collect()) == [(0, 1, 0), (1, 1, 0), (2, 0, 1), (3, 0, 1)]
    broken[0] = False
    lane.step(frame(9), 2, write)
    assert written == [0, 1, 2, 3, 9] and lane.pending() is None


def test_ten_failures_and_a_full_lane(spark, tmp_path):
    frame = lambda *v: spark.createDataFrame([(x, None) for x in v], "v int, w string")
    lane = RetryLane(spark, str(tmp_path / "a"), attempts=3)
    bad = lambda rows: rows.filter("v = 7")  # noqa: E731  one row fails again and again
    gone = [lane.step(frame(7, 8) if n == 0 else frame(n + 20), n, bad) for n in range(4)]
    assert [0 if g is None else g.count() for g in gone] == [0, 0, 0, 1] and lane.pending() is None
    small = RetryLane(spark, str(tmp_path / "b"), most=3)
    for n in range(3):
        small.step(frame(2 * n, 2 * n + 1), n, lambda rows: rows)
    assert sorted(r.v for r in small.pending().collect()) == [3, 4, 5]


def test_pages_go_on_while_the_manifest_fails(spark, tmp_path, monkeypatch):
    raw, table = tmp_path / "raw", str(tmp_path / "t")
    media = {"source": "s", "source_id": "1", "license": "cc-by", "title": "t"}
    row = {"job_id": "j", "source_url": "m", "domain": "d", "status": {"kind": "Success"}, "crawl_duration_ms": 3}
    run = lambda: crawl.result_stream(spark.readStream.schema(RESULT).json(str(raw)), table, str(tmp_path / "ck"), lambda: F.timestamp_millis(F.lit(0))).awaitTermination()
    land(raw, {**row, "media_meta": media})
    with monkeypatch.context() as m:
        m.setattr(crawl, "merge_tracks", lambda *a, **k: 1 / 0)
        run()
    assert sinks.read_table(spark, f"{table}/pages").count() == 1 and sinks.read_table(spark, f"{table}/tracks") is None
    land(raw, {**row, "source_url": "n", "media_meta": {**media, "source_id": "2"}})
    run()
    assert sorted(r.source_id for r in sinks.read_table(spark, f"{table}/tracks").collect()) == ["1", "2"]


@pytest.fixture
def listener(spark):
    found = MetricsListener("coordinator")
    spark.streams.addListener(found)
    yield found
    spark.streams.removeListener(found)


def test_observed_values_become_samples(spark, tmp_path, listener):
    raw, out = tmp_path / "raw", str(tmp_path / "samples")
    raw.mkdir()
    rows = observed(spark.readStream.schema("k int").json(str(raw)), "pages", {"pages_total": F.count(F.lit(1)), "odd_total": F.count_if(F.col("k") % 2 == 1)}, {"largest": F.max("k")})
    land(raw, {"k": 0})
    query = rows.writeStream.format("noop").queryName("q").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    land(raw, {"k": 1}, {"k": 3})
    query.processAllAvailable()
    land(raw, {"k": 2}, {"k": 5})
    query.processAllAvailable()
    deadline = time.time() + 20
    while time.time() < deadline and sum(s[2] == "largest" for s in listener.samples) < 3:
        time.sleep(0.2)
    query.stop()
    ticks = refresh_stream(spark, listener, out, {"jobs_running": lambda: 4, "frontier_size": lambda: 1 / 0}, "1 second")
    while time.time() < deadline + 20 and not (sinks.exists(spark, f"{out}/_SUCCESS") and spark.read.parquet(out).filter("metric = 'jobs_running'").count()):
        time.sleep(0.3)
    ticks.stop()
    samples = spark.read.parquet(out)
    assert [r.value for r in samples.filter("metric = 'pages_total'").orderBy("ts").collect()] == [1.0, 3.0, 5.0]
    assert [r.value for r in samples.filter("metric = 'largest'").orderBy("ts").collect()] == [0.0, 3.0, 5.0]
    lines = {r.line for r in metrics.exposition(samples).collect()}
    assert {'pages_total{component="coordinator"} 5', 'odd_total{component="coordinator"} 3', 'jobs_running{component="coordinator"} 4'} <= lines and not any("frontier_size" in x for x in lines)
    rates = metrics.rate(samples.filter("metric = 'pages_total'"), "1 hour", 3600)
    assert abs(sum(r.rate for r in rates.collect()) - 4 / 3600) < 1e-9
