import json

from pyspark.sql import functions as F

from corpusloom.operators import admission
from corpusloom.plans.schemas import RESULT, TASK
from corpusloom.sources import sinks, tables
from corpusloom.streaming import crawl

JOB = "id string, status string, max_depth int, max_pages long, max_pages_per_domain long, allowed_domains array<string>, include_patterns array<string>, exclude_patterns array<string>, follow_external_links boolean, default_license string, seeds array<string>"


def land(path, *messages):
    path.mkdir(exist_ok=True)
    n = len(list(path.iterdir()))
    (path / f"{n:04d}.json").write_text("\n".join(m if isinstance(m, str) else json.dumps(m) for m in messages))


def edge(url):
    return {"url": url, "source_url": "https://s.com", "job_id": "j", "depth": 1}


def test_admission_stream_equals_batch_and_resumes(spark, tmp_path):
    jobs = spark.createDataFrame([("j", "Running", 3, None, None, [], [], [], True, None, [])], JOB)
    raw, out, ck = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "ck")
    land(raw, [edge("https://a.com/1"), edge("https://a.com/1#x"), edge("http://10.0.0.1/")], edge("https://a.com/2"), "broken")

    def run():
        stream = spark.readStream.text(str(raw))
        crawl.admission_stream(stream, lambda: jobs, lambda: None, out, ck).awaitTermination()
        return sorted(r.url for r in spark.read.parquet(f"{out}/tasks").collect())

    assert run() == ["https://a.com/1", "https://a.com/2"]
    assert spark.read.parquet(f"{out}/malformed").count() == 1
    land(raw, [edge("https://a.com/2"), edge("https://a.com/3")])
    assert run() == ["https://a.com/1", "https://a.com/2", "https://a.com/3"]
    assert run() == ["https://a.com/1", "https://a.com/2", "https://a.com/3"]
    everything = spark.read.text(str(raw))
    good, _ = crawl.edges(everything)
    batch = admission.admit(good.withColumn("seq", F.monotonically_increasing_id()), jobs)
    assert sorted(r.url for r in admission.tasks(batch).collect()) == run()


def test_result_stream(spark, tmp_path):
    raw, table = tmp_path / "raw", str(tmp_path / "t")
    media = {"source": "s", "source_id": "1", "license": "cc-by", "title": "t"}
    row = {"job_id": "j", "source_url": "u", "domain": "d", "status": {"kind": "Success"}, "crawl_duration_ms": 3}
    land(raw, row, row, {**row, "source_url": "m", "media_meta": media})
    stream = lambda: crawl.result_stream(spark.readStream.schema(RESULT).json(str(raw)), table, str(tmp_path / "ck"), lambda: F.timestamp_millis(F.lit(0)))
    stream().awaitTermination()
    land(raw, {**row, "source_url": "m", "media_meta": media, "status": {"kind": "FetchError"}})
    stream().awaitTermination()
    assert sorted(r.url for r in sinks.read_table(spark, f"{table}/pages").collect()) == ["m", "u"]
    track = sinks.read_table(spark, f"{table}/tracks").collect()
    assert [(t.status, t.title) for t in track] == [("failed", "t")]


def test_messages_and_state(spark, tmp_path):
    raw = tmp_path / "raw"
    land(raw, {"url": "https://a.com", "job_id": "j", "depth": 0, "kind": "Page"}, "not json")
    good, bad = tables.messages(spark, str(raw), TASK)
    for name, df in (("good", good.select("url")), ("bad", bad)):
        df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("good").count() == 1 and spark.table("bad").first().value == "not json"
    rows = tmp_path / "rows"
    land(rows, *[{"domain": "d", "seq": k, "arrival_ms": 0, "delay_ms": 100 if k == 1 else None} for k in range(3)])
    read = lambda: spark.readStream.schema("domain string, seq long, arrival_ms long, delay_ms long").json(str(rows))

    def collect(df, name):
        def write(batch, _):
            batch.write.mode("append").parquet(str(tmp_path / name))

        df.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / name)).orderBy("seq").collect()

    assert [r.scheduled_ms for r in collect(crawl.delay_stream(read(), 250), "delays")] == [0.0, 100.0, 200.0]
    assert sum(r.admitted for r in collect(crawl.budget_stream(read(), "domain", 2), "budget")) == 2
    land(rows, {"domain": "d", "seq": 9, "arrival_ms": 0, "delay_ms": None})
    assert [r.scheduled_ms for r in collect(crawl.delay_stream(read(), 250), "delays")][-1] == 300.0
    assert sum(r.admitted for r in collect(crawl.budget_stream(read(), "domain", 2), "budget")) == 2


def test_windows(spark, tmp_path):
    raw = tmp_path / "e"
    land(raw, *[{"ts": f"2024-01-01T00:0{m}:00Z", "k": "a"} for m in (0, 0, 1, 9)])
    stream = spark.readStream.schema("ts timestamp, k string").json(str(raw))
    counts = crawl.windowed_counts(stream, "ts", "1 minute", "2 minutes", ["k"])
    counts.writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.table("w").collect()) == [1, 2]
    first = crawl.first_seen(spark.readStream.schema("ts timestamp, k string").json(str(raw)), ["k"], "ts", "1 hour")
    first.writeStream.format("memory").queryName("f").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("f").count() == 1


def test_budgets_over_many_batches(spark, tmp_path, monkeypatch):
    """Forty batches, the first 33 of which admit nothing, across the rounds at which counts are added up; batches at and after such a round run twice."""
    monkeypatch.setattr(crawl, "TOTALS", 8)
    out, total = str(tmp_path / "out"), {}
    for number in range(40):
        for _ in range(2 if number % 8 == 0 or number > 33 else 1):
            used = crawl._used(spark, out, number)
            got = {} if used is None else {(r.root, r.job_id): r.n for r in used.groupBy("root", "job_id").agg(F.sum("n").alias("n")).collect()}
            assert got == total, number
            rows = [("a.com", "j", 3), (f"b{number}.com", "k", 1)] if number >= 33 else []
            spark.createDataFrame(rows, "root string, job_id string, n long").coalesce(1).write.mode("overwrite").parquet(f"{out}/counts/batch={number}")
        for root, j, n in rows:
            total[root, j] = total.get((root, j), 0) + n


def test_a_stream_keeps_to_its_budget_and_knows_its_pages(spark, tmp_path):
    jobs = spark.createDataFrame([("j", "Running", 3, 4, None, [], [], [], True, None, [])], JOB)
    raw, out, ck, table = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "ck"), str(tmp_path / "t")
    land(tmp_path / "results", {"job_id": "j", "source_url": "https://a.com/9", "domain": "a.com", "status": {"kind": "Success"}, "crawl_duration_ms": 3})
    crawl.result_stream(spark.readStream.schema(RESULT).json(str(tmp_path / "results")), table, str(tmp_path / "ck2"), lambda: F.timestamp_millis(F.lit(0))).awaitTermination()
    reasons = []
    for batch in range(4):
        land(raw, *[edge(f"https://a.com/{n}") for n in (9, batch, batch + 1, batch + 20)])
        crawl.admission_stream(spark.readStream.text(str(raw)), lambda: jobs, lambda: crawl.page_index(spark, table), out, ck, publish=True).awaitTermination()
        reasons.append(sorted((int(r.url.rsplit("/", 1)[1]), r.reason) for r in spark.read.parquet(f"{out}/rejected/batch={batch}").collect()))
    assert sorted(int(r.url.rsplit("/", 1)[1]) for r in spark.read.parquet(f"{out}/tasks").collect()) == [0, 1, 2, 20]
    assert reasons[0] == [(9, "already_crawled")] and reasons[1] == [(1, "seen"), (9, "already_crawled"), (21, "job_cap")]
    assert reasons[2] == [(2, "seen"), (3, "job_cap"), (9, "already_crawled"), (22, "job_cap")]
    good, bad = tables.messages(spark, f"{out}/messages/*", TASK)
    good.writeStream.format("memory").queryName("sent").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("sent").count() == 4
