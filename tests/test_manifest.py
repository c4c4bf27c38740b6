import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dedup, manifest, metrics, reports, schedule
from corpusloom.plans.schemas import RESULT, TRACK
from corpusloom.sources import catalogs, sinks, tables

BASE = {"source": "s", "source_id": "1", "job_id": "j", "url": "u", "license": "cc-by", "status": "pending"}


def tracks(spark, *rows):
    return spark.createDataFrame([tuple({**BASE, **r}.get(f.name) for f in TRACK.fields) for r in rows], TRACK)


def test_track_merge_rules(spark):
    old = tracks(spark, {"title": "old", "duration_secs": 9.0, "sha256": "h", "status": "done"}, {"source_id": "2"})
    new = tracks(spark, {"title": None, "artist": "new", "duration_secs": None, "status": "failed", "license": "cc-x", "url": "v"}, {"source_id": "3", "title": "n"})
    got = {r.source_id: r for r in manifest.merge_tracks(old, new).collect()}
    one = got["1"]
    assert (one.title, one.artist, one.duration_secs, one.sha256, one.status, one.license, one.url) == ("old", "new", None, "h", "failed", "cc-by", "u")
    assert got["2"].status == "pending" and got["3"].title == "n" and len(got) == 3
    merged = manifest.merge_tracks(old, new)
    again = manifest.merge_tracks(merged, new)
    assert sorted(map(str, merged.collect())) == sorted(map(str, again.collect()))
    assert {r.source_id: r.url for r in manifest.merge_tracks(old, new, replace_identity=True).collect()}["1"] == "v"


def test_upserts(spark):
    old = spark.createDataFrame([("d", "j", "a", 1), ("d", "j", "b", 1)], "domain string, job_id string, url string, v int")
    new = spark.createDataFrame([("d", "j", "b", 2, 0), ("d", "j", "c", 3, 1), ("d", "j", "c", 4, 2)], "domain string, job_id string, url string, v int, seq long")
    assert [(r.url, r.v) for r in manifest.insert_if_absent(new, old, manifest.PAGE_KEY).collect()] == [("c", 3)]
    assert sorted((r.url, r.v) for r in manifest.upsert(old, new, manifest.PAGE_KEY).collect()) == [("a", 1), ("b", 2), ("c", 4)]
    assert manifest.existing(new, old).count() == 1 and manifest.not_crawled(new, old).count() == 2 and manifest.not_crawled(new, old, by_url_alone=True).count() == 2
    jobs = spark.createDataFrame([("1", "n", "Running", "{}", 1, 1)], "job_id string, name string, status string, config string, created_at long, updated_at long")
    change = spark.createDataFrame([("1", "x", "Paused", "{1}", 5, 5), ("2", "y", "Running", "{}", 6, 6)], jobs.schema)
    assert sorted(map(tuple, manifest.upsert_jobs(jobs, change).collect())) == [("1", "n", "Paused", "{1}", 1, 5), ("2", "y", "Running", "{}", 6, 6)]
    assert manifest.set_job_status(jobs, spark.createDataFrame([("1", "Failed")], "job_id string, status string")).first().status == "Failed"


def test_results(spark):
    media = {"source": "s", "source_id": "1", "title": "meta", "artist": "a", "license": "cc-by"}
    rows = [{"job_id": "j", "source_url": "u", "status": {"kind": "Success"}, "content_hash": "f" * 64, "media_meta": media, "media_probe": {"duration_secs": 40.0, "artist": "probe"}}, {"job_id": "j", "source_url": "v", "status": {"kind": "QualityRejected", "message": "short"}, "content_hash": "x", "media_meta": {**media, "source_id": "2"}}, {"job_id": "j", "source_url": "w", "status": {"kind": "HttpError", "http_code": 404}}]
    df = spark.read.schema(RESULT).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    pages = manifest.page_rows(df, F.timestamp_millis(F.lit(0))).orderBy("url").collect()
    assert [(p.domain, p.http_status) for p in pages] == [("unknown", 0), ("unknown", -7), ("unknown", 404)]
    got = manifest.result_tracks(df).orderBy("source_id").collect()
    assert [(t.status, t.title, t.artist, t.sha256, t.error) for t in got] == [("done", "meta", "probe", "f" * 64, None), ("rejected", "meta", "a", None, "QualityRejected: short")]
    assert tuple(reports.outcome_counts(df).first())[:5] == (0, 1, 1, 1, 0)
    assert manifest.failure_result(spark.createDataFrame([("https://a.b.com/x", "j", None)], "url string, job_id string, media string"), F.lit("FetchError"), F.lit("m"), F.lit(None)).first().domain == "b.com"


def test_claims(spark):
    t = tracks(spark, {"source_id": "3"}, {"source_id": "1", "status": "downloading"}, {"source_id": "2", "status": "downloading"}, {"source_id": "4", "status": "done"}).withColumn("leased_until", F.when(F.col("source_id") == "1", 5).when(F.col("source_id") == "2", 500).cast("long"))
    got = manifest.claim(t, "s", 10, F.lit(100).cast("long"), 50)
    assert [(r.source_id, r.leased_until) for r in got.collect()] == [("3", 150), ("1", 150)]
    assert manifest.apply_claim(t, got).filter("status = 'downloading'").count() == 3


def test_reports(spark, tmp_path):
    t = tracks(spark, {"status": "done", "title": "T", "artist": "A", "bytes": 5, "duration_secs": 5400.0, "format": "mp3", "license_url": "https://deed", "album": "Al", "origin_page_url": "https://o"}, {"source_id": "2", "status": "done", "license": "cc0-1.0"}, {"source_id": "3", "license": "cc-by-nc", "status": "done"})
    kept = reports.exported(t)
    assert kept.count() == 2
    body = json.loads(reports.summary_json(kept, "s", 3, F.timestamp_millis(F.lit(0))).first().summary)
    assert (body["by_license"], body["by_format"], body["total_bytes"], body["total_duration_hours"], body["total_rows_in_store"]) == ({"cc-by": 1, "cc0-1.0": 1}, {"mp3": 1}, 5, 1.5, 3)
    sinks.write_attribution(kept, str(tmp_path / "a.txt"))
    text = (tmp_path / "a.txt").read_text()
    assert "== License: cc-by (1 tracks) ==\n- T — A\n  Album: Al\n  Source: s id=1\n  Origin: https://o\n  License: cc-by (https://deed)\n  URL: u\n" in text
    assert text.endswith("LICENSE TERMS\n=============\ncc-by: https://deed\ncc0-1.0: see source catalog\n") and "- (untitled) — (unknown artist)" in text
    assert sinks.write_manifest(kept, str(tmp_path / "m.jsonl.zst")) == 2
    import zstandard

    lines = zstandard.ZstdDecompressor().stream_reader((tmp_path / "m.jsonl.zst").open("rb")).read().splitlines()
    assert json.loads(lines[0])["title"] == "T" and json.loads(lines[1])["title"] is None
    job = "0a0a0a0a-0000-4000-8000-000000000000"
    pages = spark.createDataFrame([("d", job, "u,1", 0, None, None, 'a "b"', "en", None, None, 1)], "domain string, job_id string, url string, http_status int, content_length long, content_hash string, title string, language string, content_ref string, crawled_at timestamp, crawl_duration_ms int")
    path = sinks.export_pages(reports.pages_of_domain(pages, "d", job), str(tmp_path / "p"), "CSV")
    assert open(path).read().splitlines()[1] == f'"d",{job},"u,1",0,0,"","a ""b""","en","",""'
    assert json.load(open(sinks.export_pages(reports.pages_of_domain(pages, "d"), str(tmp_path / "q.json"), "json")))[0]["title"] == 'a "b"'


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_exports_of_many_parts_are_those_of_one(spark, tmp_path, monkeypatch, rows):
    import zstandard

    monkeypatch.setattr(sinks, "PART_ROWS", rows)
    t = tracks(spark, *[{"source": f"s{i % 2}", "source_id": f"{i:03d}", "status": "done", "license": ("cc-by", "cc0-1.0")[i % 3 == 0], "title": f"T{i}\u00e9"} for i in range(40)])
    assert sinks.write_manifest(t, str(tmp_path / "m.zst")) == 40
    with (tmp_path / "m.zst").open("rb") as f:
        lines = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read().decode().splitlines()
    assert lines == [r.j for r in t.orderBy("source", "source_id").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()]
    sinks.write_attribution(t, str(tmp_path / "a.txt"))
    plain = "".join(r.line + "\n" for r in reports.attribution_lines(t).orderBy("section", "license", "rank").collect())
    assert (tmp_path / "a.txt").read_text() == plain
    pages = t.selectExpr("source AS domain", "source_id AS job_id", "title AS url", "0 AS http_status", "bigint(1) AS content_length", "'h' AS content_hash", "'a, b' AS title", "'en' AS language", "string(null) AS content_ref", "timestamp_millis(0) AS crawled_at", "1 AS crawl_duration_ms")
    whole = json.load(open(sinks.export_pages(pages, str(tmp_path / "p"), "json")))
    assert [(p["domain"], p["job_id"]) for p in whole] == sorted((p["domain"], p["job_id"]) for p in whole) and len(whole) == 40
    csv = open(sinks.export_pages(pages, str(tmp_path / "p"), "csv")).read().splitlines()
    assert len(csv) == 41 and csv[1:] == [r.line for r in reports.page_csv_lines(pages.orderBy("domain", "job_id", "url")).collect()]
    assert json.load(open(sinks.export_pages(pages.limit(0), str(tmp_path / "e"), "json"))) == [] and not list(tmp_path.glob("*parts*"))


def test_versions(spark, tmp_path):
    table = str(tmp_path / "t")
    assert sinks.read_table(spark, table) is None
    sinks.publish(spark.range(3), table)
    sinks.publish(sinks.read_table(spark, table).union(spark.range(2)), table)
    assert sinks.read_table(spark, table).count() == 5
    pages = spark.createDataFrame([("d", bytearray(b"x")), ("d", bytearray(b"x")), ("e", bytearray(b"x"))], "domain string, body binary")
    assert sinks.page_artifacts(pages, "/c").count() == 2


def test_catalogs(spark, tmp_path):
    (tmp_path / "t.csv").write_text(",album,album,track,track,artist,track,track\nx,y\ntrack_id,title,artist,title,duration,name,bit_rate,license\n2,Al,AA,T1,100,N1,256000,Creative Commons Attribution\nbad,,,,,,,\n5,Al,AA,T2,x,,320999,Public Domain\n".replace("x,y\n", ""))
    rows = catalogs.two_header_csv(spark, str(tmp_path / "t.csv")).orderBy("track_id").collect()
    assert [tuple(r) for r in rows] == [(2, "Al", "T1", "N1", 100.0, 256, "Creative Commons Attribution"), (5, "Al", "T2", "AA", None, 320, "Public Domain")]
    fma = catalogs.fma_rows(catalogs.two_header_csv(spark, str(tmp_path / "t.csv")), "https://m").orderBy("source_id").collect()
    assert [(r.url, r.license) for r in fma] == [("https://m/fma_small.zip!000/000002.mp3", "cc-by"), ("https://m/fma_small.zip!000/000005.mp3", "cc0-1.0")]
    items = spark.createDataFrame([("it", None, "https://creativecommons.org/licenses/by/4.0/", None), ("no", "t", None, None)], "identifier string, title string, licenseurl string, rights string")
    files = spark.createDataFrame([("it", [("a.flac", "Flac"), ("a.mp3", "VBR MP3"), ("a.ogg", "Ogg Vorbis"), ("b.txt", "Text"), ("b c.ogg", "Ogg Vorbis")])], "identifier string, files array<struct<name:string,format:string>>")
    got = catalogs.archive_rows(items, files).orderBy("source_id").collect()
    assert [(r.source_id, r.url, r.title) for r in got] == [("it|a.mp3", "https://archive.org/download/it/a.mp3", "a"), ("it|b c.ogg", "https://archive.org/download/it/b%20c.ogg", "b c")]
    jobs, recs = manifest.catalog_rows(catalogs.archive_rows(items, files), "j")
    assert jobs.count() == 2 and recs.first().status == "pending"
    for k, page in enumerate([[{"id": "7", "name": " ", "license_ccurl": "http://c/licenses/by-nd/3.0/", "audiodownload": "x", "audiodownload_allowed": True, "shareurl": "s"}, {"id": "8", "audiodownload": "", "audiodownload_allowed": True}], [], [], [], [{"id": "9", "license_ccurl": "http://c/licenses/by/3.0/", "audiodownload": "x", "audiodownload_allowed": True}]]):
        (tmp_path / "j").mkdir(exist_ok=True)
        (tmp_path / "j" / f"p{k}.json").write_text(json.dumps({"headers": {"status": "success"}, "results": page}))
    got = catalogs.jamendo_items(catalogs.jamendo_pages(spark, str(tmp_path / "j"))).collect()
    assert [(r.source_id, r.license, r.title, r.url) for r in got] == [("7", "cc-by-nd", None, "https://prod-1.storage.jamendo.com/download/track/7/mp32/")]
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a/b.csv", "hello")
    assert bytes(catalogs.zip_members(spark, str(tmp_path / "z.zip"), "a/b.csv").first().content) == b"hello"


def test_tables(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# no\n\n https://a.com \n")
    assert [r.url for r in tables.seeds(spark, ["x"], str(tmp_path / "s.txt"), ["", "#y"]).collect()] == ["x", "https://a.com", "#y"]
    rows = spark.createDataFrame([("1", '{"id":"1","name":"n","max_depth":2}'), ("2", "broken")], "job_id string, config string")
    got = tables.decoded_jobs(rows).collect()
    assert [(r.id, r.status, r.default_license, r.max_depth) for r in got] == [("1", "Pending", None, 2)] and tables.job_by_id(rows, "2").count() == 0
    assert tables.decoded_jobs(tables.encoded_jobs(tables.decoded_jobs(rows))).count() == 1
    bloom = dedup.Bloom(1000, 0.01).mark(spark.range(1000).select(F.col("id").cast("string").alias("u")), "u")
    assert all(bloom.probably_seen(str(i)) for i in range(1000)) and sum(bloom.probably_seen(f"n{i}") for i in range(200)) <= 8 and bloom.count == 1000


def test_metrics_and_schedule(spark):
    s = spark.createDataFrame([(0, "c", 1.0), (60, "c", 4.0), (120, "c", 2.0)], "t long, metric string, value double").select(F.timestamp_seconds("t").alias("ts"), "metric", F.lit("w").alias("component"), F.lit(None).cast("double").alias("le"), "value")
    assert [r.increase for r in metrics.increases(s).orderBy("ts").collect()] == [0.0, 3.0, 2.0]
    h = metrics.histogram(spark.createDataFrame([(5.0,), (15.0,), (1e9,)], "v double"), "v", [10.0, 20.0]).orderBy("le").collect()
    assert [(r.le, r.n) for r in h] == [(10.0, 1), (20.0, 2), (float("inf"), 3)]
    b = spark.createDataFrame([("x", 10.0, 1), ("x", 20.0, 3), ("x", float("inf"), 4)], "k string, le double, n long")
    assert [metrics.histogram_quantile(b, q, ["k"]).first().quantile for q in (0.25, 0.5, 0.99)] == [10.0, 15.0, 20.0]
    fired = metrics.held_above(s, 0.5, 120).orderBy("ts").collect()
    assert [r.firing for r in fired] == [False, False, True]
    up = spark.createDataFrame([("a",), ("b",)], "component string")
    alive = s.select("ts", F.lit("a").alias("component"), F.lit(1.0).alias("value"))
    assert [r.component for r in metrics.absent(alive, up, F.timestamp_seconds(F.lit(130)), 120).collect()] == ["b"]
    rows = [("d", 0, 0, None), ("d", 1, 0, 100), ("d", 2, 0, 50), ("d", 3, 5000, None), ("d", 4, 5000, 0)]
    df = spark.createDataFrame(rows, "domain string, seq long, arrival_ms long, delay_ms long")
    assert [r.scheduled_ms for r in schedule.scheduled(df, 250).orderBy("seq").collect()] == [0.0, 100.0, 200.0, 5000.0, 5100.0]
    cache = spark.createDataFrame([("https://a.com", "Success", 7, "b", 1000), ("https://b.com", "Denied", 7, "b", 1000), ("https://c.com", "Absent", 7, "b", 0)], "origin string, status string, crawl_delay_ms long, body string, fetched_at_ms long")
    t = spark.createDataFrame([("https://a.com/x",), ("https://b.com/x",), ("https://c.com/x",)], "url string")
    assert [r.crawl_delay_ms for r in schedule.with_robots(t, cache, F.lit(4_000_000)).orderBy("url").collect()] == [7, None, None]


def test_delays_of_a_domain_with_most_requests(spark):
    import random

    from corpusloom.operators import scans

    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.95 else rng.choice("ab"), k * 11, rng.randrange(40_000), rng.choice([None, None, 0, 0.5, 20, 300])) for k in range(1500)]
    df = spark.createDataFrame([(d, s, float(a), None if x is None else float(x)) for d, s, a, x in rows], "domain string, seq long, arrival_ms double, delay_ms double")
    last, longest, expected = {}, {}, []
    for domain, _, arrival, delay in rows:
        if delay is not None:
            longest[domain] = max(longest.get(domain, delay), delay)
        worst = longest.get(domain)
        period = 250.0 if worst is None else 1000.0 if worst == 0 else max(1.0, worst)
        last[domain] = arrival if domain not in last else max(arrival, last[domain] + period)
        expected.append(float(last[domain]))
    got = schedule.scheduled(df, 250, ranges=12).orderBy("seq").collect()
    assert [r.scheduled_ms for r in got] == expected
    spread = df.groupBy("domain", scans.place(df, "seq", 12).alias("at")).count()
    assert spread.agg(F.max("count")).first()[0] <= 2 * 1500 / 12  # the most that one window sorts
    files = df.select("domain", "seq", F.lit(3).alias("size"), F.lit("x").alias("_total"))
    fits = reports.within_disk_budget(files.drop("_total"), "domain", "seq", "size", 300)
    assert fits.filter("fits and domain = 'hot'").count() == 100


def test_ranks_of_one_large_group(spark):
    from corpusloom.operators import scans

    rows = spark.range(500).selectExpr("if(id % 50 = 0, null, 'g') AS g", "string(id * 7919 % 500) AS a", "id AS b")
    got = {r.b: r.n for r in scans.ranked(rows, ["g"], ["a", "b"], "n", ranges=6).collect()}
    for group in (None, "g"):
        own = sorted((r.a, r.b) for r in rows.collect() if r.g == group)
        assert [got[b] for _, b in own] == list(range(1, len(own) + 1))
