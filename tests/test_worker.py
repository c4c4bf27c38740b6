"""Fetched pages through the worker, result and admission streams."""

from pyspark.sql import functions as F

from corpusloom import cli
from corpusloom.plans.schemas import FETCHED, TASK
from corpusloom.sources import sinks, tables
from corpusloom.streaming import worker

HTML = "text/html; charset=utf-8"


def fetched(spark, *rows):
    return spark.createDataFrame([(u, "j", d, kind, status, bytearray(body.encode()) if body is not None else None, 7) for u, d, kind, status, body in rows], FETCHED)


def test_results_and_edges(spark):
    rows = fetched(
        spark,
        ("https://a.com/1", 0, HTML, 200, '<html lang=en><title>T</title><a href="/2">x</a><a href="/2">y</a><a href="s.mp3">z</a>'),
        ("https://a.com/3", 0, HTML, 404, "gone"),
        ("https://a.com/4", 0, "image/png", 200, "x"),
        ("https://a.com/5", 0, HTML, 200, "y" * 50),
        ("https://a.com/6", 0, HTML, 200, None),
        ("https://a.com/map.xml", 1, "text/xml", 200, "<urlset><url><loc>https://a.com/m1</loc></url></urlset>"),
        ("https://a.com/rss", 1, "application/rss+xml", 200, '<rss><channel><item><title>t</title><link>https://a.com/f1</link><enclosure url="e.ogg" type="audio/ogg"/></item></channel></rss>'),
    )
    got = {r.source_url: r for r in worker.results_of(rows, worker.Work(max_bytes=120)).collect()}
    assert {u.rsplit("/", 1)[1]: (r.status.kind, r.status.http_code) for u, r in got.items()} == {"1": ("Success", None), "3": ("HttpError", 404), "4": ("InvalidContentType", None), "5": ("Success", None), "6": ("Success", None)}
    one = got["https://a.com/1"]
    assert (one.title, one.language, one.domain, one.links, one.audio) == ("T", "en", "a.com", ["https://a.com/2", "https://a.com/2", "https://a.com/s.mp3"], ["https://a.com/s.mp3"])
    assert worker.results_of(rows, worker.Work(max_bytes=20)).filter("status.kind = 'ContentTooLarge'").count() == 2
    assert sorted(tuple(r) for r in worker.map_edges(rows).collect()) == [("https://a.com/map.xml", "j", 2, "https://a.com/m1"), ("https://a.com/rss", "j", 2, "https://a.com/e.ogg"), ("https://a.com/rss", "j", 2, "https://a.com/f1")]
    assert worker.results_of(rows.limit(0)).count() == 0 and worker.map_edges(rows.limit(0)).count() == 0


def test_ingest_from_the_command_line(spark, tmp_path, capsys):
    store = str(tmp_path / "store")
    cli.main(["--store", store, "crawl", "--urls", "https://a.com/1", "--label", "first", "--job", "j", "--max-pages", "4"])
    page = lambda *links: "<title>t</title>" + "".join(f'<a href="{x}">l</a>' for x in links)
    fetched(spark, ("https://a.com/1", 0, HTML, 200, page("/2", "/3", "/1", "https://b.com/x")), ("https://a.com/err", 0, HTML, 500, "")).write.parquet(f"{store}/fetched/a")
    run = lambda: (cli.main(["--store", store, "ingest", "--keep-pages"]), capsys.readouterr().out.strip().splitlines()[-1])[1]
    import shutil

    flat = tmp_path / "store" / "fetched"
    for f in (flat / "a").glob("*.parquet"):
        shutil.move(f, flat / f.name)
    shutil.rmtree(flat / "a")
    assert run() == "2"  # the job follows no external link, and page 1 is known
    assert run() == "2"
    more = fetched(spark, ("https://a.com/2", 1, HTML, 200, page("/3", "/4", "/5", "/6")))
    more.coalesce(1).write.parquet(str(tmp_path / "more"))
    for f in (tmp_path / "more").glob("*.parquet"):
        shutil.move(f, flat / f"z{f.name}")
    assert run() == "4"
    tasks = sorted(r.url for r in spark.read.parquet(f"{store}/admission/tasks").collect())
    assert tasks == ["https://a.com/2", "https://a.com/3", "https://a.com/4", "https://a.com/5"]
    reasons = {(r.url, r.reason) for r in spark.read.parquet(f"{store}/admission/rejected").collect()}
    assert {("https://a.com/1", "already_crawled"), ("https://b.com/x", "external_link"), ("https://a.com/3", "seen"), ("https://a.com/6", "job_cap")} <= reasons
    pages = sinks.read_table(spark, f"{store}/pages")
    assert {r.url: r.http_status for r in pages.collect()} == {"https://a.com/1": 0, "https://a.com/err": 500, "https://a.com/2": 0}
    stored = pages.filter(F.col("content_ref").isNotNull()).collect()
    assert len(stored) == 2 and all(open(r.content_ref.removeprefix("file://")).read().startswith("<title>") for r in stored)
    good, _ = tables.messages(spark, f"{store}/admission/messages/*", TASK)
    good.writeStream.format("memory").queryName("admitted").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("admitted").count() == 4
