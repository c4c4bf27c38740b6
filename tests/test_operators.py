"""Tests of the operators that have no query of their own, or whose query has no SQL equivalent."""

import io
import struct
import wave

from pyspark.sql import functions as F

from corpusloom.functions import feeds, tags
from corpusloom.operators import admission, dedup
from corpusloom.plans.options import Admission
from corpusloom.plans.schemas import EDGE
from corpusloom.sources import sinks, tables
from corpusloom.streaming import crawl
from test_streaming import JOB, land

XML = "application/xml"


def index(*locs):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"


def urlset(*locs):
    return "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>"


def test_index_takes_eight_children_one_level_deep(spark):
    kind = "url string, content_type string, body string"
    children = [f"https://e.com/{k}.xml" for k in range(10)]
    maps = spark.createDataFrame([("https://e.com/index.xml", XML, index(*children)), ("https://e.com/own.xml", XML, urlset(*[f"https://e.com/o{k}" for k in range(9)])), ("https://e.com/page", "text/html", urlset("https://e.com/no"))], kind)
    bodies = [(c, XML, urlset(f"https://e.com/p{k}", f"https://e.com/q{k}")) for k, c in enumerate(children) if k not in (2, 3, 4)]
    bodies += [(children[2], XML, index("https://e.com/deeper.xml")), (children[3], XML, "<urlset><url></urlset>"), (children[4], "text/html", urlset("https://e.com/no"))]
    found = feeds.harvested_sitemaps(maps, spark.createDataFrame(bodies, kind), per_map=7)
    got = [r.link for r in found.filter("url like '%index.xml'").orderBy("place").collect()]
    assert got == [f"https://e.com/{x}{k}" for k in (0, 1, 5, 6, 7) for x in "pq"]
    assert [r.link for r in found.filter("url like '%own.xml'").orderBy("place").collect()] == [f"https://e.com/o{k}" for k in range(7)]
    assert found.filter("url like '%page'").count() == 0


def test_all_links_of_a_page_become_edges(spark):
    rows = [("https://e.com", "j", 1, ["a", "b"], ["c", "a"], ["s.mp3"], ["v.mp4", "b"], ["d.pdf"], None)]
    pages = spark.createDataFrame(rows, "url string, job_id string, depth int, links array<string>, discovered array<string>, audio array<string>, video array<string>, docs array<string>, enclosures array<string>")
    got = admission.page_edges(pages).orderBy("position").collect()
    assert [r.url for r in got] == ["a", "b", "c", "s.mp3", "v.mp4", "d.pdf"] and {(r.source_url, r.depth) for r in got} == {("https://e.com", 2)}
    assert [r.url for r in admission.page_edges(pages.select("url", "job_id", "depth", "links")).collect()] == ["a", "b"]


def test_bloom_prefilter(spark):
    urls = lambda a, b: spark.range(a, b).select(F.concat(F.lit("https://e.com/"), "id").alias("url"))
    for words in (1 << 20, 0):
        bloom = dedup.Bloom(2000, 0.001, words).mark(urls(0, 600), "url").mark(urls(600, 1000), "url")
        assert bloom.count == 1000 and bloom.small == (words > 0)
        parted = bloom.split(urls(0, 1200).union(spark.createDataFrame([(None,)], "url string")), "url")
        assert parted.count() == 1201 and parted.filter("maybe_seen").join(urls(0, 1000), "url", "left_semi").count() == 1000
        assert parted.filter("maybe_seen").count() <= 1005 and not parted.filter("url is null").first().maybe_seen
        assert bloom.unseen(urls(0, 1200), "url", urls(0, 1000)).count() == 200
    assert bloom.probably_seen("https://e.com/5") and not dedup.Bloom(10).probably_seen("x")
    both = {r.url: r.maybe_seen for r in bloom.split(urls(900, 1400), "url").collect()}
    assert all(bloom.probably_seen(u) == seen for u, seen in both.items())


def test_bloom_at_its_capacity_keeps_its_rate(spark):
    urls = lambda a, b: spark.range(a, b).select(F.concat(F.lit("https://e.com/"), "id").alias("url"))
    for fpp in (0.01, 0.001):
        bloom = dedup.Bloom(60_000, fpp).mark(urls(0, 60_000), "url")
        assert bloom.split(urls(0, 60_000), "url").filter("not maybe_seen").count() == 0
        wrong = bloom.split(urls(60_000, 260_000), "url").filter("maybe_seen").count()
        assert wrong <= 2 * fpp * 200_000


def test_bloom_probes_without_a_row_for_each_place(spark):
    urls = spark.range(5000).select(F.concat(F.lit("https://e.com/"), "id").alias("url"))
    for words, exchanges in ((1 << 20, 0), (0, 1)):
        bloom = dedup.Bloom(5000, 0.001, words).mark(urls, "url")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # what Spark would send by its own estimate of the size
        try:
            text = bloom.split(urls, "url")._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "Generate" not in text and "explode" not in text
        # one exchange of the rows and one of the blocks where the filter is too large to be broadcast
        assert ("BroadcastExchange" in text) == (words > 0) and text.count("Exchange hashpartitioning") == 2 * exchanges


def test_messages_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("https://e.com/1", None, "j", 1), ("https://e.com/2", "https://e.com", "j", 2)], EDGE)
    sinks.published(rows, str(tmp_path / "edges"))
    good, bad = crawl.edges(spark.read.text(str(tmp_path / "edges")))
    assert sorted(map(tuple, good.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect())) and bad.count() == 0


def test_objects_are_written_once(spark, tmp_path):
    root = str(tmp_path / "store")
    objects = spark.createDataFrame([("a/x.bin", bytearray(b"one")), ("a/x.bin", bytearray(b"one")), ("b/y.bin", bytearray(b"two!"))], "path string, content binary")
    first = sorted(map(tuple, sinks.store_objects(objects, root).collect()))
    assert first == [("a/x.bin", f"{root}/a/x.bin", 3, True), ("b/y.bin", f"{root}/b/y.bin", 4, True)]
    assert (tmp_path / "store/a/x.bin").read_bytes() == b"one" and not list((tmp_path / "store").rglob("*.part"))
    assert [r.written for r in sinks.store_objects(objects, root).collect()] == [False, False]
    there = {r.path: r.stored for r in sinks.stored_objects(spark.createDataFrame([("a/x.bin",), ("c",)], "path string"), root).collect()}
    assert there == {"a/x.bin": True, "c": False}


def test_domain_rows_and_quarantine(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", None), ("a", None, None), ("b", None, 5)], "domain string, robots_txt string, crawl_delay_ms long")
    assert tables.domain_metadata(rows, "a").count() == 1 and tables.domain_metadata(rows, "b").count() == 1
    sinks.quarantine(spark.createDataFrame([("u", "seen"), ("v", "dup")], "url string, reason string"), str(tmp_path / "q"))
    assert {r.reason for r in spark.read.parquet(str(tmp_path / "q")).collect()} == {"seen", "dup"}


def test_budgets_hold_over_batches(spark, tmp_path):
    jobs = spark.createDataFrame([("j", "Running", 9, 2, 1, [], [], [], True, None, []), ("k", "Running", 9, None, 2, [], [], [], True, None, [])], JOB)
    raw, out, ck = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "ck")
    edge = lambda url, job: {"url": url, "source_url": "https://s.com", "job_id": job, "depth": 1}
    batches = [[edge("https://a.com/1", "j")], [edge("https://a.com/2", "j"), edge("https://b.com/1", "j")], [edge("https://c.com/1", "j"), edge("https://a.com/3", "k")], [edge("https://a.com/4", "k")]]
    for messages in batches:
        land(raw, messages)
        crawl.admission_stream(spark.readStream.text(str(raw)), lambda: jobs, lambda: None, out, ck).awaitTermination()
    got = sorted(r.url for r in spark.read.parquet(f"{out}/tasks").collect())
    every = spark.createDataFrame([(e["url"], e["source_url"], e["job_id"], e["depth"], k) for k, e in enumerate(x for b in batches for x in b)], "url string, source_url string, job_id string, depth int, seq long")
    assert got == sorted(r.url for r in admission.tasks(admission.admit(every, jobs)).collect()) == ["https://a.com/1", "https://a.com/3", "https://b.com/1"]


def test_counts_are_added_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(crawl, "TOTALS", 2)
    out = str(tmp_path)
    for number in range(6):
        used = crawl._used(spark, out, number)
        have = {} if used is None else {(r.root, r.job_id): r.n for r in used.groupBy("root", "job_id").agg(F.sum("n").alias("n")).collect()}
        assert have == ({("a", "j"): number} if number else {})
        spark.createDataFrame([("a", "j", 1)], "root string, job_id string, n long").write.parquet(f"{out}/counts/batch={number}")


def test_one_job_budget_with_what_was_used(spark):
    rows = [(f"r{k % 3}", "j", k, 4, 7) for k in range(40)]
    passed = spark.createDataFrame(rows, "root string, job_id string, seq long, max_pages_per_domain long, max_pages long").withColumn("reason", F.lit(None).cast("string"))
    used = spark.createDataFrame([("r0", "j", 2), ("r9", "j", 1)], "root string, job_id string, n long")
    one, many = (f(passed, Admission(), used).orderBy("seq").collect() for f in (admission.one_job_budget, admission.greedy_budget))
    assert [r.reason for r in one] == [r.reason for r in many]
    assert sum(r.reason is None for r in one) == 4


def comments(*fields):
    body = struct.pack("<I", 4) + b"test" + struct.pack("<I", len(fields))
    return body + b"".join(struct.pack("<I", len(f.encode())) + f.encode() for f in fields)


def ogg_page(granule, *packets):
    sizes = b"".join(bytes([255] * (len(p) // 255) + [len(p) % 255]) for p in packets)
    return b"OggS\0\0" + struct.pack("<qIIIB", granule, 1, 0, 0, len(sizes)) + sizes + b"".join(packets)


def atom(name, data):
    return struct.pack(">I", len(data) + 8) + name + data


def id3(version, *frames):
    body = b""
    for name, text in frames:
        data = b"\x03" + text.encode()
        body += name + (bytes([0, 0, len(data) >> 7, len(data) & 127]) if version == 4 else struct.pack(">I", len(data))) + b"\0\0" + data
    return b"ID3" + bytes([version, 0, 0]) + bytes([0, 0, len(body) >> 7, len(body) & 127]) + body


def test_probe(spark):
    sound = io.BytesIO()
    with wave.open(sound, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(b"\0\0" * 8000 * 35)
    flac = b"fLaC" + b"\0" + (34).to_bytes(3, "big") + b"\0" * 10 + (44100 << 44 | 44100 * 10).to_bytes(8, "big") + b"\0" * 16
    note = comments("TITLE=Song", "artist=Band", "DATE=1999-05-01", "GENRE= ")
    flac += b"\x84" + len(note).to_bytes(3, "big") + note + b"\0" * 100_000
    vorbis = ogg_page(0, b"\x01vorbis" + struct.pack("<IBIiiiB", 0, 2, 48000, 0, 128000, 0, 0)) + ogg_page(0, b"\x03vorbis" + comments("Album=Disc")) + ogg_page(48000 * 3, b"x" * 300)
    opus = ogg_page(0, b"OpusHead\x01\x02" + struct.pack("<HIHB", 480, 48000, 0, 0)) + ogg_page(0, b"OpusTags" + comments("title=O")) + ogg_page(480 + 96000, b"y" * 10)
    item = lambda name, text: atom(name, atom(b"data", b"\0" * 8 + text.encode()))
    m4a = atom(b"ftyp", b"M4A \0\0\0\0") + atom(b"moov", atom(b"mvhd", b"\0" * 12 + struct.pack(">II", 1000, 20_000)) + atom(b"udta", atom(b"meta", b"\0" * 4 + atom(b"ilst", item(b"\xa9nam", "T") + item(b"\xa9day", "2001"))))) + atom(b"mdat", b"\0" * 320_000)
    frames = b"\xff\xfb\x90\x00" + b"\0" * 413
    mp3 = id3(4, (b"TIT2", "Té"), (b"TPE1", "A"), (b"TDRC", "2010-01")) + frames * 100
    xing = b"\xff\xfb\x90\x00" + b"\0" * 32 + b"Xing\0\0\0\x01" + struct.pack(">I", 1000) + b"\0" * 400
    bodies = {"wav": sound.getvalue(), "flac": flac, "vorbis": vorbis, "opus": opus, "m4a": m4a, "mp3": mp3, "old": id3(3, (b"TALB", "L"), (b"TYER", "1987")) + xing + frames * 9, "none": b"plain", "cut": flac[:20], "empty": b""}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in bodies.items()] + [("null", None)], "name string, body binary")
    got = {r.name: r.p.asDict() for r in rows.select("name", tags.probe_col("body").alias("p")).collect()}
    some = lambda name: {k: v for k, v in got[name].items() if v is not None}
    assert some("wav") == {"duration_secs": 35.0, "bitrate_kbps": 128}
    assert some("flac") == {"duration_secs": 10.0, "bitrate_kbps": 80, "title": "Song", "artist": "Band", "year": 1999}
    assert some("vorbis") == {"duration_secs": 3.0, "bitrate_kbps": 128, "album": "Disc"}
    assert some("opus") == {"duration_secs": 2.0, "bitrate_kbps": len(opus) * 8 // 2000, "title": "O"}
    assert some("m4a") == {"duration_secs": 20.0, "bitrate_kbps": 128, "title": "T", "year": 2001}
    assert some("mp3") == {"duration_secs": len(frames) * 100 / 16000, "bitrate_kbps": 128, "title": "Té", "artist": "A", "year": 2010}
    assert got["old"]["duration_secs"] == 1000 * 1152 / 44100 and got["old"]["album"] == "L" and got["old"]["year"] == 1987
    assert not some("none") and not some("empty") and not some("null")
