import ipaddress

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import psl, urls


@pytest.mark.parametrize("url, expected", [("http://example.com", "example.com"), ("https://www.example.com", "example.com"), ("http://blog.example.co.uk", "example.co.uk"), ("http://127.0.0.1/x", "127.0.0.1"), ("http://[2606:4700::1111]/", "2606:4700::1111"), ("http://x.github.io", "x.github.io"), ("http://com/", "com"), ("nonsense", None), (None, None)])
def test_root_domain(url, expected):
    assert urls.root_domain(url) == expected


@pytest.mark.parametrize("url, expected", [("example.com/path/", "https://example.com/path"), ("https://example.com/path#section", "https://example.com/path"), ("http://127.0.0.1/", None), ("example.com/search?q=rust#top", "https://example.com/search?q=rust"), ("HTTP://EXAMPLE.com:80/a/../b", "http://example.com/b"), ("https://example.com", "https://example.com"), ("https://a.com/b//", "https://a.com/b/"), ("https://example.com/é x", "https://example.com/%C3%A9%20x"), ("ftp://example.com/x", None), ("", None), (None, None)])
def test_normalize(url, expected):
    assert urls.normalize_url(url) == expected


BAD = ["127.0.0.1", "169.254.169.254", "192.168.1.1", "0.1.2.3", "100.64.0.1", "100.127.255.255", "198.18.0.1", "198.19.255.255", "192.0.2.1", "198.51.100.7", "203.0.113.99", "240.0.0.1", "255.255.255.255", "[::ffff:127.0.0.1]", "[::ffff:10.0.0.1]", "[fc00::1]", "[fd12:3456::1]", "[fe80::1]", "[::1]", "[64:ff9b::10.0.0.1]", "localhost:8000", "localhost.", "foo.internal.", "box.lan.:8080", "example.com:22", "0x7f.1", "2130706433"]
GOOD = ["100.63.0.1", "100.128.0.1", "198.17.0.1", "198.20.0.1", "192.0.3.1", "198.51.101.1", "203.0.114.1", "[2606:4700::1111]", "[64:ff9b::1.2.3.4]", "example.com.", "example.com:8443"]


@pytest.mark.parametrize("host", BAD)
def test_guard_rejects(host):
    assert not urls.is_safe_egress_url(f"http://{host}/")


@pytest.mark.parametrize("host", GOOD)
def test_guard_accepts(host):
    assert urls.is_safe_egress_url(f"https://{host}/")


def test_guard_schemes():
    assert not urls.is_safe_egress_url("file:///etc/passwd") and not urls.is_safe_egress_url("gopher://x.com/")


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(urls.BLOCKED_V4).flatmap(lambda n: st.integers(int(n.network_address), int(n.broadcast_address))))
def test_every_blocked_address(value):
    assert not urls.is_safe_egress_url(f"http://{ipaddress.IPv4Address(value)}/")


@settings(max_examples=200, deadline=None)
@given(st.text("abc/.?=&%é#", max_size=20))
def test_normalize_settles(tail):
    once = urls.normalize_url("https://example.com/" + tail)
    while once is not None and once.endswith("/"):
        once = urls.normalize_url(once)
    assert once is None or urls.normalize_url(once) == once


@pytest.mark.parametrize("previous, url, most, expected", [(0, "http://127.0.0.1/", 5, urls.HOP_BLOCKED), (0, "file:///x", 5, urls.NON_HTTP_REDIRECT), (5, "https://example.com/", 5, None), (6, "https://example.com/", 5, urls.TOO_MANY_REDIRECTS), (1, "https://example.com/", 0, urls.TOO_MANY_REDIRECTS)])
def test_hops(previous, url, most, expected):
    assert urls.hop_reason(previous, url, most) == expected


@pytest.mark.parametrize("base, href, expected", [("https://a.com/x/y", "../z?q=1#f", "https://a.com/z?q=1"), ("https://a.com/x/y", "//b.com", "https://b.com/"), ("https://a.com/x/", "mailto:a@b.c", "mailto:a@b.c"), ("https://a.com/x", "?p=2", "https://a.com/x?p=2"), ("https://a.com/x", "", "https://a.com/x"), ("nope", "x", None)])
def test_resolve(base, href, expected):
    assert urls.resolve(base, href) == expected


def test_registrable_rules():
    known = frozenset(["com", "co.uk", "uk", "*.ck", "!www.ck"])
    assert [psl.registrable(h, known) for h in ("a.b.co.uk", "x.y.ck", "a.x.y.ck", "www.ck", "co.uk", "b.com")] == ["b.co.uk", "x.y.ck", "x.y.ck", "www.ck", None, "b.com"]


def test_columns(spark):
    rows = [("song.mp3?token=1", "AudioFile"), ("SONG.MP3", "AudioFile"), ("clip.mp4?token=1", "VideoFile"), ("CLIP.WEBM", "VideoFile"), ("vid.mkv", "VideoFile"), ("thesis.pdf", "DocumentFile"), ("book.epub#page=2", "DocumentFile"), ("no-extension", "Page"), ("page.html", "Page"), ("https://foo.mov", "VideoFile"), (".mp3", "AudioFile")]
    df = spark.createDataFrame(rows, "u string, kind string")
    assert [r.k for r in df.select(urls.task_kind(F.col("u")).alias("k")).collect()] == [k for _, k in rows]
    links = ["https://a.com/feed", "https://a.com/news.rss", "https://a.com/s1.xml", "https://a.com/s1.xml", "https://a.com/s2.xml", "https://a.com/s3.xml", "https://a.com/s4.xml", "https://a.com/about", "https://a.com/anatomy"]
    got = spark.createDataFrame([(links,)], "l array<string>").select(urls.discovery_candidates(F.col("l")).alias("c")).first().c
    assert got.sitemaps == [f"https://a.com/s{i}.xml" for i in (1, 2, 3)] and got.feeds == ["https://a.com/feed", "https://a.com/news.rss", "https://a.com/anatomy"]
    one = spark.createDataFrame([("https://x/a.mp3", 'TAMBURAŠKI ZBOR "ŠOKADIJA".mp3', 123456, "bot/1.0 (x)")], "u string, s string, n long, ua string")
    got = one.select(urls.stable_id(F.col("u")), urls.encode_segment(F.col("s")), urls.subset_path(F.col("n")), urls.product_token(F.col("ua")), urls.url_parts(F.lit("http://Blog.Example.co.uk/x/#a")).root, urls.quick_host(F.lit("https://Me@EXAMPLE.com:80/x")), urls.has_feed_audio_extension(F.lit("https://a/b.wma?x"))).first()
    assert list(got) == ["6123c8f6fd9b68cd", "TAMBURA%C5%A0KI%20ZBOR%20%22%C5%A0OKADIJA%22.mp3", "123/123456.mp3", "bot", "example.co.uk", "example.com", True]
    v4 = [h for h in BAD + GOOD if h.replace(".", "").isdigit() and h.count(".") == 3]
    df = spark.createDataFrame([(h,) for h in v4], "h string")
    assert all(r.s == urls.is_safe_egress_url(f"http://{r.h}/") for r in df.select("h", urls.safe_ipv4(F.col("h")).alias("s")).collect())


def test_guard_parses_unusual_urls_alone(spark, monkeypatch):
    hosts = [*BAD, *GOOD, "1.2.3.256", "010.0.0.1", "1.2.3", "127.1", "0x7f.1", "8.8.8.8:99", "8.8.8.8:8080", "10.0.0.1:80", "u@10.0.0.1", "8.8.8.8@10.0.0.1", "8.8.8.8.", "local", "a.local", "a.local.", "LOCALHOST", "localhost:443", "a-b.c.internal", "a..b", "ex%61mple.com", "a_b.com", "\u00e9.com", "x.1e", "10.example.com", "192.168.0.a", "10.1.2.3.com", "1.localhost", "xlocalhost", "lan", "alan", "0x7f.lan", "240.0.0.1", "239.1.1.1"]
    made = [f"{scheme}{h}{tail}" for h in hosts for scheme in ("http://", "https://", "HTTP://", "ftp://", "http:/") for tail in ("", "/", "?q", "#f", "\\x", "\n", "/a\tb@c")] + [None, "", "x"]
    df = spark.createDataFrame([(u,) for u in made], "u string")
    assert [r.s for r in df.select(urls.is_safe_egress(F.col("u")).alias("s")).collect()] == [urls.is_safe_egress_url(u) for u in made]

    @F.pandas_udf("boolean")
    def never(text: pd.Series) -> pd.Series:
        assert text.isna().all()
        return pd.Series([False] * len(text))

    monkeypatch.setattr(urls, "is_safe_egress_col", never)
    plain = spark.createDataFrame([(f"http://{h}/",) for h in ("1.2.3.4", "10.9.8.7", "example.com", "a.lan")], "u string")
    assert [r.s for r in plain.select(urls.is_safe_egress(F.col("u")).alias("s")).collect()] == [True, False, True, False]
