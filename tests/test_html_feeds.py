import tracemalloc

import pyarrow as pa

from corpusloom.functions import feeds, html


def test_page():
    page = '<html lang="en"><head><title>A &amp; B</title><meta name="description" content="d"><link rel="canonical" href="/c"></head><body><p> Hi <b>there</b></p><a href="/docs#x">d</a><a href="https://o.org/a.mp4">v</a><!-- no --></body></html>'
    got = html.extract(page, "https://example.com/a/b")
    assert (got["title"], got["lang"], got["description"], got["canonical"]) == ("A & B", "en", "d", "/c")
    assert got["text"] == "A & B Hi there d v" and got["links"] == ["https://example.com/docs", "https://o.org/a.mp4"] and got["video"] == ["https://o.org/a.mp4"]
    assert got["skeleton"] == "<html><head><title><meta><link><body><p><b><a><a>"
    assert html.extract("just text", None)["skeleton"] == "<html><head><body>" and html.extract(None, None) is None


def test_audio_links():
    page = '<a href="a.mp3">1</a><a href="/b.FLAC?x=1">2</a><a rel="enclosure" href="c">3</a><audio><source src="d.ogg"></audio><a href="a.mp3">again</a>'
    assert html.extract(page, "https://ex.com/music/")["audio"] == ["https://ex.com/music/a.mp3", "https://ex.com/b.FLAC?x=1", "https://ex.com/music/c", "https://ex.com/music/d.ogg"]


def test_charsets():
    assert html.decode_page("é".encode("latin-1") + b'<meta charset="iso-8859-1">', "text/html") == 'é<meta charset="iso-8859-1">'
    assert html.decode_page(b"\x93x\x94", "text/html; charset=windows-1252") == "“x”"
    assert html.decode_page(b"\xef\xbb\xbfhi", None) == "hi" and html.decode_page("é".encode(), "text/html; charset=nope") == "é" and html.decode_page(None, None) is None


def test_sitemaps():
    ok = feeds.parse_sitemap(b"<urlset><url><loc> https://a/1 </loc><lastmod>2024</lastmod></url><url><loc></loc></url><url><loc>https://a/2</loc></url></urlset>")
    assert ok == {"kind": "urlset", "entries": [{"loc": "https://a/1", "lastmod": "2024"}, {"loc": "https://a/2", "lastmod": None}], "children": [], "error": None}
    assert feeds.parse_sitemap(b"<sitemapindex><sitemap><loc>https://a/s.xml</loc></sitemap></sitemapindex>")["kind"] == "index"
    assert feeds.parse_sitemap(b"<x><url><loc>https://a/1</loc></url><sitemap><loc>https://a/s.xml</loc></sitemap></x>")["entries"] == []
    assert feeds.parse_sitemap(b"<urlset><url></urlset>")["error"] and feeds.parse_sitemap(b"<urlset><url><loc>https://a")["entries"] == []
    assert feeds.sitemap_urls("text/html", b"<urlset/>")["urls"] == [] and feeds.sitemap_urls("application/xml", b"x" * 11, max_body=10)["error"]
    many = b"<urlset>" + b"".join(b"<url><loc>https://a/%d</loc></url>" % i for i in range(50)) + b"</urlset>"
    assert len(feeds.sitemap_urls("text/xml", many, limit=7)["urls"]) == 7


def test_feeds():
    rss = b'<rss><channel><item><title>t</title><link>https://a/p</link><enclosure url="https://a/x.mp3" type="audio/mpeg"/><enclosure url="https://a/x.mp4" type="video/mp4"/><enclosure url="y.ogg"/></item></channel></rss>'
    assert feeds.harvest_feed("application/rss+xml", rss, "https://a/feed") == {"links": ["https://a/p"], "enclosures": ["https://a/x.mp3", "https://a/y.ogg"]}
    atom = b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>t</title><link href="https://a/p"/><link rel="self" href="https://a/s"/><link rel="enclosure" type="audio/ogg" href="/e"/></entry></feed>'
    assert feeds.harvest_feed("application/atom+xml", atom, "https://a/feed") == {"links": ["https://a/p"], "enclosures": ["https://a/e"]}
    assert feeds.parse_feed(rss, None)[0]["link"] == "https://a/p" and feeds.harvest_feed("text/html", rss, None)["links"] == []
    assert feeds.parse_feed(b'{"version": "https://jsonfeed.org/version/1", "items": [{"url": "https://a/j", "title": "x"}]}', None)[0]["link"] == "https://a/j"


def test_robots():
    body = b"User-agent: *\nCrawl-delay: 2\nSitemap: https://a/s.xml\nsitemap:  /t.xml \nUser-agent: Bot\nDisallow: /x\nCrawl-delay: 0.5 # half\n"
    assert feeds.crawl_delay(body, "bot") == 500 and feeds.crawl_delay(body, "other") == 2000
    assert feeds.robots_sitemaps(body, "https://a/robots.txt") == ["https://a/s.xml", "https://a/t.xml"]
    assert feeds.crawl_delay(b"Crawl-delay: 9\nUser-agent: a\nUser-agent: b\nCrawl-delay: 1", "b") == 1000 and feeds.crawl_delay(b"Crawl-delay: 9", "b") is None
    assert feeds.crawl_delay(b"User-agent: *\nCrawl-delay: 3\nUser-agent: bot\nDisallow: /", "bot") == 3000
    assert feeds.crawl_delay(b"User-agent: *\nCrawl-delay: 3\nUser-agent: *\nDisallow: /", "bot") is None and feeds.crawl_delay(b"\xff", "b") is None
    rules = b"User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$\n"
    assert [feeds.robots_allowed(rules, "bot", f"https://x.com{p}") for p in ("/", "/a/c", "/a/b/c", "/d.pdf", "/d.pdf?x")] == [True, False, True, False, True]


def test_extraction_holds_few_pages_at_once():
    page = "<html><head><title>t{0}</title></head><body>" + "<p>some words</p><a href='/x{0}'>link</a>" * 20 + "</body></html>"

    def peak(n):
        texts, bases = pa.array([None if k == 70 else page.format(k) for k in range(n)]), pa.array(["https://example.com/"] * n)
        tracemalloc.start()
        found = html.extract_page.func(texts, bases)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found.field("title").to_pylist() == [None if k == 70 else f"t{k}" for k in range(n)]
        return most

    peak(100)
    assert peak(1200) < 1.5 * peak(150)
