import pytest
from pyspark.sql import functions as F

from corpusloom.functions import media, text


def values(spark, data, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*cols).collect()]


def test_licenses(spark):
    rows = [("https://creativecommons.org/licenses/by-nc-sa/3.0/", None), ("https://creativecommons.org/publicdomain/mark/1.0/", None), ("http://creativecommons.org/publicdomain/zero/1.0/", None), (None, " public domain in the USA "), ("https://x.org/", "none")]
    got = values(spark, rows, "u string, r string", text.license_from_url_and_rights(F.col("u"), F.col("r")), text.license_from_cc_url(F.col("u")))
    assert got == [("cc-by-nc-sa", "cc-by-nc-sa"), ("pd-mark", None), ("cc0-1.0", None), ("pd-us", None), (None, None)]
    titles = [("Creative Commons Attribution-NonCommercial-ShareAlike 3.0",), ("Creative Commons Attribution-NoDerivs",), ("Public Domain Mark",), ("Creative Commons CC0",), ("FMA-limited",)]
    assert [r[0] for r in values(spark, titles, "t string", text.license_from_title(F.col("t")))] == ["cc-by-nc-sa", "cc-by-nd", "cc0-1.0", "cc0-1.0", None]


def test_export_filter(spark):
    got = values(spark, [("done", "cc-by"), ("pending", "cc-by"), ("done", "cc-by-nc")], "s string, l string", *[text.track_exported(F.col("s"), F.col("l"), a, b) for a in (False, True) for b in (False, True)])
    assert got == [(True, True, True, True), (False, False, True, True), (False, True, False, True)]


def test_paths_and_sizes(spark):
    rows = [("a/b\\c", "a_b_c"), ("con", "_con"), ("NUL.mp3", "_NUL.mp3"), ("trail... ", "trail"), ("", "_"), ("x" * 500, "x" * 200)]
    assert [r[0] for r in values(spark, [r[:1] for r in rows], "s string", text.sanitize_path_segment(F.col("s")))] == [r[1] for r in rows]
    sizes = [("5GB", 5 << 30), ("10 mb", 10 << 20), ("7kb", 7168), ("12", 12), ("1.5GB", None), ("x", None)]
    assert [r[0] for r in values(spark, [r[:1] for r in sizes], "s string", text.parse_size(F.col("s")))] == [r[1] for r in sizes]
    assert values(spark, [('he said "hi", ok', None)], "a string, b string", text.csv_field(F.col("a")), text.csv_field(F.col("b"))) == [('"he said ""hi"", ok"', '""')]
    s = "créature-créature-créature"
    got = values(spark, [(s,)], "s string", text.truncate_bytes(F.col("s"), 14), text.truncate_bytes(F.col("s"), 18), text.truncate_bytes(F.lit("short"), 14))[0]

    def reference(t, n):
        if len(t.encode()) <= n:
            return t
        starts = [len(t[:i].encode()) for i in range(len(t))]
        return t[: max(i for i, b in enumerate(starts) if b < n)] + "…"

    assert got == (reference(s, 14), reference(s, 18), "short")
    assert values(spark, [(1704067200000,)], "m long", text.format_epoch_ms(F.col("m")), text.format_listing_time(F.col("m"))) == [("2024-01-01 00:00:00 UTC", "2024-01-01 00:00")]
    assert values(spark, [("a" * 64,)], "h string", text.object_path(F.lit("s/x"), F.lit(None).cast("string"), F.col("h"), F.lit("mp3"))) == [("s_x/misc/aa/" + "a" * 64 + ".mp3",)]


def test_predicates(spark):
    got = values(spark, [("Text/HTML; charset=x", "application/xhtml+xml", "application/ogg", 503, 404)], "a string, b string, c string, d int, e int", text.is_html_content_type(F.col("a")), text.is_html_content_type(F.col("b")), text.looks_like_xml(F.col("b")), text.is_audio_mime(F.col("c")), text.is_retryable_status(F.col("d")), text.is_retryable_status(F.col("e")), text.is_acceptable_content_type(F.col("a"), []), text.is_acceptable_content_type(F.col("a"), ["text/html"]), text.looks_like_syndication(F.lit("application/atom")))
    assert got == [(True, False, True, True, True, False, True, True, True)]
    near, far = "x" * 1900 + "key", "x" * 2100 + "key"
    kw = F.array(F.lit(" KEY "), F.lit(" "))
    assert values(spark, [(near,), (far,)], "t string", text.topic_relevant(F.lit("title"), F.col("t"), kw), text.topic_relevant(F.lit(None).cast("string"), F.col("t"), F.array().cast("array<string>"))) == [(True, True), (False, True)]
    assert [r[0] for r in values(spark, [(s,) for s in (200, 204, 401, 403, 404, 500, 429)], "s int", text.robots_class(F.col("s")))] == ["Success", "Success", "Denied", "Denied", "Absent", "Absent", "Absent"]
    assert [r[0] for r in values(spark, [(200.0, 192), (5.0, 192), (5000.0, 192), (200.0, 48), (200.0, None)], "d double, b int", text.audio_quality(F.col("d"), F.col("b")))] == [None, "duration 5.0s below minimum", "duration 5000.0s above maximum", "bitrate 48kbps below minimum", None]
    assert [r[0] for r in values(spark, [("2.5",), ("-1",), ("x",), ("0",)], "s string", text.parse_delay_ms(F.col("s")))] == [2500, None, None, 0]
    assert values(spark, [(1,)], "x int", text.effective_crawl_delay(F.lit(None).cast("long"), F.lit(7).cast("long"), 9), text.clamp_delay(F.lit(9000), 5000), text.quota_wait_secs(F.lit(2)), text.retry_backoff_ms(F.lit(500), F.lit(3)), text.normalize_domain_token(F.lit(' "a.com" ')), text.param_value(F.lit('text/html; charset="utf-8"; x=1'), "charset"), text.user_agent("bot", "1", F.lit("me"))) == [(7, 5000, 120, 1500, "a.com", "utf-8", "bot/1 (+me)")]
    assert values(spark, [("HttpError", 404), ("Success", None), ("Timeout", None), ("ChecksumMismatch", None)], "k string, c int", text.status_code(F.col("k"), F.col("c"))) == [(404,), (0,), (-5,), (-8,)]


def head(brand):
    return b"\x00\x00\x00\x18ftyp" + brand + b"\x00" * 16


@pytest.mark.parametrize("kind, source, data, expected", [("AudioFile", "x-archive", b"PK\x03\x04" + b"\x00" * 40, (True, "zip")), ("AudioFile", "x", b"PK\x03\x04" + b"\x00" * 40, (False, "magic bytes say application/zip, expected AudioFile")), ("VideoFile", "x", head(b"isom"), (True, "mp4")), ("VideoFile", "x", head(b"qt  "), (True, "mov")), ("DocumentFile", "x", b"plain prose here", (True, "txt")), ("DocumentFile", "x", b"\x00" * 32, (False, "unrecognized magic bytes")), ("DocumentFile", "x", bytes(range(256)), (False, "unrecognized magic bytes")), ("AudioFile", "x", b"text", (False, "unrecognized magic bytes")), ("BinaryFile", "x", b"??", (True, "bin")), ("AudioFile", "x", b"OggS" + b"\x00" * 24 + b"OpusHead", (True, "ogg"))])
def test_magic(kind, source, data, expected):
    assert media.verify(kind, source, data) == expected


def test_media_columns(spark):
    assert media.final_extension("AudioFile", "u", head(b"isom")) == "m4a" and media.final_extension("VideoFile", "u", head(b"isom")) == "mp4" and media.final_extension("Page", "https://a/b.XYZ?q", b"??") == "xyz"
    got = values(spark, [("bytes 100-199/200",), ("bytes */200",), (None,), ("bytes x-1",)], "h string", media.content_range_start(F.col("h")))
    assert [r[0] for r in got] == [100, None, None, None]
    bodies = [b"hello world", b"", b"\xff\xfe", b"a\x00b", "ééééé".encode(), b"x" * 90 + "é".encode() * 5, bytes(range(1, 20))]
    got = values(spark, [(b,) for b in bodies], "b binary", media.text_sniff(F.col("b")))
    assert [r[0] for r in got] == [media.looks_like_text(b) for b in bodies]
    import io
    import wave

    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000), w.writeframes(b"\x00\x00" * 8000 * 35)
    got = values(spark, [(f.getvalue(),), (b"no",)], "b binary", media.wav_probe_col(F.col("b")).duration_secs, media.verify_col(F.lit("AudioFile"), F.lit("x"), F.col("b")).extension)
    assert got == [(35.0, "wav"), (None, None)]
