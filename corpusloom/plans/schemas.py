"""Row types of jobs, tasks, results, edges, tracks and metric samples."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(n, t) for n, t in fields])


S, I, L, D, B = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType()

JOB = _struct(("id", S), ("name", S), ("status", S), ("created_at", TimestampType()), ("seeds", ArrayType(S)), ("allowed_domains", ArrayType(S)), ("include_patterns", ArrayType(S)), ("exclude_patterns", ArrayType(S)), ("max_depth", I), ("max_pages", L), ("max_pages_per_domain", L), ("max_content_size", L), ("follow_external_links", B), ("respect_robots_txt", B), ("user_agent", S), ("custom_headers", MapType(S, S)), ("crawl_delay_ms", L), ("topic_keywords", ArrayType(S)), ("store_raw_html", B), ("store_text", B), ("default_license", S))
MEDIA = _struct(("source", S), ("source_id", S), ("title", S), ("artist", S), ("album", S), ("license", S), ("license_url", S), ("origin_page_url", S), ("discovered_from_url", S), ("collection", S))
PROBE = _struct(("duration_secs", D), ("bitrate_kbps", I), ("title", S), ("artist", S), ("album", S), ("genre", S), ("year", I), ("format", S), ("bytes", L))
TASK = _struct(("url", S), ("job_id", S), ("depth", I), ("priority", I), ("discovered_from", S), ("kind", S), ("media", MEDIA))
EDGE = _struct(("url", S), ("source_url", S), ("job_id", S), ("depth", I))
STATUS = _struct(("kind", S), ("http_code", I), ("message", S))
RESULT = _struct(("job_id", S), ("source_url", S), ("domain", S), ("title", S), ("language", S), ("content_hash", S), ("content_length", L), ("content_ref", S), ("status", STATUS), ("crawl_duration_ms", L), ("discovered_urls", ArrayType(EDGE)), ("media_meta", MEDIA), ("media_probe", PROBE))
TRACK = _struct(("source", S), ("source_id", S), ("job_id", S), ("url", S), ("title", S), ("artist", S), ("album", S), ("year", I), ("genre", S), ("license", S), ("license_url", S), ("origin_page_url", S), ("discovered_from_url", S), ("collection", S), ("duration_secs", D), ("bitrate_kbps", I), ("format", S), ("sha256", S), ("bytes", L), ("object_path", S), ("status", S), ("error", S))
PAGE = _struct(("domain", S), ("job_id", S), ("url", S), ("http_status", I), ("content_length", L), ("content_hash", S), ("title", S), ("language", S), ("content_ref", S), ("crawled_at", TimestampType()), ("crawl_duration_ms", L))
DOMAIN = _struct(("domain", S), ("robots_txt", S), ("robots_fetched_at", L), ("crawl_delay_ms", L), ("last_crawled_at", L))
FETCHED = _struct(("url", S), ("job_id", S), ("depth", I), ("content_type", S), ("http_status", I), ("body", BinaryType()), ("duration_ms", L))
SAMPLE = _struct(("ts", TimestampType()), ("component", S), ("metric", S), ("le", D), ("value", D))

#: Defaults of job fields that older documents lack.
JOB_DEFAULTS = {"status": "Pending", "max_depth": 3, "follow_external_links": False, "respect_robots_txt": True, "store_raw_html": False, "store_text": True}
