"""SQL names for the functions that built-in SQL lacks, and a table function of links."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import feeds, html, media, urls

FUNCTIONS = {
    "normalize_url": urls.normalize_url_col,
    "root_domain": urls.root_domain_col,
    "url_host": urls.host_col,
    "is_safe_egress_url": urls.is_safe_egress_col,
    "url_parts": urls.url_parts,
    "resolve_url": urls.resolve_col,
    "redirect_refusal": urls.hop_reason_col,
    "extract_page": html.extract_page,
    "decode_page": html.decode_page_col,
    "parse_sitemap": feeds.sitemap_col,
    "harvest_feed": feeds.feed_col,
    "parse_robots": feeds.robots_col,
    "verify_media": media.verify_col,
    "media_extension": media.final_extension_col,
    "probe_wav": media.wav_probe_col,
}


@F.udtf(returnType="position int, url string")
class ExtractLinks:
    """extract_links(html, base): one row per link in document order."""

    def eval(self, page: str, base: str) -> Iterator[tuple[int, str]]:
        found = html.extract(page, base)
        yield from enumerate(found["links"] if found else [])


def register(spark: SparkSession) -> None:
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    spark.udtf.register("extract_links", ExtractLinks)
