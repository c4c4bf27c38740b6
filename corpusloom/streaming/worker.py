"""From fetched pages to results and edges: what follows a fetch, batch by batch, as messages for the result and admission streams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import feeds, html, text, urls
from ..operators.admission import page_edges
from ..plans.schemas import MEDIA, PROBE
from ..sources import sinks


@dataclass(frozen=True)
class Work:
    accepted: tuple[str, ...] = ("text/html", "application/xhtml+xml")
    max_bytes: int = 10 * 1024 * 1024
    #: Folder of stored pages; none: not stored.
    store: str | None = None


def fetch_status(work: Work) -> Column:
    """(kind, http_code, message) of a fetched page, over its columns."""
    status = F.col("http_status")
    kind = (
        F.when(~status.between(200, 299), "HttpError")
        .when(~F.coalesce(text.is_acceptable_content_type(F.col("content_type"), list(work.accepted)), F.lit(False)), "InvalidContentType")
        .when(~text.is_within_size_limit(F.octet_length("body"), work.max_bytes), "ContentTooLarge")
        .otherwise("Success")
    )
    return F.struct(kind.alias("kind"), F.when(kind == "HttpError", status).alias("http_code"), F.lit(None).cast("string").alias("message"))


def is_map(content_type: Column) -> Column:
    """Sitemaps and feeds are asked for their links and give no page."""
    return F.coalesce(text.looks_like_syndication(content_type) & ~F.lower(content_type).contains("html"), F.lit(False))


def results_of(fetched: DataFrame, work: Work = Work()) -> DataFrame:
    """Result rows of fetched pages (url, job_id, depth, content_type, http_status, body, duration_ms), with their lists of links; a page is parsed once."""
    rows = fetched.filter(~is_map(F.col("content_type"))).withColumn("status", fetch_status(work))
    good = F.col("status.kind") == "Success"
    page = html.extract_page(F.when(good, html.decode_page_col("body", "content_type")), F.col("url"))
    parsed = rows.withColumn("p", page).withColumn("domain", F.coalesce(urls.root_domain_col("url"), F.lit("unknown")))
    return parsed.select(
        "job_id", F.col("url").alias("source_url"), "depth", "domain", "p.title", F.col("p.lang").alias("language"), F.when(good, F.sha2("body", 256)).alias("content_hash"), F.when(good, F.octet_length("body").cast("long")).alias("content_length"),
        "status", F.col("duration_ms").alias("crawl_duration_ms"), F.when(good, F.col("body")).alias("body"), "p.links", "p.audio", "p.video", "p.docs",
    )


def map_edges(fetched: DataFrame) -> DataFrame:
    """Edges of fetched sitemaps and feeds: page links, and the feeds' audio; a sitemap index gives the links of its children that were fetched with it."""
    maps = fetched.filter(is_map(F.col("content_type")) & F.col("http_status").between(200, 299))
    about = maps.select(F.col("url").alias("source_url"), "job_id", (F.col("depth") + 1).alias("depth"))
    harvested = feeds.harvested_sitemaps(maps, maps).select(F.col("url").alias("source_url"), F.col("link").alias("url"))
    feed = maps.withColumn("f", feeds.feed_col("content_type", "body", "url"))
    entries = feed.select(F.col("url").alias("source_url"), F.explode(F.concat("f.links", "f.enclosures")).alias("url"))
    return harvested.union(entries).distinct().join(about.dropDuplicates(["source_url", "job_id"]), "source_url").select("source_url", "job_id", "depth", "url")


def page_stream(fetched: DataFrame, out: str, checkpoint: str, work: Work = Work()) -> StreamingQuery:
    """Fetched pages become results (`out`/results), edges (`out`/edges) and, if wanted, stored objects.

    Messages are written under the batch's number, and a replay overwrites them; what reads them takes a repeated message once. Objects are written once by their hash.
    """

    def run(batch: DataFrame, number: int) -> None:
        results = results_of(batch, work).persist()
        try:
            ref = F.lit(None).cast("string")
            if work.store:
                pages = results.filter("body is not null").select("domain", "body")
                sinks.store_objects(sinks.page_artifacts(pages, "").select(F.ltrim(F.col("path"), F.lit("/")).alias("path"), "content"), work.store).write.format("noop").mode("overwrite").save()
                ref = F.when(F.col("content_hash").isNotNull(), F.concat(F.lit(sinks.qualified(batch.sparkSession, work.store) + "/"), F.ltrim(text.page_artifact_path("", F.col("domain"), F.col("content_hash")), F.lit("/"))))
            rows = results.select("job_id", "source_url", "domain", "title", "language", "content_hash", "content_length", ref.alias("content_ref"), "status", "crawl_duration_ms", F.lit(None).cast(MEDIA).alias("media_meta"), F.lit(None).cast(PROBE).alias("media_probe"))
            sinks.published(rows, f"{out}/results/batch={number}", "overwrite")
            found = page_edges(results.filter("status.kind = 'Success'").withColumn("url", F.col("source_url"))).select("source_url", "job_id", "depth", "url")
            sinks.published(found.union(map_edges(batch)), f"{out}/edges/batch={number}", "overwrite")
        finally:
            results.unpersist()

    return fetched.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
