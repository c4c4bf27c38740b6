"""Keyed merges: page rows, jobs, domain metadata and the track manifest.

Parquet has no MERGE, so a merge is a plan that yields the table's next version: an anti-join for insert-if-absent, a ranked
union for last-write-wins, a full outer join with a rule for each column for the manifest. `sinks.publish` swaps versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import status_code
from ..plans.schemas import TRACK

TRACK_KEY = ["source", "source_id"]
PAGE_KEY = ["domain", "job_id", "url"]
#: On a match: keep the old value when the new one is null.
TRACK_FILLED = ["title", "artist", "album", "year", "genre", "format", "sha256", "object_path"]
#: On a match: the new value, null or not.
TRACK_REPLACED = ["duration_secs", "bitrate_kbps", "bytes", "status", "error", "updated_at"]


def latest(rows: DataFrame, key: list[str], order: list[Column | str], first: bool = False) -> DataFrame:
    """One row per key: the last in order, or the first."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*(by if first else [c.desc() for c in by]))))
    return ranked.filter("_rank = 1").drop("_rank")


def insert_if_absent(new: DataFrame, old: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """The rows of `new` to append: first of their key in the batch and not in `old`."""
    return latest(new, key, [order], first=True).join(old.select(*key), key, "left_anti")


def existing(candidates: DataFrame, pages: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Candidates that have a page row."""
    key = key or PAGE_KEY
    return candidates.join(pages.select(*key).distinct(), key, "left_semi")


def not_crawled(candidates: DataFrame, pages: DataFrame, by_url_alone: bool = False) -> DataFrame:
    """Candidates without a page row of their key; `by_url_alone` drops a URL that any job has crawled for a key of the batch."""
    if not by_url_alone:
        return candidates.join(pages.select(*PAGE_KEY), PAGE_KEY, "left_anti")
    hits = existing(candidates, pages).select("url").distinct()
    return candidates.join(hits, "url", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """All columns of the last write of each key win."""
    both = old.withColumn("_new", F.lit(0)).withColumn(order, F.lit(-1).cast("long") if order not in old.columns else F.col(order))
    both = both.unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, key, ["_new", order]).drop("_new")


def upsert_jobs(old: DataFrame, new: DataFrame) -> DataFrame:
    """On a match only status, config and updated_at change."""
    o, n = old.alias("o"), new.alias("n")
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
    fresh = lambda c: F.when(F.col("n.job_id").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return o.join(n, F.col("o.job_id") == F.col("n.job_id"), "full_outer").select(pick("job_id"), pick("name"), fresh("status"), fresh("config"), pick("created_at"), fresh("updated_at"))


def set_job_status(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """`changes` has job_id and status; nothing but the status changes."""
    c = changes.select("job_id", F.col("status").alias("_status"))
    return jobs.join(c, "job_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def merge_tracks(old: DataFrame, new: DataFrame, replace_identity: bool = False, order: str | None = None) -> DataFrame:
    """The manifest after `new`: filled, replaced and kept columns as the lists above say; unmatched rows as they are.

    `replace_identity`: the new row also replaces the columns that are otherwise kept. `new` may hold several rows
    of a key if `order` names a column; the last one counts.
    """
    if order:
        new = latest(new, TRACK_KEY, [order]).drop(order)
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{c}") == F.col(f"n.{c}") for c in TRACK_KEY]
    matched, out = F.col("n.source_id").isNotNull(), []
    for c in old.columns:
        mine, theirs = F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c in TRACK_KEY or (c not in TRACK_FILLED + TRACK_REPLACED and not replace_identity):
            value = F.when(F.col("o.source_id").isNotNull(), mine).otherwise(theirs)
        elif c in TRACK_FILLED and not replace_identity:
            value = F.coalesce(theirs, mine)
        else:
            value = F.when(matched, theirs).otherwise(mine)
        out.append(value.alias(c))
    return o.join(n, on[0] & on[1], "full_outer").select(*out)


def page_rows(results: DataFrame, now: Column) -> DataFrame:
    """Page rows of results: unknown domain spelled out, status as a code, one time for the batch."""
    r = F.col
    return results.select(F.coalesce("domain", F.lit("unknown")).alias("domain"), "job_id", r("source_url").alias("url"), status_code(r("status.kind"), r("status.http_code")).alias("http_status"), "content_length", "content_hash", "title", "language", "content_ref", now.alias("crawled_at"), "crawl_duration_ms")


def result_tracks(results: DataFrame) -> DataFrame:
    """Track rows of the results that carry media provenance."""
    r, status = F.col, F.col("status.kind")
    filled = {
        "source": r("media_meta.source"), "source_id": r("media_meta.source_id"), "job_id": r("job_id"), "url": r("source_url"),
        "title": F.coalesce("title", "media_meta.title"), "artist": F.coalesce("media_probe.artist", "media_meta.artist"), "album": F.coalesce("media_probe.album", "media_meta.album"),
        "year": r("media_probe.year"), "genre": r("media_probe.genre"), "license": r("media_meta.license"), "license_url": r("media_meta.license_url"),
        "origin_page_url": r("media_meta.origin_page_url"), "discovered_from_url": r("media_meta.discovered_from_url"), "collection": r("media_meta.collection"),
        "duration_secs": r("media_probe.duration_secs"), "bitrate_kbps": r("media_probe.bitrate_kbps"), "format": r("media_probe.format"),
        "sha256": F.when(F.length("content_hash") == 64, r("content_hash")), "bytes": F.coalesce("media_probe.bytes", "content_length"), "object_path": r("content_ref"),
        "status": F.when(status == "Success", "done").when(status.isin("ProbeFailed", "QualityRejected"), "rejected").otherwise("failed"),
        "error": F.when(status != "Success", F.concat_ws(": ", status, F.coalesce(r("status.message"), r("status.http_code").cast("string")))),
    }
    return results.filter("media_meta is not null").select(*[filled[f.name].cast(f.dataType).alias(f.name) for f in TRACK.fields])


def failure_result(tasks: DataFrame, kind: Column, message: Column, http: Column) -> DataFrame:
    """Result rows of failed tasks: domain, provenance and status only."""
    from ..functions.urls import root_domain_col

    return tasks.select("job_id", F.col("url").alias("source_url"), root_domain_col("url").alias("domain"), F.struct(kind.alias("kind"), http.cast("int").alias("http_code"), message.alias("message")).alias("status"), F.col("media").alias("media_meta"))


def media_result(outcomes: DataFrame) -> DataFrame:
    """Result columns of stored media: a file or object reference, and the hash if the stored name is one."""
    stem = F.regexp_extract("object_path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    ref = F.when(F.col("local"), F.concat(F.lit("file://"), "object_path")).otherwise(F.concat(F.lit("object://"), "object_path"))
    return outcomes.withColumn("content_ref", ref).withColumn("content_hash", F.when(F.length(stem) == 64, stem))


def catalog_rows(items: DataFrame, job_id: str) -> tuple[DataFrame, DataFrame]:
    """(tasks, pending tracks) of catalog items (source, source_id, url, license, ...); items without a known license go."""
    good = items.filter((F.trim(F.coalesce("license", F.lit(""))) != "") & (F.lower(F.trim("license")) != "unknown"))
    col = lambda c: F.col(c) if c in items.columns else F.lit(None).cast("string")
    media = F.struct(*[col(c).alias(c) for c in ("source", "source_id", "title", "artist", "license", "license_url", "origin_page_url")], col("origin_page_url").alias("discovered_from_url"), col("collection").alias("collection"))
    jobs = good.select("url", F.lit(job_id).alias("job_id"), F.lit(0).alias("depth"), F.lit(1).alias("priority"), F.lit("AudioFile").alias("kind"), media.alias("media"))
    given = {"job_id": F.lit(job_id), "status": F.lit("pending"), "discovered_from_url": col("origin_page_url")}
    tracks = good.select(*[given.get(f.name, col(f.name)).cast(f.dataType).alias(f.name) for f in TRACK.fields])
    return jobs, tracks


def claimable(tracks: DataFrame, source: str, now_ms: Column) -> DataFrame:
    """Pending tracks and those whose lease has run out."""
    ready = (F.col("status") == "pending") | ((F.col("status") == "downloading") & (F.col("leased_until") < now_ms))
    return tracks.filter((F.col("source") == source) & ready)


def claim(tracks: DataFrame, source: str, limit: int, now_ms: Column, lease_ms: int) -> DataFrame:
    """The next `limit` tracks, pending ones first, then by id, as leased rows. One writer at a time."""
    picked = claimable(tracks, source, now_ms).orderBy(F.when(F.col("status") == "pending", 0).otherwise(1), "source_id").limit(limit)
    return picked.withColumn("status", F.lit("downloading")).withColumn("leased_until", now_ms + lease_ms)


def apply_claim(tracks: DataFrame, claimed: DataFrame) -> DataFrame:
    c = claimed.select(*TRACK_KEY, F.col("status").alias("_s"), F.col("leased_until").alias("_l"))
    return tracks.join(c, TRACK_KEY, "left").withColumn("status", F.coalesce("_s", "status")).withColumn("leased_until", F.coalesce("_l", "leased_until")).drop("_s", "_l")


def retry_queue(failed: DataFrame, most: int = 10000, attempts: int = 10) -> DataFrame:
    """Pending manifest writes: at most `attempts` tries each; beyond `most` the oldest are dropped."""
    return failed.filter(F.col("attempts") < attempts).orderBy(F.desc("seq")).limit(most)
