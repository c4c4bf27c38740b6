"""Export filters, summaries, attribution and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_field, rfc3339, track_exported
from .scans import ranked, running

PAGE_CSV = ["domain", "job_id", "url", "http_status", "content_length", "content_hash", "title", "language", "content_ref", "crawled_at"]


#: Heading of the last section of the attribution text, which readers look for (fixed value).
TERMS_HEAD = "LICENSE TERMS\n============="


def exported(tracks: DataFrame, include_incomplete: bool = False, all_licenses: bool = False) -> DataFrame:
    return tracks.filter(track_exported(F.col("status"), F.col("license"), include_incomplete, all_licenses))


def summary_counts(tracks: DataFrame) -> DataFrame:
    """(dimension, key, n) for status, format (nulls skipped) and license, from one pass over the rows."""
    one = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("key")) for d in ("status", "format", "license")]))
    return tracks.select(one.alias("x")).select("x.*").filter("key is not null").groupBy("dimension", "key").agg(F.count(F.lit(1)).alias("n"))


def summary_totals(tracks: DataFrame) -> DataFrame:
    secs = F.sum(F.coalesce("duration_secs", F.lit(0.0)))
    return tracks.agg(F.count(F.lit(1)).alias("tracks_exported"), F.coalesce(F.sum(F.coalesce("bytes", F.lit(0))), F.lit(0)).alias("total_bytes"), F.coalesce(secs, F.lit(0.0)).alias("total_duration_secs"), F.round(F.coalesce(secs, F.lit(0.0)) / 3600, 2).alias("total_duration_hours"))


def summary_json(tracks: DataFrame, source: str, total_rows: int, generated_at: Column) -> DataFrame:
    """One row with the summary as pretty JSON."""
    maps = summary_counts(tracks).groupBy().pivot("dimension", ["status", "format", "license"]).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))))
    body = summary_totals(tracks).crossJoin(maps)  # two single rows
    fields = F.struct(F.lit(1).alias("manifest_version"), rfc3339(generated_at).alias("generated_at"), F.lit(source).alias("source"), F.lit(total_rows).alias("total_rows_in_store"), "tracks_exported", "total_bytes", "total_duration_secs", "total_duration_hours", F.col("status").alias("by_status"), F.col("format").alias("by_format"), F.col("license").alias("by_license"))
    return body.select(F.to_json(fields, {"pretty": "true"}).alias("summary"))


def license_groups(tracks: DataFrame) -> DataFrame:
    """Per license: number of tracks and the first deed URL in (source, source_id) order, or a pointer to the catalog."""
    deed = F.min_by("license_url", F.when(F.col("license_url").isNotNull(), F.struct("source", "source_id")))
    return tracks.groupBy("license").agg(F.count(F.lit(1)).alias("tracks"), F.coalesce(deed, F.lit("see source catalog")).alias("deed"))


def attribution_lines(tracks: DataFrame, engine: str = "corpusloom") -> DataFrame:
    """(section, license, rank, line): the attribution text in order of these columns."""
    line = lambda cond, text: F.when(cond, text)
    # The form of an entry and of its heading, which programs that read credits look for.
    entry = F.array_compact(F.array(
        F.concat(F.lit("- "), F.coalesce("title", F.lit("(untitled)")), F.lit(" — "), F.coalesce("artist", F.lit("(unknown artist)"))),
        line(F.col("album").isNotNull(), F.concat(F.lit("  Album: "), "album")),
        F.concat(F.lit("  Source: "), "source", F.lit(" id="), "source_id"),
        line(F.col("origin_page_url").isNotNull(), F.concat(F.lit("  Origin: "), "origin_page_url")),
        F.when(F.col("license_url").isNotNull(), F.concat(F.lit("  License: "), "license", F.lit(" ("), "license_url", F.lit(")"))).otherwise(F.concat(F.lit("  License: "), "license")),
        F.concat(F.lit("  URL: "), "url"),
    ))
    entries = tracks.select("license", "source", "source_id", F.concat_ws("\n", entry).alias("line"))
    tracks_ = ranked(entries, ["license"], ["source", "source_id"], "rank").select(F.lit(1).alias("section"), "license", F.col("rank").cast("int").alias("rank"), "line")
    groups = license_groups(tracks)
    heads = groups.select(F.lit(1).alias("section"), "license", F.lit(0).alias("rank"), F.format_string("== License: %s (%d tracks) ==", "license", "tracks").alias("line"))
    gaps = groups.select(F.lit(1).alias("section"), "license", F.lit(2**31 - 1).alias("rank"), F.lit("").alias("line"))
    terms = groups.select(F.lit(3).alias("section"), "license", F.lit(0).alias("rank"), F.concat("license", F.lit(": "), "deed").alias("line"))
    first = tracks.agg(F.coalesce(F.min_by("source", F.struct("license", "source", "source_id")), F.lit("unknown")).alias("source"))
    top = first.select(F.lit(0).alias("section"), F.lit(None).cast("string").alias("license"), F.lit(0).alias("rank"), F.concat(F.lit(f"CREDITS\n=======\nWritten by {engine} for the catalog '"), "source", F.lit("'.\n\nTracks are listed by license: title and artist first, then where the track comes from.\nThe last section says where each license can be read.\n")).alias("line"))
    middle = tracks.sparkSession.createDataFrame([(2, None, 0, TERMS_HEAD)], "section int, license string, rank int, line string")
    return top.unionByName(heads).unionByName(tracks_).unionByName(gaps).unionByName(middle).unionByName(terms)


def pages_of_domain(pages: DataFrame, domain: str, job_id: str | None = None) -> DataFrame:
    """Exact domain, optionally one job; both filters reach the scan. A job id that is no UUID is an error."""
    rows = pages.filter(F.col("domain") == domain)
    if job_id is not None:
        import uuid

        rows = rows.filter(F.col("job_id") == str(uuid.UUID(job_id)))
    return rows.select(*PAGE_CSV)


def page_csv_line() -> Column:
    """A page as a CSV line: text fields quoted, no length counts as 0, times in RFC 3339."""
    text = {c: csv_field(F.col(c)) for c in ("domain", "url", "content_hash", "title", "language", "content_ref")}
    text |= {"job_id": F.col("job_id"), "http_status": F.col("http_status").cast("string"), "content_length": F.coalesce("content_length", F.lit(0)).cast("string"), "crawled_at": csv_field(rfc3339(F.col("crawled_at")))}
    return F.concat_ws(",", *[text[c] for c in PAGE_CSV])


def page_csv_lines(pages: DataFrame) -> DataFrame:
    return pages.select(page_csv_line().alias("line"))


def outcome_counts(results: DataFrame) -> DataFrame:
    """Pages crawled and failed; media harvested, rejected and failed with their bytes."""
    kind, media = F.col("status.kind"), F.col("media_meta").isNotNull()
    ok, refused = kind == "Success", kind.isin("ProbeFailed", "QualityRejected")
    return results.agg(
        F.count_if(~media & ok).alias("pages_crawled"),
        F.count_if(~media & ~ok).alias("pages_failed"),
        F.count_if(media & ok).alias("harvested"),
        F.count_if(media & refused).alias("rejected"),
        F.count_if(media & ~ok & ~refused).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.coalesce("content_length", F.lit(0)))), F.lit(0)).alias("bytes"),
    )


def running_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status") == "Running").alias("jobs_running"))


def quarantine_counts(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def within_disk_budget(files: DataFrame, group: str, order: str, size: str, cap: int, stored: int = 0, free: int | None = None, floor: int = 0) -> DataFrame:
    """Adds `fits`: the group's (volume's) running total in order stays within cap (0: no cap) and leaves `floor` free; unknown free space passes."""
    rows, total = running(files, [group], order, F.col(size), "_total"), F.coalesce("_total", F.lit(0))
    fits = F.lit(True) if cap == 0 else total + stored <= cap
    if free is not None:
        fits = fits & (F.lit(free) - total >= floor)
    return rows.withColumn("fits", fits).drop("_total")
