"""Catalog readers: landed JSON pages, item and file listings, a CSV with two header rows, zip members."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import format_preference, license_from_cc_url, license_from_title, license_from_url_and_rights, redistributable
from ..functions.urls import archive_details_url, archive_download_url, jamendo_download_url, subset_path
from ..operators.dedup import best_files
from ..operators.scans import carried, place, running
from . import landed
from .shared import keep

JAMENDO_PAGE = "headers struct<status:string,warnings:string,error_message:string>, results array<struct<id:string,name:string,artist_name:string,album_name:string,license_ccurl:string,audiodownload:string,audiodownload_allowed:boolean,shareurl:string>>"
ARCHIVE_PAGE = "items array<struct<identifier:string,title:string,licenseurl:string,rights:string>>, cursor string"
ARCHIVE_FILES = "identifier string, files array<struct<name:string,format:string>>"


def _blank_null(name: str):
    return F.nullif(F.trim(name), F.lit(""))


def _offset() -> Column:
    """The last number in a landed page's file name."""
    return F.regexp_extract(F.col("page"), r"(\d+)\D*$", 1).try_cast("long")


def jamendo_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages with the offset in their file name: a page with a status other than success is an error row."""
    return spark.read.schema(JAMENDO_PAGE).json(path, multiLine=True).withColumn("page", F.col("_metadata.file_name")).withColumn("offset", _offset())


def landed_pages(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """(offset, the columns of `schema`) of pages landed by offset, read by ranges of offsets (`landed.LandedPages` and its options)."""
    landed.register(spark)
    rows = spark.read.format("landed_pages").option("path", path).options(**options).load()
    return rows.select("offset", F.from_json("body", schema).alias("p")).select("offset", "p.*")


def pages_up_to(pages: DataFrame, empty: Column, counted: Column, limit: int | None = None, empty_stop: int = 1) -> DataFrame:
    """The pages (with a number `offset`) of a walk in order of the offset that ends after the `empty_stop`-th empty page in a row, or before the first page that
    finds `limit` reached by what the pages before it counted. So a walk may go over its limit by what one page holds.

    Counts run over ranges of the offset, and runs of empty pages are found by joins on the page's place, so no task and no driver sees all pages.
    """
    one = keep(pages.select("offset", empty.cast("int").alias("_empty"), counted.cast("long").alias("_n")))
    placed = one.withColumn("_range", place(one, "offset"))
    placed = keep(carried(carried(placed, [], "offset", F.lit(1).cast("long"), "_place"), [], "offset", F.col("_n"), "_upto"))
    run = placed.filter("_empty = 1").select("_place")
    for back in range(1, empty_stop):
        run = run.join(placed.filter("_empty = 1").select((F.col("_place") + back).alias("_place")), "_place", "left_semi")
    stop = run.agg(F.min("_place").alias("_stop"))  # one row
    walked = placed.crossJoin(F.broadcast(stop)).filter(F.col("_stop").isNull() | (F.col("_place") <= F.col("_stop")))
    if limit is not None:
        walked = walked.filter(F.col("_upto") - F.col("_n") < limit)
    return pages.join(walked.select("offset"), "offset", "left_semi")


def _wanted(t: Column) -> Column:
    """Whether a listed track can be downloaded and has a license that is known."""
    return F.coalesce(t["audiodownload_allowed"], F.lit(False)) & (F.coalesce(t["audiodownload"], F.lit("")) != "") & license_from_cc_url(t["license_ccurl"]).isNotNull()


def jamendo_items(pages: DataFrame, empty_stop: int = 3, limit: int | None = None) -> DataFrame:
    """Tracks of the pages up to the `empty_stop`-th empty page in a row: downloadable, with a CC license. `limit` counts such tracks, known ones included, and
    is looked at before each page."""
    good = pages.filter(F.coalesce(F.col("headers.status") == "success", F.lit(False)))
    results = F.coalesce("results", F.array())
    walked = pages_up_to(good, F.size(results) == 0, F.size(F.filter(results, _wanted)), limit, empty_stop)
    t = walked.select(F.explode("results").alias("t")).select("t.*").filter(F.coalesce("audiodownload_allowed", F.lit(False)) & (F.coalesce("audiodownload", F.lit("")) != ""))
    t = t.withColumn("license", license_from_cc_url(F.col("license_ccurl"))).filter("license is not null")
    return t.select(F.lit("jamendo").alias("source"), F.col("id").alias("source_id"), jamendo_download_url(F.col("id")).alias("url"), "license", F.col("license_ccurl").alias("license_url"), F.col("shareurl").alias("origin_page_url"), F.col("album_name").alias("collection"), _blank_null("name").alias("title"), _blank_null("artist_name").alias("artist"))


def archive_pages(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Items of the pages (offset, items) up to the first empty one. `limit` counts items, whatever their license, and is looked at before each page."""
    items = F.coalesce("items", F.array())
    return pages_up_to(pages, F.size(items) == 0, F.size(items), limit).select(F.explode("items").alias("i")).select("i.*")


def archive_items(spark: SparkSession, items_path: str, files_path: str, collection: str = "netlabels", redistributable_only: bool = True, limit: int | None = None) -> DataFrame:
    """Items joined with their file listings: one row per best file of each stem."""
    pages = spark.read.schema(ARCHIVE_PAGE).json(items_path, multiLine=True).withColumn("page", F.col("_metadata.file_name")).withColumn("offset", _offset())
    files = spark.read.schema(ARCHIVE_FILES).json(files_path, multiLine=True)
    return archive_rows(archive_pages(pages, limit), files, collection, redistributable_only)


def archive_rows(items: DataFrame, files: DataFrame, collection: str = "netlabels", redistributable_only: bool = True) -> DataFrame:
    known = items.withColumn("license", license_from_url_and_rights(F.col("licenseurl"), F.col("rights"))).filter("license is not null")
    if redistributable_only:
        known = known.filter(redistributable(F.col("license"), "archive"))
    flat = files.select("identifier", F.posexplode("files").alias("index", "f")).select("identifier", "index", "f.name", "f.format")
    rows = known.join(best_files(flat, format_preference(F.col("format"))), "identifier")
    title = F.coalesce("title", F.regexp_replace("name", r"\.[^.]*$", ""))
    return rows.select(F.lit("archive_org").alias("source"), F.concat_ws("|", "identifier", "name").alias("source_id"), archive_download_url(F.col("identifier"), F.col("name")).alias("url"), "license", F.col("licenseurl").alias("license_url"), archive_details_url(F.col("identifier")).alias("origin_page_url"), F.lit(collection).alias("collection"), title.alias("title"), F.lit(None).cast("string").alias("artist"))


def two_header_csv(spark: SparkSession, path: str) -> DataFrame:
    """Tracks of a CSV with two header rows: the one whose first cell is track_id, and the group names one row above.

    The header is found in the first lines and sets which columns are read; the body is read by Spark's CSV reader. Rows without an integer
    id go; bit rates are in kbit/s.
    """
    raw = spark.read.csv(path, header=False, quote='"', escape='"', multiLine=True)
    numbered = raw.withColumn("_row", F.monotonically_increasing_id())  # a file of many lines is one partition: in order
    is_head = F.lower(F.trim(raw.columns[0])) == "track_id"
    found = numbered.filter(is_head).agg(F.min("_row")).first()[0]
    if found is None:
        raise ValueError(f"{path} has no header row that begins with track_id")
    head = [list(r)[:-1] for r in numbered.filter(F.col("_row").isin(found - 1, found)).orderBy("_row").collect()]  # two rows
    at = len(head) - 1
    groups, names = head[at - 1] if at else [None] * len(head[at]), head[at]
    filled, last = [], ""
    for g in groups:
        last = (g or "").strip().lower() or last
        filled.append(last)

    def column(group: str, name: str):
        for i, (g, n) in enumerate(zip(groups, names, strict=True)):
            if ((g or "").strip().lower() or filled[i]) == group and (n or "").strip().lower() == name:
                return F.nullif(F.trim(raw.columns[i]), F.lit(""))
        return F.lit(None).cast("string")

    track = F.trim(raw.columns[0]).try_cast("long")
    return raw.withColumn("_id", track).filter("_id is not null").select(F.col("_id").alias("track_id"), column("album", "title").alias("album"), column("track", "title").alias("title"), F.coalesce(column("artist", "name"), column("album", "artist")).alias("artist"), column("track", "duration").try_cast("double").alias("duration_secs"), F.floor(column("track", "bit_rate").try_cast("double") / 1000).cast("int").alias("bitrate_kbps"), column("track", "license").alias("license_title"))


def fma_rows(tracks: DataFrame, mirror: str, subset: str = "fma_small", redistributable_only: bool = True) -> DataFrame:
    rows = tracks.withColumn("license", license_from_title(F.col("license_title"))).filter("license is not null")
    if redistributable_only:
        rows = rows.filter(redistributable(F.col("license"), "fma"))
    url = F.concat(F.lit(f"{mirror.rstrip('/')}/{subset}.zip!"), subset_path(F.col("track_id")))
    return rows.select(F.lit("fma").alias("source"), F.col("track_id").cast("string").alias("source_id"), url.alias("url"), "license", F.lit(None).cast("string").alias("license_url"), F.concat(F.lit("fma track "), F.col("track_id").cast("string")).alias("origin_page_url"), F.lit(subset).alias("collection"), "title", "artist", "album", "duration_secs", "bitrate_kbps", F.lit("mp3").alias("format"))


def fma_archive_task(spark: SparkSession, mirror: str, subset: str, job_id: str) -> DataFrame:
    """The one bulk task of a run."""
    row = (f"{mirror.rstrip('/')}/{subset}.zip", job_id, 0, 1, "AudioFile", "fma", f"{subset}-archive", "cc-by-4.0")
    return spark.createDataFrame([row], "url string, job_id string, depth int, priority int, kind string, source string, source_id string, license string")


def zip_members(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(path, content) of one member of each zip file."""

    @F.pandas_udf("binary")
    def unzip(content: pd.Series) -> pd.Series:
        def one(data):
            with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                return z.read(member) if member in z.namelist() else None

        return content.map(one)

    return spark.read.format("binaryFile").load(path).select("path", unzip("content").alias("content"))


def up_to_admitted(items: DataFrame, known: DataFrame | None, limit: int | None, order: str = "source_id", key: tuple[str, ...] = ("source", "source_id")) -> DataFrame:
    """The items up to the one that makes the `limit`-th new item, in order of a number: new is the first of its key that `known` does not hold. Items that are known
    count nothing, those before the last new one stay, and a repeat goes with its item."""
    if limit is None:
        return items
    named = items.withColumn("_order", F.col(order).cast("long"))
    firsts = named.groupBy(*key).agg(F.min("_order").alias("_first"))
    if known is not None:
        firsts = firsts.join(known.select(*key).distinct(), list(key), "left_anti")
    steps = named.select(*key, "_order").distinct().join(firsts, list(key), "left").withColumn("_new", F.coalesce((F.col("_order") == F.col("_first")).cast("long"), F.lit(0)))
    counted = running(keep(steps), [], "_order", F.col("_new"), "_upto")  # repeats of an item are one step
    return named.join(counted.filter(F.col("_upto") - F.col("_new") < limit).select(*key, "_order"), [*key, "_order"], "left_semi").select(*items.columns)


def limited(items: DataFrame, order: str, limit: int | None) -> DataFrame:
    """The first `limit` items in order; none: all."""
    return items if limit is None else items.orderBy(order).limit(limit)
