"""Command line over a store folder of versioned tables: seed, crawl, status, export, ingest, harvest, tracks-export, inspect.

Nothing is fetched: `crawl` creates a job and its seed tasks, `ingest` works on landed pages, `harvest` reads landed catalog files.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import parse_size
from .operators.admission import seed_tasks
from .operators.manifest import TRACK_KEY, catalog_rows, insert_if_absent, merge_tracks, upsert_jobs
from .operators.reports import exported, pages_of_domain
from .plans.schemas import FETCHED, RESULT
from .sources import catalogs, sinks, tables
from .sources.keyed import BucketTable
from .streaming import crawl, worker

SOURCES = ["jamendo", "archive_org", "fma"]


def _append(spark: SparkSession, rows, table: str) -> None:
    """Files beside those that are there; a table that older commands published in versions becomes the first batch of one that grows."""
    sinks.append_batch(rows, table)


def _save_job(spark: SparkSession, store: str, config: dict) -> None:
    now = int(time.time() * 1000)
    row = spark.createDataFrame([(config["id"], config["name"], config["status"], json.dumps(config), now, now)], "job_id string, name string, status string, config string, created_at long, updated_at long")
    old = sinks.read_table(spark, f"{store}/jobs")
    sinks.publish(row if old is None else upsert_jobs(old, row), f"{store}/jobs")


def seed(spark, a) -> None:
    """Valid seeds become tasks of priority 100; no valid seed is an error before anything is written."""
    lines = sys.stdin.read().splitlines() if a.stdin else None
    job = a.job or str(uuid.uuid4())
    tasks = seed_tasks(tables.seeds(spark, a.urls, a.file, lines), job).cache()
    if not tasks.count():
        raise SystemExit("no valid seed URL")
    given = [r.url for r in tasks.select("url").collect()]
    config = {"id": job, "name": a.label, "status": "Running", "seeds": given}
    if getattr(a, "max_content", None):
        config["max_content_size"] = spark.range(1).select(parse_size(F.lit(a.max_content))).first()[0]
    for key in ("max_depth", "max_pages", "max_pages_per_domain", "default_license"):
        if getattr(a, key, None) is not None:
            config[key] = getattr(a, key)
    if getattr(a, "follow_external", False):
        config["follow_external_links"] = True
    _save_job(spark, a.store, config)
    _append(spark, tasks, f"{a.store}/tasks")
    print(job)


def status(spark, a) -> None:
    rows = sinks.read_table(spark, f"{a.store}/jobs")
    if rows is not None:
        shown = (rows.filter(F.col("job_id") == a.job) if a.job else rows).select("job_id", "name", "status").orderBy("name", "job_id")
        for row in shown.toLocalIterator():
            print(row.job_id, row.name, row.status, sep="\t")


def export(spark, a) -> None:
    print(sinks.export_pages(pages_of_domain(sinks.read_table(spark, f"{a.store}/pages"), a.domain, a.job), a.output, a.format))


def harvest(spark, a) -> None:
    """Rows of a landed catalog enter the manifest if they are new; only new ones become tasks."""
    if a.source == "jamendo":
        items = catalogs.jamendo_items(catalogs.jamendo_pages(spark, a.path), limit=a.limit)
    elif a.source == "archive_org":
        items = catalogs.archive_items(spark, a.path, a.files, limit=a.limit)
    else:
        items = catalogs.up_to_admitted(catalogs.fma_rows(catalogs.two_header_csv(spark, a.path), a.mirror), sinks.read_table(spark, f"{a.store}/tracks"), a.limit)
    job = str(uuid.uuid4())
    work, records = catalog_rows(items, job)
    old = sinks.read_table(spark, f"{a.store}/tracks")
    fresh = insert_if_absent(records.withColumn("seq", F.lit(0)), old if old is not None else records.limit(0), ["source", "source_id"]).drop("seq").cache()
    new = fresh.select("source", "source_id")
    todo = catalogs.fma_archive_task(spark, a.mirror, "fma_small", job) if a.source == "fma" else work.join(new, (F.col("media.source") == new["source"]) & (F.col("media.source_id") == new["source_id"]), "left_semi")
    _append(spark, todo, f"{a.store}/media_tasks_{a.source}")
    if BucketTable.exists(spark, f"{a.store}/tracks"):
        BucketTable(spark, f"{a.store}/tracks", TRACK_KEY).merge(fresh, merge_tracks)
    else:
        _append(spark, fresh, f"{a.store}/tracks")
    print(fresh.count())


def ingest(spark, a) -> None:
    """Fetched pages that were landed in the store become results, pages, tracks and admitted tasks; each step goes on where it stopped."""
    messages, state = f"{a.store}/messages", f"{a.store}/state"
    fetched = spark.readStream.schema(FETCHED).parquet(f"{a.store}/fetched")
    worker.page_stream(fetched, messages, f"{state}/worker", worker.Work(store=f"{a.store}/content" if a.keep_pages else None)).awaitTermination()
    jobs = lambda: tables.decoded_jobs(sinks.read_table(spark, f"{a.store}/jobs"))
    for kind in ("edges", "results"):
        if not sinks.exists(spark, f"{messages}/{kind}"):
            return
    raw = lambda: spark.readStream.option("recursiveFileLookup", "true")
    # pages first: what was fetched now is known when its links are looked at
    crawl.result_stream(raw().schema(RESULT).json(f"{messages}/results"), a.store, f"{state}/results").awaitTermination()
    crawl.admission_stream(raw().text(f"{messages}/edges"), jobs, lambda: crawl.page_index(spark, a.store), f"{a.store}/admission", f"{state}/admission", publish=True).awaitTermination()
    print(spark.read.parquet(f"{a.store}/admission/tasks").count())


def tracks_export(spark, a) -> None:
    rows = tables.tracks_of(sinks.read_table(spark, f"{a.store}/tracks"), a.source)
    kept = exported(rows, a.include_incomplete, a.all_licenses)
    print(sinks.write_manifest(kept, f"{a.output}/manifest.jsonl.zst"))
    sinks.write_summary(kept, f"{a.output}/summary.json", a.source, rows.count(), F.current_timestamp())
    sinks.write_attribution(kept, f"{a.output}/ATTRIBUTION.txt")


def inspect(spark, a) -> None:
    tables.domain_metadata(sinks.read_table(spark, f"{a.store}/domains"), a.domain).show(truncate=False)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    p.add_argument("--store", required=True)
    sub = p.add_subparsers(required=True)
    for name in ("seed", "crawl"):
        c = sub.add_parser(name)
        c.set_defaults(run=seed)
        c.add_argument("--urls", nargs="*")
        c.add_argument("--file")
        c.add_argument("--stdin", action="store_true")
        c.add_argument("--label", default="job")
        c.add_argument("--job")
        for key in ("max-depth", "max-pages", "max-pages-per-domain"):
            c.add_argument(f"--{key}", type=int)
        c.add_argument("--max-content")
        c.add_argument("--default-license")
        c.add_argument("--follow-external", action="store_true")
    c = sub.add_parser("status")
    c.set_defaults(run=status)
    c.add_argument("--job")
    c = sub.add_parser("export")
    c.set_defaults(run=export)
    c.add_argument("--domain", required=True)
    c.add_argument("--job")
    c.add_argument("--output", required=True)
    c.add_argument("--format", default="json")
    c = sub.add_parser("harvest")
    c.set_defaults(run=harvest)
    c.add_argument("source", choices=SOURCES)
    c.add_argument("path")
    c.add_argument("--files")
    c.add_argument("--mirror", default="https://os.unil.cloud.switch.ch/fma")
    c.add_argument("--limit", type=int)
    c = sub.add_parser("ingest")
    c.set_defaults(run=ingest)
    c.add_argument("--keep-pages", action="store_true")
    c = sub.add_parser("tracks-export")
    c.set_defaults(run=tracks_export)
    c.add_argument("--source", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--include-incomplete", action="store_true")
    c.add_argument("--all-licenses", action="store_true")
    c = sub.add_parser("inspect")
    c.set_defaults(run=inspect)
    c.add_argument("domain")
    a = p.parse_args(argv)
    a.run(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), a)


if __name__ == "__main__":
    main()
