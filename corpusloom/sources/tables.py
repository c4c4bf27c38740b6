"""Reads of persistent tables, seed lists and landed message streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.schemas import JOB, JOB_DEFAULTS
from . import landed


def seeds(spark: SparkSession, urls: list[str] | None = None, file: str | None = None, lines: list[str] | None = None) -> DataFrame:
    """Seeds from arguments, a file (blank and # lines skipped) and given lines (blank ones skipped), repeats kept."""
    parts = []
    if urls:
        parts.append(spark.createDataFrame([(u,) for u in urls], "url string"))
    if file:
        text = spark.read.text(file).select(F.trim("value").alias("url"))
        parts.append(text.filter("url <> '' and not startswith(url, '#')"))
    if lines:
        parts.append(spark.createDataFrame([(x.strip(),) for x in lines if x.strip()], "url string"))
    if not parts:
        return spark.createDataFrame([], "url string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decoded_jobs(rows: DataFrame) -> DataFrame:
    """Jobs of rows (job_id, config JSON); configs that do not decode go, fields older documents lack get their defaults."""
    d = rows.withColumn("c", F.from_json("config", JOB)).filter("c.id is not null")
    return d.select(*[F.coalesce(F.col(f"c.{f.name}"), F.lit(JOB_DEFAULTS[f.name])).alias(f.name) if f.name in JOB_DEFAULTS else F.col(f"c.{f.name}") for f in JOB.fields])


def encoded_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.select(F.col("id").alias("job_id"), F.to_json(F.struct(*[c for c in jobs.columns])).alias("config"))


def job_by_id(rows: DataFrame, job_id: str) -> DataFrame:
    return decoded_jobs(rows.filter(F.col("job_id") == job_id))


def tracks_of(tracks: DataFrame, source: str, limit: int | None = None) -> DataFrame:
    out = tracks.filter(F.col("source") == source)
    return out if limit is None else out.orderBy("source_id").limit(limit)


def domain_metadata(rows: DataFrame, domain: str) -> DataFrame:
    """The robots row of a domain, and none where nothing was stored."""
    return rows.filter((F.col("domain") == domain) & (F.col("robots_txt").isNotNull() | F.col("crawl_delay_ms").isNotNull()))


def frontier_depth(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Tasks without a result."""
    open_ = tasks.join(results.select("job_id", F.col("source_url").alias("url")).distinct(), ["job_id", "url"], "left_anti")
    return open_.agg(F.count(F.lit(1)).alias("frontier_size"))


def messages(spark: SparkSession, path: str, schema: StructType, max_files: int = 10, pull: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed) of a stream of text files of JSON messages; a message that does not decode is kept aside with its text.

    A micro-batch has at most `max_files` files, or with `pull` at most min(pull, 500) messages, whatever files they are in.
    """
    if pull is None:
        raw = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    else:
        landed.register(spark)
        raw = spark.readStream.format("pulled_messages").option("path", path).option("batch", pull).load().select("value")
    parsed = raw.withColumn("m", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    first = schema.fields[0].name
    return parsed.filter(F.col(f"m.{first}").isNotNull()).select("m.*"), parsed.filter(F.col(f"m.{first}").isNull()).select("value")
