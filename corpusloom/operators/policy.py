"""Job policy: URL rules, seed roots and the external-link gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_domain_token
from ..functions.urls import root_domain_col


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def url_allowed(url: Column, depth: Column, root: Column) -> Column:
    """Depth, allowlist by root domain, no exclude substring, some include substring; over the job's columns."""
    deep = depth <= F.coalesce(F.col("max_depth"), F.lit(2**31 - 1))
    listed = (F.size(_list("allowed_domains")) == 0) | F.exists(_list("allowed_domains"), lambda d: F.lower(d) == F.lower(root))
    excluded = F.exists(_list("exclude_patterns"), lambda p: url.contains(p))
    included = (F.size(_list("include_patterns")) == 0) | F.exists(_list("include_patterns"), lambda p: url.contains(p))
    return deep & listed & ~excluded & included


def with_seed_roots(jobs: DataFrame, id_col: str = "id") -> DataFrame:
    """Adds seed_roots: sorted distinct root domains of the seeds, only for jobs that neither follow external links nor have an allowlist."""
    wanted = ~F.coalesce(F.col("follow_external_links"), F.lit(False)) & (F.size(_list("allowed_domains")) == 0)
    seeds = jobs.filter(wanted).select(F.col(id_col).alias("_j"), F.explode("seeds").alias("seed")).withColumn("root", root_domain_col("seed"))
    roots = seeds.filter("root is not null").groupBy("_j").agg(F.array_sort(F.collect_set("root")).alias("seed_roots"))
    return jobs.join(roots, jobs[id_col] == roots["_j"], "left").drop("_j")


def external_allowed(root: Column, job_known: Column) -> Column:
    """No job passes; so do jobs that follow external links or have an allowlist; else the root must be one of the seed roots."""
    free = F.coalesce(F.col("follow_external_links"), F.lit(False)) | (F.size(_list("allowed_domains")) > 0)
    own = F.exists(_list("seed_roots"), lambda r: F.lower(normalize_domain_token(r)) == F.lower(normalize_domain_token(root)))
    return ~job_known | free | (F.coalesce(root, F.lit("")).isin("", "unknown") == F.lit(False)) & own


def running(status: Column) -> Column:
    """A job that is absent, running or pending does not stop its candidates."""
    return status.isNull() | status.isin("Running", "Pending")
