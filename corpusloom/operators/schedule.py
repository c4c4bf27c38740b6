"""Politeness in virtual time: when each request of a domain may go out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import carried, place


def period_ms(delay: Column) -> Column:
    """Zero counts as one second, anything shorter than a millisecond as one."""
    return F.when(delay == 0, 1000.0).when(delay < 1, 1.0).otherwise(delay.cast("double"))


def ratcheted(requests: DataFrame, default_ms: int, domain: str = "domain", delay: str = "delay_ms", order: str = "seq", at: str = "_range") -> DataFrame:
    """Adds `period_ms` in force at each request: the longest delay announced so far, the default before any. `requests` has its range of the order in `at`."""
    rows = carried(requests, [domain], order, F.col(delay), "_longest", "max", at)
    return rows.withColumn("period_ms", F.coalesce(period_ms(F.col("_longest")), F.lit(float(default_ms)))).drop("_longest")


def scheduled(requests: DataFrame, default_ms: int, domain: str = "domain", arrival: str = "arrival_ms", delay: str = "delay_ms", order: str = "seq", ranges: int | None = None) -> DataFrame:
    """Adds `period_ms` and `scheduled_ms` = max(arrival, previous scheduled + period).

    With P the running sum of the periods, scheduled - P is the running maximum of arrival - P (the first request's own period is on both sides).
    So the recurrence is three scans over ranges of the order, and one domain with most requests is spread over the ranges.
    """
    dealt = requests.withColumn("_range", place(requests, order, ranges))
    rows = carried(ratcheted(dealt, default_ms, domain, delay, order), [domain], order, F.col("period_ms"), "_p")
    rows = carried(rows, [domain], order, F.col(arrival) - F.col("_p"), "_m", "max")
    return rows.withColumn("scheduled_ms", F.col("_m") + F.col("_p")).drop("_p", "_m", "_range")


def with_robots(tasks: DataFrame, cache: DataFrame, now_ms: Column, ttl_ms: int = 86_400_000, missing_ttl_ms: int = 3_600_000) -> DataFrame:
    """Tasks with the live robots row of their origin (scheme://authority); denied rows are never cached."""
    ttl = F.when(F.col("status") == "Success", ttl_ms).otherwise(missing_ttl_ms)
    live = cache.filter((F.col("status") != "Denied") & (F.col("fetched_at_ms") > now_ms - ttl))
    origin = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    return tasks.withColumn("origin", origin).join(live.select("origin", "status", "crawl_delay_ms", "body"), "origin", "left")
