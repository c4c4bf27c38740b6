"""Admission of discovered links: from edges to tasks, and every refused candidate with its reason.

All gates are staged columns of one plan, in a fixed order; the first failing gate names the reason. Budgets come last,
as they count only what passed everything else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import stable_id, task_kind, url_parts
from ..plans.options import Admission
from ..sources.keyed import KeyIndex, key_of
from ..sources.shared import keep
from .dedup import ordered_distinct
from .policy import external_allowed, running, url_allowed, with_seed_roots
from .scans import carried, place

#: What is known already: rows, an index of keys, or a function that tells the known keys of some rows.
Known = DataFrame | KeyIndex | Callable[[DataFrame, list[str]], DataFrame] | None
REASONS = ["invalid_or_unsafe", "dup_in_batch", "job_not_running", "job_policy", "external_link", "seen", "already_crawled", "no_license", "domain_cap", "job_domain_cap", "job_cap"]
_JOB = ["status", "max_depth", "max_pages", "max_pages_per_domain", "allowed_domains", "include_patterns", "exclude_patterns", "follow_external_links", "default_license", "seed_roots"]


def decode_edges(payload: Column) -> Column:
    """Edges of a message that is an array of edges or one edge; null if it is neither."""
    one = "struct<url:string,source_url:string,job_id:string,depth:int>"
    many = F.from_json(payload, f"array<{one}>", {"mode": "PERMISSIVE"})
    single = F.from_json(payload, one, {"mode": "PERMISSIVE"})
    return F.when(F.trim(payload).startswith("["), many).otherwise(F.when(single["url"].isNotNull(), F.array(single)))


def first_in_batch(edges: DataFrame, key: list[str], order: str = "seq") -> Column:
    return F.row_number().over(Window.partitionBy(*key).orderBy(order)) == 1


def _marked(rows: DataFrame, known: Known, on: dict[str, str], flag: str) -> DataFrame:
    """`rows` with `flag` true where their values of the columns of `on` are known: rows of a frame in which the columns have the names that `on` says, or
    keys that an index finds for them."""
    if isinstance(known, DataFrame):
        old = known.select(*[F.col(theirs).alias(mine) for mine, theirs in on.items()]).distinct().withColumn(flag, F.lit(True))
        return rows.join(old, list(on), "left")
    columns = list(on)
    found = (known.hits if isinstance(known, KeyIndex) else known)(rows, columns)
    return rows.withColumn("_key", key_of(columns)).join(found.select(F.col("key").alias("_key"), F.lit(True).alias(flag)), "_key", "left").drop("_key")


def screened(edges: DataFrame, jobs: DataFrame, pages: Known = None, seen: Known = None, options: Admission = Admission(), kept: list | None = None) -> DataFrame:
    """Edges (url, source_url, job_id, depth, seq) with url_norm, root, kind and `reason` of the gates before the budgets (null: passed).

    `seen` and `pages` are frames, key indexes, or functions of rows and key columns that return the known keys (`keyed.key_of`); an index of pages has the keys
    (domain, job_id, url), and serves only where existence is not by URL alone.
    """
    named = edges.withColumn("_u", url_parts("url")).select("*", F.col("_u.norm").alias("url_norm"), F.coalesce("_u.root", F.lit("unknown")).alias("root")).drop("_u")
    named = named.persist(StorageLevel.MEMORY_AND_DISK)  # parsed once; several branches read it
    if kept is not None:
        kept.append(named)
    key = ["url_norm"] if options.url_across_jobs else ["job_id", "url_norm"]
    valid = named.filter("url_norm is not null").withColumn("_first", first_in_batch(named, key))
    policy = with_seed_roots(jobs).select(F.col("id").alias("_job"), *_JOB)
    rows = valid.join(policy, valid["job_id"] == policy["_job"], "left")
    known = F.col("_job").isNotNull()
    rows = rows.withColumn("kind", task_kind(F.col("url_norm"))).withColumn("_seen", F.lit(False)).withColumn("_page", F.lit(False))
    if seen is not None:
        rows = _marked(rows.drop("_seen"), seen, {c: c for c in key if not isinstance(seen, DataFrame) or c in seen.columns}, "_seen")
    if pages is not None:
        on = {"url_norm": "url"} if options.existence_by_url else {"root": "domain", "job_id": "job_id", "url_norm": "url"}
        rows = _marked(rows.drop("_page"), pages, on, "_page")
    reason = (
        F.when(~F.col("_first"), "dup_in_batch")
        .when(~running(F.col("status")), "job_not_running")
        .when(known & ~url_allowed(F.col("url_norm"), F.col("depth"), F.col("root")), "job_policy")
        .when(~external_allowed(F.col("root"), known), "external_link")
        .when(F.coalesce("_seen", F.lit(False)), "seen")
        .when(F.coalesce("_page", F.lit(False)), "already_crawled")
        .when((F.col("kind") != "Page") & F.col("default_license").isNull(), "no_license")
    )
    rows = rows.withColumn("reason", reason).drop("_first", "_seen", "_page", "_job")
    bad = named.filter("url_norm is null").withColumn("reason", F.lit("invalid_or_unsafe"))
    return rows.unionByName(bad, allowMissingColumns=True)


def _with_used(passed: DataFrame, used: DataFrame | None) -> DataFrame:
    """Adds _root_used and _job_used: what earlier batches have accepted, from rows (root, job_id, n)."""
    if used is None:
        return passed.withColumn("_root_used", F.lit(0).cast("long")).withColumn("_job_used", F.lit(0).cast("long"))
    roots = used.groupBy(F.col("root").alias("_r")).agg(F.sum("n").alias("_root_used"))
    jobs = used.groupBy(F.col("job_id").alias("_j")).agg(F.sum("n").alias("_job_used"))
    rows = passed.join(roots, passed["root"] == F.col("_r"), "left").join(jobs, passed["job_id"] == F.col("_j"), "left").drop("_r", "_j")
    return rows.fillna(0, ["_root_used", "_job_used"])


def accepted_counts(admitted: DataFrame) -> DataFrame:
    """(root, job_id, n) of the admitted rows: what later batches start from."""
    return admitted.filter("reason is null").groupBy("root", "job_id").agg(F.count(F.lit(1)).alias("n"))


def one_job_budget(passed: DataFrame, options: Admission = Admission(), used: DataFrame | None = None, ranges: int | None = None) -> DataFrame:
    """Budgets when no domain is shared by several jobs: rank within the domain, then rank of the survivors within the job, by scans over ranges of the order.

    Equal to the greedy order: once a job is full nothing later of it is accepted, so its refusals cannot use up a domain.
    The reason follows from how many of the domain were accepted before. `used` holds what earlier batches accepted.
    """
    cap = F.least(F.lit(options.global_domain_cap), F.coalesce("max_pages_per_domain", F.lit(2**62)))
    rows = _with_used(passed, used).withColumn("_range", place(passed, "seq", ranges))
    rows = carried(rows, ["root"], "seq", F.lit(1).cast("long"), "_place").withColumn("_fits", F.col("_place") + F.col("_root_used") <= cap)
    rows = carried(rows, ["job_id"], "seq", F.col("_fits").cast("long"), "_rank")
    rows = rows.withColumn("_ok", F.col("_fits") & (F.col("_rank") + F.col("_job_used") <= F.coalesce("max_pages", F.lit(2**62))))
    rows = carried(rows, ["root"], "seq", F.col("_ok").cast("long"), "_taken")
    taken = F.col("_root_used") + F.col("_taken") - F.col("_ok").cast("long")
    reason = F.when(taken >= options.global_domain_cap, "domain_cap").when(taken >= F.col("max_pages_per_domain"), "job_domain_cap").otherwise("job_cap")
    return rows.withColumn("reason", F.when(~F.col("_ok"), reason)).select(*passed.columns)


#: `at` of a limit that earlier batches have used up.
_SPENT = -(2**63)


def greedy_budget(passed: DataFrame, options: Admission = Admission(), used: DataFrame | None = None, ranges: int | None = None) -> DataFrame:
    """Budgets in arrival order when jobs share domains: counters rise on acceptance alone. `seq` must differ between rows.

    A limit is a domain's count reaching a level or a job's count reaching its pages; it binds after one row, and a row is accepted if no limit of its own has
    bound before it. So the greedy order is told by the `seq` at which each limit binds. These are found by rounds: from the limits of the round before
    follows which rows are accepted, and from these where each limit is reached (counts by ranges of the order, then a rank within the one range
    where it happens). In a round every limit up to the first wrong one comes out right, and the next after it too, so the rounds end, at the only
    state that repeats itself: the greedy one. No task holds a job's or a domain's rows. Rows whose domain and job cannot run full are left out of the rounds.
    """
    name = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("="), c))
    top = F.lit(options.global_domain_cap).cast("long")
    own = F.least(top, F.coalesce("max_pages_per_domain", top)).cast("long")
    rows = _with_used(passed, used).select("seq", name("root").alias("root"), name("job_id").alias("job"), own.alias("level"), F.col("max_pages").cast("long").alias("pages"), "_root_used", "_job_used")
    rows = keep(rows.withColumn("at", place(passed, "seq", ranges)))
    limits = keep(_limits(rows, top))
    busy = limits.select("kind", "key").distinct()
    both = F.array(F.struct(F.lit("domain").alias("kind"), F.col("root").alias("key")), F.struct(F.lit("job").alias("kind"), F.col("job").alias("key")))
    known, rounds = limits, limits.count() + 2
    for _ in range(rounds):
        events = _accepted(rows, known).select("seq", "at", F.explode(both).alias("e")).select("seq", "at", "e.kind", "e.key").join(busy, ["kind", "key"])
        counts = events.groupBy("kind", "key", "at").agg(F.count(F.lit(1)).alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("kind", "key").orderBy("at")))  # at most one row a range
        hit = limits.filter("left > 0").join(upto, ["kind", "key"]).filter("upto >= left and upto - n < left").select("kind", "key", "level", "at", (F.col("left") - (F.col("upto") - F.col("n"))).alias("nth"))
        inside = events.join(hit.select("kind", "key", "at").distinct(), ["kind", "key", "at"]).withColumn("nth", F.row_number().over(Window.partitionBy("kind", "key", "at").orderBy("seq")))
        found = inside.join(hit, ["kind", "key", "at", "nth"]).select("kind", "key", "level", F.col("seq").alias("_binds"))
        new = keep(limits.join(found, ["kind", "key", "level"], "left").withColumn("binds", F.coalesce("_binds", "binds")).drop("_binds"))
        changed = new.join(known.select("kind", "key", "level", F.col("binds").alias("_was")), ["kind", "key", "level"]).filter(~F.col("binds").eqNullSafe(F.col("_was"))).limit(1).count()
        known = new
        if not changed:
            break
    else:
        raise ValueError("seq must differ between rows")
    after = lambda kind, of: known.filter(F.col("kind") == kind).select(F.col("key").alias(f"_key{of}"), F.col("level").alias(f"_level{of}"), F.col("binds").alias(f"_binds{of}"))
    out = passed.withColumn("_root", name("root")).withColumn("_job", name("job_id")).withColumn("_own", own)
    out = out.join(after("domain", 0), (F.col("_root") == F.col("_key0")) & (F.col("_level0") == top), "left")
    out = out.join(after("domain", 1), (F.col("_root") == F.col("_key1")) & (F.col("_level1") == F.col("_own")), "left")
    out = out.join(after("job", 2), F.col("_job") == F.col("_key2"), "left")
    late = lambda of: F.col("seq") > F.col(f"_binds{of}")
    reason = F.when(late(0), "domain_cap").when(late(1), "job_domain_cap").when(late(2), "job_cap")
    return out.withColumn("reason", reason).select(*passed.columns)


def _limits(rows: DataFrame, top: Column) -> DataFrame:
    """(kind, key, level, left, binds): the limits that could bind, given how many rows there are: how much is left of each, and `_SPENT` where nothing is."""
    domains = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.max("_root_used").alias("used"), F.array_distinct(F.array_append(F.collect_set("level"), top)).alias("levels"))  # levels: one a job at most
    domains = domains.select(F.lit("domain").alias("kind"), F.col("root").alias("key"), F.explode("levels").alias("level"), "n", "used")
    jobs = rows.filter("pages is not null").groupBy("job").agg(F.count(F.lit(1)).alias("n"), F.max("_job_used").alias("used"), F.max("pages").alias("level"))
    all_ = domains.union(jobs.select(F.lit("job"), "job", "level", "n", "used")).withColumn("left", F.col("level") - F.col("used"))
    return all_.filter("n > left").select("kind", "key", "level", "left", F.when(F.col("left") <= 0, _SPENT).cast("long").alias("binds"))


def _accepted(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """The rows that no limit of their domain and job has bound before."""
    domains = limits.filter("kind = 'domain' and binds is not null").select(F.col("key").alias("root"), "level", F.col("binds").alias("_d"))
    jobs = limits.filter("kind = 'job' and binds is not null").select(F.col("key").alias("job"), F.col("binds").alias("_j"))
    met = rows.join(domains, ["root", "level"], "left").join(jobs, "job", "left")
    return met.filter((F.col("_d").isNull() | (F.col("seq") <= F.col("_d"))) & (F.col("_j").isNull() | (F.col("seq") <= F.col("_j"))))


def admit(edges: DataFrame, jobs: DataFrame, pages: Known = None, seen: Known = None, options: Admission = Admission(), shared_domains: bool | None = None, used: DataFrame | None = None, kept: list | None = None) -> DataFrame:
    """Every edge with url_norm, root, kind and reason; null reason: admitted. `shared_domains` chooses the budget fold (None: looked up).

    `used` (root, job_id, n) is what earlier batches accepted. The screened rows are persisted, as three branches read them; `kept` gets
    them, so that the caller can unpersist them.
    """
    rows = screened(edges, jobs, pages, seen, options, kept).persist(StorageLevel.MEMORY_AND_DISK)
    if kept is not None:
        kept.append(rows)
    passed = rows.filter("reason is null")
    if shared_domains is None:
        shared_domains = bool(passed.select("root", "job_id").distinct().groupBy("root").count().filter("count > 1").limit(1).count())
    done = greedy_budget(passed, options, used) if shared_domains else one_job_budget(passed, options, used)
    return rows.filter("reason is not null").unionByName(done)


def tasks(admitted: DataFrame, options: Admission = Admission()) -> DataFrame:
    """Tasks of the admitted rows; media tasks carry where they come from and the job's license."""
    media = F.struct(F.lit("discovered").alias("source"), stable_id(F.col("url_norm")).alias("source_id"), F.col("default_license").alias("license"), F.col("source_url").alias("origin_page_url"), F.col("source_url").alias("discovered_from_url"))
    rows = admitted.filter("reason is null")
    return rows.select(F.col("url_norm").alias("url"), "job_id", "depth", F.lit(options.priority).alias("priority"), F.col("source_url").alias("discovered_from"), "kind", F.when(F.col("kind") != "Page", media).alias("media"))


def counters(edges: DataFrame, admitted: DataFrame) -> DataFrame:
    """urls_discovered and urls_deduped of a batch."""
    found = admitted.agg(F.count(F.lit(1)).alias("urls_discovered"), F.count_if(F.col("reason").isin("dup_in_batch", "seen", "already_crawled")).alias("urls_deduped"), F.count_if(F.col("reason").isNull()).alias("tasks"))
    return found


def seed_tasks(seeds: DataFrame, job_id: str) -> DataFrame:
    """Tasks of valid seeds: priority 100, depth 0."""
    rows = seeds.withColumn("_u", url_parts("url")).filter("_u.norm is not null")
    return rows.select(F.col("_u.norm").alias("url"), F.lit(job_id).alias("job_id"), F.lit(0).alias("depth"), F.lit(100).alias("priority"), F.lit(None).cast("string").alias("discovered_from"), F.lit("Page").alias("kind"))


def page_edges(pages: DataFrame) -> DataFrame:
    """One edge per different link of a page: (url, source_url, job_id, depth + 1). Page links come first, then those of harvested sitemaps
    and feeds, then audio, video, documents and feed enclosures, each in order; list columns that `pages` lacks give none."""
    lists = [F.col(c) for c in ("links", "discovered", "audio", "video", "docs", "enclosures") if c in pages.columns]
    out = pages.select(F.col("url").alias("source_url"), "job_id", (F.col("depth") + 1).alias("depth"), F.posexplode(ordered_distinct(*lists)).alias("position", "link"))
    return out.withColumnRenamed("link", "url")
