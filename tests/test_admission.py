import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import topic_relevant
from corpusloom.operators import admission, policy
from corpusloom.plans.options import Admission

JOB = "id string, status string, max_depth int, max_pages long, max_pages_per_domain long, allowed_domains array<string>, include_patterns array<string>, exclude_patterns array<string>, follow_external_links boolean, default_license string, seeds array<string>"
EDGE = "url string, source_url string, job_id string, depth int, seq long"


def job(id_="j", status="Running", depth=2, pages=None, per=None, allowed=(), include=(), exclude=(), follow=True, license_=None, seeds=()):
    return (id_, status, depth, pages, per, list(allowed), list(include), list(exclude), follow, license_, list(seeds))


def reasons(spark, edges, jobs, pages=None, seen=None, **options):
    e = spark.createDataFrame([(u, "https://s.com", j, d, k) for k, (u, j, d) in enumerate(edges)], EDGE)
    rows = admission.admit(e, spark.createDataFrame(jobs, JOB), pages, seen, Admission(**options))
    return [r.reason for r in rows.orderBy("seq").collect()]


def test_every_reason(spark):
    jobs = [job("a", depth=2, exclude=["/admin"], include=[], pages=100), job("p", status="Paused"), job("l", allowed=["EXAMPLE.COM"]), job("x", follow=False, seeds=["https://www.example.com/start", "not a url"]), job("i", include=["/blog/"])]
    pages = spark.createDataFrame([("example.com", "a", "https://example.com/old")], "domain string, job_id string, url string")
    seen = spark.createDataFrame([("https://example.com/seen",)], "url_norm string")
    edges = [("https://example.com/2", "a", 2), ("https://example.com/3", "a", 3), ("http://127.0.0.1/", "a", 0), ("example.com/2#x", "a", 1), ("https://example.com/p", "p", 0), ("https://www.example.com/l", "l", 0), ("https://other.com/l", "l", 0), ("https://sub.example.com/x", "x", 0), ("https://other.com/x", "x", 0), ("https://example.com/seen", "a", 0), ("https://example.com/old", "a", 0), ("https://example.com/s.mp3", "a", 0), ("https://example.com/admin/1", "a", 0), ("https://example.com/blog/1", "i", 0), ("https://example.com/news", "i", 0), ("https://free.com/", "absent", 99)]
    assert reasons(spark, edges, jobs, pages, seen) == [None, "job_policy", "invalid_or_unsafe", "dup_in_batch", "job_not_running", None, "job_policy", None, "external_link", "seen", "already_crawled", "no_license", "job_policy", None, "job_policy", None]


def test_tasks(spark):
    e = spark.createDataFrame([("https://a.com/s.mp3", "https://a.com/p", "j", 1, 0), ("https://a.com/q", "https://a.com/p", "j", 1, 1)], EDGE)
    rows = admission.admit(e, spark.createDataFrame([job(license_="cc-by")], JOB))
    got = {r.url: r for r in admission.tasks(rows).collect()}
    media = got["https://a.com/s.mp3"].media
    assert (media.source, media.license, media.origin_page_url) == ("discovered", "cc-by", "https://a.com/p") and got["https://a.com/q"].media is None
    assert admission.counters(e, rows).first().tasks == 2
    seeds = admission.seed_tasks(spark.createDataFrame([("example.com/",), ("http://10.0.0.1",)], "url string"), "j").collect()
    assert [(s.url, s.priority, s.depth) for s in seeds] == [("https://example.com", 100, 0)]


def greedy(rows, global_cap):
    domains, jobs, out = {}, {}, []
    for root, j, per, most in rows:
        d, n = domains.get(root, 0), jobs.get(j, 0)
        if d >= global_cap:
            out.append("domain_cap")
        elif per is not None and d >= per:
            out.append("job_domain_cap")
        elif most is not None and n >= most:
            out.append("job_cap")
        else:
            out.append(None)
            domains[root], jobs[j] = d + 1, n + 1
    return out


def test_budgets_equal_the_greedy_loop(spark):
    rng = random.Random(3)
    schema = "root string, job_id string, max_pages_per_domain long, max_pages long, seq long, reason string"
    limits = {"a": (3, 12), "b": (None, 9), "c": (5, None)}
    many = [(rng.choice("vwxyz"), j, *limits[j]) for j in (rng.choice("abc") for _ in range(80))]
    df = spark.createDataFrame([(*r, k, None) for k, r in enumerate(many)], schema)
    assert [r.reason for r in admission.greedy_budget(df, Admission(global_domain_cap=7)).orderBy("seq").collect()] == greedy(many, 7)
    one = [(rng.choice("vwxyz"), "a", *limits["a"]) for _ in range(40)]
    df = spark.createDataFrame([(*r, k, None) for k, r in enumerate(one)], schema)
    assert [r.reason for r in admission.one_job_budget(df, Admission(global_domain_cap=7)).orderBy("seq").collect()] == greedy(one, 7)


@pytest.mark.parametrize("seed", range(2))
def test_shared_budgets_over_ranges_equal_the_greedy_loop(spark, seed):
    """Random jobs and domains, one domain with most rows, few ranges, limits that earlier batches have partly or wholly used."""
    rng = random.Random(seed)
    jobs = {f"j{k}": (rng.choice([None, 2, 4, 9]), rng.choice([None, 6, 15, 25])) for k in range(4)} | {None: (None, 5)}
    many = [(rng.choice(["hot"] * 6 + list("vwxyz") + [None]), j, *jobs[j]) for j in (rng.choice(list(jobs)) for _ in range(160))]
    spent = [("hot", "j0", 2), ("v", "j1", 9), ("w", "j2", 1)] if seed else []
    df = spark.createDataFrame([(*r, 7 * k, None) for k, r in enumerate(many)], "root string, job_id string, max_pages_per_domain long, max_pages long, seq long, reason string")
    used = spark.createDataFrame(spent, "root string, job_id string, n long") if spent else None
    domains, taken, expected = {}, {}, []
    for root, j, n in spent:
        domains[root], taken[j] = domains.get(root, 0) + n, taken.get(j, 0) + n
    for root, j, per, most in many:
        d, n = domains.get(root, 0), taken.get(j, 0)
        why = "domain_cap" if d >= 11 else "job_domain_cap" if per is not None and d >= per else "job_cap" if most is not None and n >= most else None
        if why is None:
            domains[root], taken[j] = d + 1, n + 1
        expected.append(why)
    got = admission.greedy_budget(df, Admission(global_domain_cap=11), used, ranges=5)
    assert [r.reason for r in got.orderBy("seq").collect()] == expected


def test_budgets_are_found_without_a_task_for_a_job(spark):
    """A job and a domain with all rows: what a window sorts is a range of them."""
    df = spark.range(4000).selectExpr("'d' AS root", "'j' AS job_id", "bigint(null) AS max_pages_per_domain", "bigint(1500) AS max_pages", "id * 3 AS seq", "string(null) AS reason")
    place = df.withColumn("at", admission.place(df, "seq", 20)).groupBy("at").count().agg(F.max("count"), F.count("*")).first()
    assert place[0] <= 400 and place[1] >= 18
    for budget in (admission.greedy_budget, admission.one_job_budget):
        got = budget(df, Admission(global_domain_cap=1200), ranges=20)
        assert got.filter("reason is null").agg(F.count("*"), F.max("seq")).first()[:] == (1200, 3597) and got.filter("reason = 'domain_cap'").count() == 2800


def test_payloads(spark):
    rows = [('[{"url":"a","source_url":"s","job_id":"j","depth":1},{"url":"b"}]',), ('{"url":"c","job_id":"j"}',), ("nope",), ("[]",)]
    got = [r.e for r in spark.createDataFrame(rows, "v string").select(admission.decode_edges(F.col("v")).alias("e")).collect()]
    assert [None if e is None else [x.url for x in e] for e in got] == [["a", "b"], ["c"], None, []]


def test_seed_roots(spark):
    jobs = spark.createDataFrame([job("a", follow=False, seeds=["https://www.example.com/start", "not a url", "http://b.example.com"]), job("b", follow=True, seeds=["https://x.com"])], JOB)
    assert {r.id: r.seed_roots for r in policy.with_seed_roots(jobs).collect()} == {"a": ["example.com"], "b": None}
    quoted = spark.createDataFrame([(" 'Example.com' ",)], "s string").select(F.array("s").alias("seed_roots"), F.lit(False).alias("follow_external_links"), F.array().cast("array<string>").alias("allowed_domains"))
    assert [list(r) for r in quoted.select(policy.external_allowed(F.lit("example.com"), F.lit(True)), policy.external_allowed(F.lit("unknown"), F.lit(True)), policy.external_allowed(F.lit("z.com"), F.lit(False))).collect()] == [[True, False, True]]
    assert topic_relevant is not None
