"""Counters, gauges and histograms over time, from long samples (ts, component, metric, le, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the two histograms (fixed values): 10 * 2^k ms and 1024 * 2^k bytes, k = 0..9.
DURATION_BOUNDS = [10.0 * 2**k for k in range(10)]
SIZE_BOUNDS = [1024.0 * 2**k for k in range(10)]
SERIES = ["component", "metric", "le"]


def histogram(rows: DataFrame, value: str, bounds: list[float], by: list[str] | None = None) -> DataFrame:
    """Cumulative bucket counts (le, n), +Inf included, from one aggregation without exploding rows."""
    by = by or []
    counts = rows.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"b{k}") for k, b in enumerate(bounds)], F.count(value).alias("all"))
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))
    return counts.select(*by, F.explode(pairs).alias("x")).select(*by, "x.le", "x.n")


def increases(samples: DataFrame, series: list[str] | None = None) -> DataFrame:
    """Adds `increase` since the series' previous sample; a counter that fell was reset and counts from zero."""
    last = F.lag("value").over(Window.partitionBy(*(series or SERIES)).orderBy("ts"))
    return samples.withColumn("increase", F.when(last.isNull(), 0.0).when(F.col("value") < last, F.col("value")).otherwise(F.col("value") - last))


def rate(samples: DataFrame, window: str = "1 minute", seconds: int = 60, by: list[str] | None = None, slide: str | None = None) -> DataFrame:
    """Sum over series of the increase per second in windows that follow one another, or that begin every `slide`."""
    keys = ["metric"] if by is None else by
    return increases(samples).groupBy(F.window("ts", window, slide or window).start.alias("window_start"), *keys).agg((F.sum("increase") / seconds).alias("rate"))


def histogram_quantile(buckets: DataFrame, q: float, by: list[str]) -> DataFrame:
    """Quantile by linear interpolation in cumulative buckets (le, n); the last finite bound when it lies beyond it."""
    rows = buckets.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("le", "n"))).alias("b"))
    total, top = F.element_at("b", -1)["n"], F.element_at("b", -2)["le"]
    rank = F.lit(q) * total
    at = F.array_position(F.transform("b", lambda x: x["n"] >= rank), True).cast("int")
    low = F.when(at > 1, F.element_at("b", F.greatest(at - 1, F.lit(1)))["le"]).otherwise(0.0)
    before = F.when(at > 1, F.element_at("b", F.greatest(at - 1, F.lit(1)))["n"]).otherwise(0)
    here = F.element_at("b", F.greatest(at, F.lit(1)))
    inside = low + (here["le"] - low) * (rank - before) / F.greatest(here["n"] - before, F.lit(1e-12))
    return rows.withColumn("quantile", F.when(total == 0, None).when(here["le"] == float("inf"), top).otherwise(inside)).drop("b")


def latest_sum(samples: DataFrame, by: list[str], series: list[str] | None = None) -> DataFrame:
    """Sum over series of each one's last value."""
    last = samples.groupBy(*(series or SERIES)).agg(F.max_by("value", "ts").alias("value"))
    return last.groupBy(*by).agg(F.sum("value").alias("value"))


def exposition(samples: DataFrame) -> DataFrame:
    """(metric, line): the last value of each series as a line of the text that scrapers read, whole numbers without a point."""
    last = samples.groupBy(*SERIES).agg(F.max_by("value", "ts").alias("value"))
    number = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    bound = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string"))
    labels = F.concat_ws(",", F.concat(F.lit('component="'), "component", F.lit('"')), F.concat(F.lit('le="'), bound, F.lit('"')))
    return last.select("metric", F.concat("metric", F.lit("{"), labels, F.lit("} "), number).alias("line"))


def held_above(series: DataFrame, threshold: float, seconds: int, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """Samples at which the value has been above the threshold for `seconds`: the alert fires there.

    Time is cut into spans of `seconds`; a sample also lies, as one that is only looked back at, in the next span, so a window
    runs within a span and a single series is spread over many tasks.
    """
    by = by or []
    keyed = series.withColumn("_t", F.col("ts").cast("timestamp").cast("long"))
    first = keyed.groupBy(*by).agg(F.min("_t").alias("_first"))
    span = F.floor(F.col("_t") / seconds)
    twice = F.explode(F.array(F.struct(span.alias("span"), F.lit(True).alias("own")), F.struct((span + 1).alias("span"), F.lit(False).alias("own"))))
    dealt = keyed.withColumn("_s", twice).select("*", F.col("_s.span").alias("_span"), F.col("_s.own").alias("_own")).drop("_s")
    low = F.min(value).over(Window.partitionBy(*by, "_span").orderBy("_t").rangeBetween(-seconds, 0))
    own = dealt.withColumn("_low", low).filter("_own")
    both = own.join(F.broadcast(first), by, "left") if by else own.crossJoin(F.broadcast(first))  # one row where there are no keys
    return both.withColumn("firing", (F.col("_low") > threshold) & (F.col("_t") - F.col("_first") >= seconds)).drop("_t", "_span", "_own", "_low", "_first")


def ratio_alert(top: Column, bottom: Column, least: float = 1e-9) -> Column:
    return top / F.greatest(bottom, F.lit(least))


def absent(samples: DataFrame, expected: DataFrame, at: Column, seconds: int) -> DataFrame:
    """Components of `expected` without an up sample in the last `seconds` before `at`."""
    alive = samples.filter((F.col("value") > 0) & (F.col("ts") > at - F.make_dt_interval(secs=F.lit(seconds))) & (F.col("ts") <= at)).select("component").distinct()
    return expected.join(alive, "component", "left_anti")
