"""Running sums and maxima of a group in an order, without a task that holds the group.

The order is cut into ranges at estimated quantiles. Each range of a group is summed up first, the sums of the ranges before are carried
in by a join, and a window runs within a range alone. Any cuts give the same values, so the quantiles need not be exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import keep


def ranges_of(rows: DataFrame) -> int:
    """As many ranges as the session shuffles to, 16 at least."""
    return max(16, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def place(rows: DataFrame, order: str, ranges: int | None = None) -> Column:
    """The number of the range in which a row's `order` (a number) lies. One job finds the cuts, which are a list of literals; a row
    looks among the first of every so many cuts, then among those that follow it."""
    ranges = ranges or ranges_of(rows)
    cuts = sorted(set(rows.approxQuantile(order, [k / ranges for k in range(1, ranges)], 0.25 / ranges)))
    if not cuts:
        return F.lit(0)
    at, step = F.col(order), math.isqrt(len(cuts)) + 1
    below = lambda some: F.size(F.filter(some, lambda c: c < at))
    group = below(F.array(*[F.lit(c) for c in cuts[::step]]))  # how many groups begin below
    inside = F.slice(F.array(*[F.lit(c) for c in cuts]), (F.greatest(group, F.lit(1)) - 1) * step + 1, F.lit(step))
    return F.when(group == 0, 0).otherwise((group - 1) * step + below(inside))


def carried(rows: DataFrame, by: list[str], order: str, value: Column, out: str, how: str = "sum", at: str = "_range") -> DataFrame:
    """Adds `out`: sum or max of `value` over the rows of the same `by` up to this one. `rows` has its range in column `at`; null values are skipped, and a null
    in `by` is a group of its own."""
    fold = F.sum if how == "sum" else F.max
    named = rows.withColumn("_v", value)
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    parts = named.groupBy(*keys, F.col(at).alias("_at")).agg(fold("_v").alias("_part"))
    earlier = Window.partitionBy(*[f"_k{i}" for i in range(len(by))]).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a range
    before = parts.select(*[f"_k{i}" for i in range(len(by))], "_at", fold("_part").over(earlier).alias("_before"))
    same = F.col(at) == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    inner = fold("_v").over(Window.partitionBy(*by, at).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.coalesce(F.col("_before") + F.col("_in"), "_before", "_in") if how == "sum" else F.greatest("_before", "_in")
    joined = named.withColumn("_in", inner).join(before, same)
    return joined.withColumn(out, total).drop("_v", "_in", "_at", "_before", *[f"_k{i}" for i in range(len(by))])


def running(rows: DataFrame, by: list[str], order: str, value: Column, out: str, how: str = "sum", ranges: int | None = None) -> DataFrame:
    """`carried` over ranges made for this one scan."""
    return carried(rows.withColumn("_range", place(rows, order, ranges)), by, order, value, out, how).drop("_range")


def ranked(rows: DataFrame, by: list[str], order: list[str], out: str, ranges: int | None = None) -> DataFrame:
    """Adds `out`: the place of each row among those with its `by`, in `order`, from 1. Rows are dealt by ranges of (by, order) and written once; a range is numbered
    by itself and begins after the rows of its group in the ranges before, so a group of any size is spread."""
    dealt = keep(rows.repartitionByRange(ranges or ranges_of(rows), *by, *order).withColumn("_range", F.spark_partition_id()))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    counts = dealt.groupBy(*keys, F.col("_range").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*names).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a range
    before = counts.select(*names, "_at", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_at")
    for c, k in zip(by, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    inner = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    return dealt.withColumn("_in", inner).join(before, same).withColumn(out, F.col("_in") + F.col("_before")).drop("_range", "_in", "_at", "_before", *names)
