"""Mixing sources to target weights.

Each document gets a hash-random key, made of its id and text. Documents are ordered by key within their source: the key space
is cut into ranges, token counts are summed per (source, range), a running sum over the ranges gives each
range its start, and a running sum within a range gives each document its start. A source whose target is beyond its
size is taken in whole epochs first; the rest is cut at the document boundary nearest to the budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import keep

WORD_GAP = r"[\x20\x09-\x0D]+"
#: Hex digits of the key that name its range: 16 ** RANGE_DIGITS ranges for each source.
RANGE_DIGITS = 3


def n_words(text) -> F.Column:
    """Words of a text, that is maximal runs outside 0x20 and 0x09-0x0D; null has none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WORD_GAP))).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2) -> dict[str | None, float]:
    """Target of each source: `share` of all sizes by weight, at most `epochs` times the source's size, the excess reshared by weight.

    Sources take the weights in turn, by code point with null last. The result is min(epochs * size, rate * weight) with the
    one rate that spends the whole share.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    rows = [(s, epochs * n, weights[k % len(weights)]) for k, (s, n) in enumerate(order)]
    budget, room = share * sum(n for _, n in sizes), sum(w for _, _, w in rows)
    capped, rate = 0, 0.0
    for _, cap, weight in sorted(rows, key=lambda x: (x[1] / x[2], x[0] is None, x[0] or "")):
        rate = (budget - capped) / room
        if rate * weight <= cap:
            break
        capped, room = capped + cap, room - weight
        rate = float("inf")
    return {s: float(min(cap, rate * weight)) for s, cap, weight in rows}


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """All columns of `docs` and _size, _source_size, _target, _copies (how often the mix takes the document).

    A null source is a source of its own, the last in order; a null text has size 0. Ties of the key (repeated ids) are
    broken by size and text hash, and rows equal in all of these are interchangeable. Empty documents are taken as
    often as their place says, with 0 words. Columns of `docs` with
    these names, or that begin with _mix_, are replaced. An empty table gives an empty result. The size of a source is the only thing
    collected, one number for each source.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("_mix_") or c in ("_size", "_source_size", "_target", "_copies")])
    # The text is in the key, so that rows without an id are spread like any others.
    key = F.md5(F.concat_ws("/", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))
    rows = docs.withColumn("_size", n_words(F.col(text))).withColumn("_mix_key", key).withColumn("_mix_range", F.substring(key, 1, RANGE_DIGITS)).withColumn("_mix_hash", F.xxhash64(text))
    ranges = keep(rows.groupBy(F.col(source).alias("_mix_s"), F.col("_mix_range").alias("_mix_r")).agg(F.sum("_size").alias("_mix_n")))
    sums = [(r[0], r[1]) for r in ranges.groupBy("_mix_s").agg(F.sum("_mix_n")).collect()]
    wanted = targets(sums, weights, share, epochs)
    starts = ranges.withColumn("_mix_at", F.sum("_mix_n").over(Window.partitionBy("_mix_s").orderBy("_mix_r").rowsBetween(Window.unboundedPreceding, -1)))
    starts = starts.select("_mix_s", "_mix_r", F.coalesce("_mix_at", F.lit(0)).alias("_mix_at"))
    plan = docs.sparkSession.createDataFrame([(s, n, wanted[s]) for s, n in sums], "_mix_src string, _source_size long, _target double")
    starts = starts.join(F.broadcast(plan), F.col("_mix_s").eqNullSafe(F.col("_mix_src"))).drop("_mix_src")
    both = rows.join(starts, F.col(source).eqNullSafe(F.col("_mix_s")) & (F.col("_mix_range") == F.col("_mix_r")))
    within = Window.partitionBy("_mix_s", "_mix_r").orderBy("_mix_key", id_col, "_size", "_mix_hash").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_mix_at") + F.coalesce(F.sum("_size").over(within), F.lit(0))
    whole = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(0)
    placed = both.withColumn("_mix_before", before).withColumn("_mix_whole", whole.cast("int"))
    rest = F.col("_target") - F.col("_mix_whole") * F.col("_source_size")
    copies = F.col("_mix_whole") + (F.col("_mix_before") + F.col("_size") / 2.0 <= rest).cast("int")
    placed = placed.withColumn("_copies", F.least(copies, F.lit(epochs)))
    return placed.drop("_mix_key", "_mix_range", "_mix_hash", "_mix_s", "_mix_r", "_mix_at", "_mix_before", "_mix_whole")


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The documents of a mix, each as often as it is taken."""
    return mixed.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, text, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))) AS k,
             CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(2 * sum(size) AS BIGINT) AS cap,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM d GROUP BY source),
r AS (SELECT *, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS budget,
        coalesce(sum(cap) OVER before, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS room
      FROM s WINDOW before AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rate AS (SELECT max((budget - capped::DOUBLE) / room) FILTER (WHERE (budget - capped::DOUBLE) / room * w <= cap) AS rate FROM r),
t AS (SELECT source, source_size, CAST(least(cap::DOUBLE, coalesce(rate * w, cap::DOUBLE)) AS DOUBLE) AS target FROM s, rate),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * least(2, whole + CASE WHEN bef + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p
"""
