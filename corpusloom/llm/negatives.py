"""Hard-negative mining by distributed radix selection.

Anchors are a stated part of the rows; their scores against all rows are integer inner products, made block against block: a task holds
one block of windows and one block of rows, both of bounded size. A window is a range of scores of one anchor over rows of the same or of
other labels, of which the first k by (score descending, id) are wanted.

The kth score of each window is found digit by digit. In a round each tile counts its scores of the window's range in buckets of the next
digit and sends the buckets up to its own kth score, at most k counts; the true kth score lies no further, so the sums over tiles
locate its bucket, which is the next round's range. When the score is known, tiles send the rows at or above it, at most k each by the full
order, and a rank over these gives the result. No task gathers the rows of a window.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import keep
from .vectors import block_count, matrix, meeting, numbers, sound

#: Bits of a digit of the selection.
DIGIT = 9
#: Rows of a block of the table, and anchors of a block.
ROWS, LEAST_ROWS, ANCHORS = 16384, 1024, 1024
#: Rows scored at a time in a task.
STEP = 1024
#: Integer components beyond this count as this, so that inner products fit 63 bits.
LIMIT = 1 << 24
LAST = (1 << 63) - 1


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a with those of b: by doubles where these are exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def first_buckets(window: np.ndarray, bucket: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, bucket, count) of the buckets up to the one in which a window's count reaches k; n: what each place counts."""
    key, at = np.unique(window * (1 << DIGIT) + bucket, return_inverse=True)
    total = np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)
    window, bucket = key >> DIGIT, key & ((1 << DIGIT) - 1)
    before = np.cumsum(total) - total
    some = before - before[np.searchsorted(window, window)] < k
    return window[some], bucket[some], total[some]


def first_rows(window: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each window by (score descending, id, row)."""
    order = np.lexsort((row, ids, -score, window))
    own = window[order]
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    return order[rank < k]


class Tile:
    """Windows of a block of anchors against the rows of a block, some rows at a time."""

    def __init__(self, windows: pa.Table, rows: pa.Table, same: bool):
        width = windows.column("dims")[0].as_py()
        self.same, self.rows, self.width = same, rows, width
        anchor = numbers(windows.column("anchor"))
        self.names, first, at = np.unique(anchor, return_index=True, return_inverse=True)
        self.vectors = matrix(windows.column("v"), width)[first]
        self.labels = numbers(windows.column("label"))[first]
        self.low, self.high, self.shift = (numbers(windows.column(c)) for c in ("low", "high", "shift"))
        order = np.argsort(at, kind="stable")
        place = np.arange(len(at)) - np.searchsorted(at[order], at[order])
        #: slots[anchor, j]: number of the anchor's jth window, or -1
        self.slots = np.full((len(self.names), int(place.max(initial=0)) + 1), -1)
        self.slots[at[order], place] = order
        least, most = np.full(len(self.names), LAST), np.full(len(self.names), -LAST)
        np.minimum.at(least, at, self.low)
        np.maximum.at(most, at, self.high)
        self.least, self.most = least[:, None], most[:, None]

    def hits(self):
        """(window, score, row): all rows in the range of each window, in pieces."""
        own, labels, vectors = (numbers(self.rows.column("uid")), numbers(self.rows.column("label")), matrix(self.rows.column("v"), self.width))
        for start in range(0, len(own), STEP):
            cut = slice(start, start + STEP)
            found = scores(self.vectors, vectors[cut])
            fits = (found >= self.least) & (found <= self.most) & ((labels[cut][None, :] == self.labels[:, None]) == self.same)
            if self.same:
                fits &= own[cut][None, :] != self.names[:, None]
            anchor, at = np.nonzero(fits)
            score = found[anchor, at]
            for j in range(self.slots.shape[1]):
                window = self.slots[anchor, j]
                some = window >= 0
                some &= (score >= self.low[window]) & (score <= self.high[window])
                yield window[some], score[some], at[some] + start


def _count(k: int, same: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(windows: pa.Table, rows: pa.Table) -> pa.Table:
        window, bucket, n = (np.zeros(0, dtype=np.int64) for _ in range(3))
        if windows.num_rows and rows.num_rows:
            tile = Tile(windows, rows, same)
            for w, score, _ in tile.hits():
                found = (w, (tile.high[w] - score) >> tile.shift[w], np.ones(len(w), dtype=np.int64))
                window, bucket, n = first_buckets(*(np.concatenate(x) for x in zip((window, bucket, n), found, strict=True)), k)
        name = numbers(windows.column("window"))[window] if len(window) else window
        return pa.table({"window": pa.array(name, pa.int64()), "bucket": pa.array(bucket, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def _gather(k: int, same: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(windows: pa.Table, rows: pa.Table) -> pa.Table:
        window, score, row = (np.zeros(0, dtype=np.int64) for _ in range(3))
        if windows.num_rows and rows.num_rows:
            ids = numbers(rows.column("id"), LAST)
            for found in Tile(windows, rows, same).hits():
                window, score, row = (np.concatenate(x) for x in zip((window, score, row), found, strict=True))
                best = first_rows(window, score, ids[row], row, k)
                window, score, row = window[best], score[best], row[best]
        take = pa.array(row, pa.int64())
        name = numbers(windows.column("window"))[window] if len(window) else window
        return pa.table({"window": pa.array(name, pa.int64()), "uid": rows.column("uid").take(take), "id": rows.column("id").take(take), "score": pa.array(score, pa.int64())})

    return run


def _tiles(windows: DataFrame, rows: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], shape: str, blocks: int, others: int) -> DataFrame:
    left = meeting(windows.select("window", "anchor", "dims", "label", "v", "low", "high", "shift"), "a", "b", "anchor", others, blocks)
    right = meeting(rows.select("uid", "id", "dims", "label", "v"), "b", "a", "uid", blocks, others)
    key = ["dims", "a", "b"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, shape)


def select_first(windows: DataFrame, rows: DataFrame, k: int, same: bool, blocks: int, others: int) -> DataFrame:
    """(window, uid, id, score, rank): the first k rows of each window by (score descending, id, uid), or all, if fewer.

    `windows`: window, anchor, dims, label, v, low, high; `rows`: uid, id, dims, label, v. Neither the ranges' width nor ties change what
    a task holds.
    """
    windows = windows.filter("low <= high").withColumn("top", F.col("high")).withColumn("need", F.lit(k).cast("long"))
    widest = windows.agg(F.max(F.col("high").cast("decimal(20,0)") - F.col("low"))).first()[0]
    bits = int(widest or 0).bit_length()
    while bits > 0:
        bits = max(0, bits - DIGIT)
        shift = F.lit(bits).cast("long")
        counts = _tiles(windows.withColumn("shift", shift), rows, _count(k, same), "window long, bucket long, n long", blocks, others)
        counts = counts.groupBy("window", "bucket").agg(F.sum("n").alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("window").orderBy("bucket")))  # at most k buckets a tile
        need = windows.select("window", "need")
        reached = upto.join(need, "window").filter("upto >= need").groupBy("window").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("at"))
        step = F.lit(1 << bits).cast("long")
        joined = windows.join(reached, "window", "left")
        high = F.col("high") - F.col("at.bucket") * step
        low = F.greatest(F.col("low"), high - step + 1)
        # a window with fewer rows than it needs takes all of them: it is done, as one whose score is known
        joined = joined.select("window", "anchor", "dims", "label", "v", "top", F.coalesce(low, "low").alias("low"), F.when(F.col("at").isNull(), F.col("low")).otherwise(high).alias("high"), F.when(F.col("at").isNull(), 0).otherwise(F.col("need") - F.col("at.before")).cast("long").alias("need"))
        windows = keep(joined)
    final = windows.select("window", "anchor", "dims", "label", "v", "low", F.col("top").alias("high"), F.lit(0).cast("long").alias("shift"))
    found = _tiles(final, rows, _gather(k, same), "window long, uid long, id long, score long", blocks, others)
    rank = F.row_number().over(Window.partitionBy("window").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "uid"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of which `anchor` is true.

    Components become floor(scale * x); a score is the integer inner product. An anchor's positives are its first `positives` other rows of
    its label by (score descending, id); the negatives of a positive are the first `negatives` rows of other labels whose score is from `low` to `high`
    hundredths of the positive's score. Rows with a null label, a null vector or null or non-finite components take no part; a null id comes last on
    ties and is no anchor. Rows that share an id are rows of their own, and a repeated row is its copy's positive. Vectors of unlike lengths have no score with each other. A positive below
    zero has no negatives; anchors without positives or negatives give no rows. Components over 2^24 / scale count as that. An empty table gives an
    empty result; other columns are ignored.
    """
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * scale))).cast("int"))
    named = vectors.filter(sound(vector) & F.col(label).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("v"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    squares = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
    rows = keep(named.withColumn("asks", F.col("asks") & F.col("id").isNotNull()).withColumn("dims", F.size("v")).withColumn("norm", F.sqrt(squares.cast("double"))).withColumn("uid", F.monotonically_increasing_id()))
    n, asked, longest = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.max("norm")).first()
    blocks, others = block_count(n, LEAST_ROWS, ROWS, vectors.sparkSession.sparkContext.defaultParallelism), max(1, -(-asked // ANCHORS))
    anchors = rows.filter("asks").select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"), "dims", "label", "v", "norm")
    reach = F.ceil(F.col("norm") * F.lit(float(longest or 0)) * 1.000001).cast("long") + 1  # no inner product is larger
    around = anchors.select(F.col("anchor").alias("window"), "anchor", "dims", "label", "v", (-reach).alias("low"), reach.alias("high"))
    near = select_first(around, rows, positives, True, blocks, others).select(F.col("window").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # hundredths of a score of zero or more, without products that leave 64 bits
    least = F.expr("positive_score div 100") * low + F.expr(f"(positive_score % 100 * {low} + 99) div 100")
    most = F.expr("positive_score div 100") * high + F.expr(f"(positive_score % 100 * {high}) div 100")
    pairs = keep(near.filter("positive_score >= 0").join(anchors, "anchor").select(F.monotonically_increasing_id().alias("window"), "anchor", "anchor_id", "positive_id", "positive_score", "dims", "label", "v", least.alias("low"), most.alias("high")))
    found = select_first(pairs.drop("anchor_id", "positive_id", "positive_score"), rows, negatives, False, blocks, others)
    named = found.select("window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs.select("window", "anchor_id", "positive_id", "positive_score"), "window")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
  s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
  p AS MATERIALIZED (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INTEGER AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) <= 3
"""
