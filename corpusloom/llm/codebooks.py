"""Vector code compression: product quantisation with integer codebooks.

Components become integers, vectors are cut into equal parts, and each part position has a codebook. In each round every part goes to
the nearest entry of its codebook and the entries become the floored means of their parts. A kd-tree for each codebook is broadcast in
each round (`parts * entries` points, whatever the table's size); tasks search it and add up integers, so a round shuffles one row for
each task, part and entry at most, and the result is the same in any order of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import keep, salted_join
from .textkernel import settled
from .vectors import matrix, sound

LEAF = 4
ROWS = 4096


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in double precision; beyond a limit, at which a sum of squared distances over all components still fits 63 bits, the limit."""
    limit = float(1 << (30 - (max(1, values.shape[1]) - 1).bit_length() // 2 - 1))
    with np.errstate(over="ignore"):
        return np.floor(np.clip(values.astype(np.float64) * scale, -limit, limit)).astype(np.int64)


@dataclass
class Node:
    """A box around points; either two children, divided at `cut` of `axis`, or a leaf with the points' numbers in ascending order."""

    low: np.ndarray
    high: np.ndarray
    points: np.ndarray
    axis: int = 0
    cut: int = 0
    below: list[Node] = field(default_factory=list)


def tree(points: np.ndarray) -> Node:
    """kd-tree over integer points, halved along the widest side of the box; equal points may be on both sides of a cut."""

    def grow(own: np.ndarray) -> Node:
        low, high = points[own].min(axis=0), points[own].max(axis=0)
        node = Node(low, high, np.sort(own))
        if len(own) > LEAF:
            node.axis = int(np.argmax(high - low))
            order = own[np.argsort(points[own, node.axis], kind="stable")]
            half = len(own) // 2
            node.cut = int(points[order[half - 1], node.axis])
            node.below = [grow(order[:half]), grow(order[half:])]
        return node

    return grow(np.arange(len(points)))


def nearest(root: Node, points: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the point nearest to each row of x, the lower number on ties.

    Each row first goes down to one leaf, which gives a good distance; then the tree is walked for all rows at once, and a node keeps
    the rows whose distance to its box is not above their best so far. Equal bounds are visited, so a lower number at the same distance is found.
    """
    best, who = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(points))

    def look(node: Node, rows: np.ndarray) -> None:
        gaps = x[rows][:, None, :] - points[node.points][None, :, :]
        far = (gaps * gaps).sum(axis=2)
        at = far.argmin(axis=1)
        far, number = far[np.arange(len(rows)), at], node.points[at]
        won = (far < best[rows]) | ((far == best[rows]) & (number < who[rows]))
        best[rows[won]], who[rows[won]] = far[won], number[won]

    todo = [(root, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if not node.below:
            look(node, rows)
            continue
        left = x[rows, node.axis] <= node.cut
        todo += [(node.below[0], rows[left]), (node.below[1], rows[~left])]
    todo = [(root, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        own = x[rows]
        out = np.maximum(np.maximum(node.low - own, own - node.high), 0)
        rows = rows[(out * out).sum(axis=1) <= best[rows]]
        if not len(rows):
            continue
        if node.below:
            todo += [(b, rows) for b in node.below]
        else:
            look(node, rows)
    return who, best


@dataclass
class Codebooks:
    """entries[part, entry, position], integers of `scale` times the components."""

    entries: np.ndarray
    scale: int

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def trees(self) -> list[Node]:
        return [tree(e) for e in self.entries]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes (rows, parts) stand for: the entries, in the middle of their integer cells."""
        found = self.entries[np.arange(self.entries.shape[0])[None, :], codes].reshape(len(codes), -1)
        return (found + 0.5) / self.scale


def assigned(books: np.ndarray, trees: list[Node], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, parts) and the squared distance of each row summed over its parts."""
    parts, _, width = books.shape
    codes, error = np.empty((len(x), parts), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    for p in range(parts):
        codes[:, p], far = nearest(trees[p], books[p], x[:, p * width : (p + 1) * width])
        error += far
    return codes, error


def _sums(held, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = held.value
        parts, entries, width = books.shape
        count, total = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                x = integers(matrix(batch.column(0).slice(start, ROWS), parts * width), scale)
                codes, _ = assigned(books, trees, x)
                for p in range(parts):
                    count[p] += np.bincount(codes[:, p], minlength=entries)
                    np.add.at(total[p], codes[:, p], x[:, p * width : (p + 1) * width])
        part, entry = np.nonzero(count)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry])] + [pa.array(total[part, entry, i]) for i in range(width)], names=["part", "entry", "n", *[f"s{i}" for i in range(width)]])

    return run


def fit(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks | None:
    """Codebooks of a table; None if no vector can be cut into parts.

    Each codebook starts as that part of the vectors of the `entries` smallest ids (ties by the vector, a null id last). `rounds` times every
    part goes to its nearest entry and each entry becomes the componentwise floor of its parts' mean; entries without a part stay.
    """
    spark = vectors.sparkSession
    usable = vectors.filter(sound(vector)).filter((F.size(vector) > 0) & (F.size(vector) % parts == 0)).select(F.col(id_col).cast("long").alias("_id"), F.col(vector).alias("_v"))
    seeds = usable.withColumn("_width", F.size("_v")).orderBy(F.col("_id").asc_nulls_last(), "_v").limit(entries).collect()
    if not seeds:
        return None
    dims = seeds[0]["_width"]
    first = integers(np.array([r["_v"] for r in seeds if r["_width"] == dims], dtype=np.float64), scale)
    books = first.reshape(len(first), parts, dims // parts).transpose(1, 0, 2).copy()
    own = usable.filter(F.size("_v") == dims).select("_v")
    width = dims // parts
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((books, [tree(e) for e in books]))
        shape = ", ".join(["part int", "entry int", "n long", *[f"s{i} long" for i in range(width)]])
        sums = own.mapInArrow(settled(_sums(held, scale)), shape).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col(f"s{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)])
        books = books.copy()
        for r in sums.collect():  # at most parts * entries rows
            books[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
        held.destroy()
    return Codebooks(books, scale)


def _encode(held, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = held.value
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                cut = batch.slice(start, ROWS)
                codes, error = assigned(books, trees, integers(matrix(cut.column(2), books.shape[0] * books.shape[2]), scale))
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(codes.astype(np.uint8).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), packed, pa.array(error)], names=["_id", "_label", "code", "error"])

    return run


def encode(vectors: DataFrame, books: Codebooks | None, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(_id, _label, code binary with one byte a part, error) of every sound vector; code and error are null where the length is not the codebooks'."""
    named = vectors.filter(sound(vector)).select(F.col(id_col).cast("long").alias("_id"), F.col(label).alias("_label"), F.col(vector).alias("_v"))
    unlike = named.select("_id", "_label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    if books is None:
        return unlike
    held = vectors.sparkSession.sparkContext.broadcast((books.entries, books.trees()))
    fits = F.size("_v") == books.width
    kind = named.schema["_label"].dataType.simpleString()
    done = named.filter(fits).mapInArrow(settled(_encode(held, books.scale)), f"_id long, _label {kind}, code binary, error long")
    return done.union(unlike.filter(~fits))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """One row for each sound vector: id_col, code (two hex digits a part), error, label_error, codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components go. `error` is the squared distance of the integer vector from its
    entries; `label_error` its sum over equal labels, null labels together, null beyond a long. The codebooks have the length of the vector
    with the smallest id whose length is a positive multiple of `parts`; a vector of another length has a null code and error. Repeated rows are coded each
    and count each; equal ids are told apart by their vectors where they start a codebook. Components over 2^26 / scale or so (by the length) count as that.
    An empty table gives an empty result; other columns are ignored. The table is read `rounds` + 2 times. At most 256 entries.
    """
    books = fit(vectors, id_col, vector, parts, entries, rounds, scale)
    missing = F.lit("0").cast(vectors.schema[label].dataType)
    coded = keep(encode(vectors, books, id_col, vector, label).select("_id", F.col("_label").isNull().alias("_none"), F.coalesce("_label", missing).alias("_label"), "code", "error"))
    sums = keep(coded.groupBy("_none", "_label").agg(F.expr("try_sum(error)").alias("label_error"), F.count(F.lit(1)).alias("_n")))
    total = sums.agg(F.sum("_n")).first()[0] or 0
    out = salted_join(coded, sums, ["_none", "_label"], "_id", "_n", total)
    return out.select(F.col("_id").alias(id_col), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


_NEAREST = """SELECT vec_id, p, q, arg_min(e, far * 64 + e) AS e, min(far) AS far FROM (
    SELECT x.vec_id, x.p, x.q, b.e, list_sum(list_transform(range(1, len(x.q) + 1), lambda i: (x.q[i] - b.q[i]) * (x.q[i] - b.q[i])))::BIGINT AS far FROM x JOIN {books} b USING (p)) GROUP BY ALL"""
_MOVED = """SELECT b.p, b.e, CASE WHEN n.q IS NULL THEN b.q ELSE n.q END AS q FROM {books} b LEFT JOIN (
    SELECT p, e, list(floor_div ORDER BY i) AS q FROM (SELECT p, e, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS floor_div FROM (
        SELECT p, e, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM {found}, (SELECT unnest(range(1, 5)) AS i) GROUP BY ALL)) GROUP BY ALL) n USING (p, e)"""

#: For vectors of 64 components, 16 parts and 64 entries.
ORACLE = f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
  x AS MATERIALIZED (SELECT vec_id, p, q[4 * p + 1 : 4 * p + 4] AS q FROM v, (SELECT unnest(range(16)) AS p)),
  b0 AS MATERIALIZED (SELECT p, e, q FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT 64) USING (vec_id)),
  f0 AS MATERIALIZED ({_NEAREST.format(books="b0")}), b1 AS MATERIALIZED ({_MOVED.format(books="b0", found="f0")}),
  f1 AS MATERIALIZED ({_NEAREST.format(books="b1")}), b2 AS MATERIALIZED ({_MOVED.format(books="b1", found="f1")}),
  f2 AS MATERIALIZED ({_NEAREST.format(books="b2")}),
  r AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM f2 GROUP BY vec_id),
  s AS (SELECT label, sum(error)::BIGINT AS label_error FROM r JOIN v USING (vec_id) GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM r JOIN v USING (vec_id) JOIN s ON v.label IS NOT DISTINCT FROM s.label
"""
