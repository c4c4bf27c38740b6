"""Nearest neighbours by vantage-point trees, one for each shard.

Rows are dealt to shards of bounded size by a hash; each shard's tree is one row of an index table. A search brings every block of queries to
every shard (a stated query set against all rows, in blocks) and ranks the shards' answers. Within a tree a child is left out if the triangle inequality shows
that its points are further than the kth nearest so far; the bound is multiplied by `relax` first, so a factor above one leaves out more and one is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import keep
from .textkernel import settled
from .vectors import block_count, block_of, matrix, numbers, sound

#: Vectors of a shard and components of a shard at most; queries of a block.
SHARD, LEAST_SHARD, COMPONENTS, QUERIES = 16384, 1024, 1 << 22, 2048
LEAF = 64
LAST = (1 << 63) - 1
TREE = "dims int, shard int, uids array<long>, ids array<long>, vectors array<double>, vantage array<int>, inner array<int>, outer array<int>, bounds array<double>, start array<int>, stop array<int>"


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean norms of rows, components added one after the other."""
    total = np.zeros(x.shape[:-1])
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(x.shape[-1]):
            total += x[..., j] * x[..., j]
        return np.sqrt(total)


class Tree:
    """Arrays over nodes: the vantage point, the children (-1: a leaf), the least and greatest distance of either child's points from the vantage point, and a leaf's points.

    Points lie in the order of the leaves, so a leaf is points[start:stop].
    """

    def __init__(self, points: np.ndarray, vantage, inner, outer, bounds, start, stop):
        self.points, self.bounds = points, np.asarray(bounds, dtype=np.float64).reshape(-1, 4)
        self.vantage, self.inner, self.outer, self.start, self.stop = (np.asarray(x, dtype=np.int32) for x in (vantage, inner, outer, start, stop))

    @staticmethod
    def grown(points: np.ndarray, seed: int) -> tuple[Tree, np.ndarray]:
        """A tree over the points and their order in it. The vantage point is the one of a few whose distances to some others vary most; half of the points are near it."""
        rng = np.random.default_rng(seed)
        vantage, inner, outer, bounds, start, stop, order = [], [], [], [], [], [], []

        def node() -> int:
            for x, empty in ((vantage, -1), (inner, -1), (outer, -1), (start, 0), (stop, 0)):
                x.append(empty)
            bounds.append([0.0] * 4)
            return len(vantage) - 1

        todo = [(node(), np.arange(len(points)))]
        placed = 0
        while todo:
            at, own = todo.pop()
            if len(own) <= LEAF:
                order.append(own)
                start[at], stop[at] = placed, placed + len(own)
                placed += len(own)
                continue
            some, others = rng.choice(own, 6), rng.choice(own, 48)
            with np.errstate(over="ignore", invalid="ignore"):
                spread = [np.nan_to_num(lengths(points[others] - points[p]).std()) for p in some]
            vantage[at] = int(some[int(np.argmax(spread))])
            far = lengths(points[own] - points[vantage[at]])
            by = np.argsort(far, kind="stable")
            near, rest = by[: len(by) // 2], by[len(by) // 2 :]
            bounds[at] = [far[near].min(), far[near].max(), far[rest].min(), far[rest].max()]
            inner[at], outer[at] = node(), node()
            todo += [(outer[at], own[rest]), (inner[at], own[near])]
        order = np.concatenate(order)
        place = np.empty(len(points), dtype=np.int64)
        place[order] = np.arange(len(points))
        vantage = [int(place[v]) if v >= 0 else -1 for v in vantage]
        return Tree(points[order], vantage, inner, outer, bounds, start, stop), order


class Search:
    """The k nearest points of a tree for many queries at once; `looked` counts the distances to points of leaves."""

    def __init__(self, tree: Tree, ids: np.ndarray, uids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, relax: float):
        self.tree, self.ids, self.uids, self.queries, self.own, self.k, self.relax = tree, ids, uids, queries, own, k, relax
        self.far = np.full((len(queries), k), np.nan)  # nan: no point yet; sorted last
        self.at = np.full((len(queries), k), -1)
        self.looked = 0
        with np.errstate(over="ignore", invalid="ignore"):
            self.q2, self.p2 = (queries * queries).sum(axis=1), (tree.points * tree.points).sum(axis=1)

    def leaf(self, node: int, rows: np.ndarray) -> None:
        """Compare with the points of a leaf: a fast product tells which may be among the nearest, those are measured exactly."""
        first, last = int(self.tree.start[node]), int(self.tree.stop[node])
        points, bound = self.tree.points[first:last], self.far[rows, -1]
        self.looked += len(rows) * len(points)
        scale = self.q2[rows][:, None] + self.p2[first:last][None, :]
        rough = scale - 2 * (self.queries[rows] @ points.T)
        fits = ~(rough > (bound * bound)[:, None] + 1e-12 * scale) & (self.uids[first:last][None, :] != self.own[rows][:, None])
        q, p = np.nonzero(fits)
        if not len(q):
            return
        exact = lengths(self.queries[rows[q]] - points[p])
        some = ~(exact > bound[q])
        q, p, exact = q[some], p[some], exact[some]
        touched, which = np.unique(q, return_inverse=True)
        if not len(touched):
            return
        rows = rows[touched]
        who = np.concatenate([np.repeat(np.arange(len(rows)), self.k), which])
        far = np.concatenate([self.far[rows].ravel(), exact])
        at = np.concatenate([self.at[rows].ravel(), first + p])
        order = np.lexsort((self.uids[at], np.where(at < 0, LAST, self.ids[at]), at < 0, far, who))
        rank = np.arange(len(order)) - np.searchsorted(who[order], who[order])
        best = order[rank < self.k]
        self.far[rows], self.at[rows] = far[best].reshape(-1, self.k), at[best].reshape(-1, self.k)

    def run(self) -> None:
        tree, home = self.tree, np.full(len(self.queries), -1)
        with np.errstate(over="ignore", invalid="ignore"):
            todo = [(0, np.arange(len(self.queries)))]
            while todo:  # to one leaf each, for a first bound
                node, rows = todo.pop()
                if not len(rows):
                    continue
                if tree.inner[node] < 0:
                    home[rows] = node
                    self.leaf(node, rows)
                    continue
                far = lengths(self.queries[rows] - tree.points[tree.vantage[node]])
                near = far <= (tree.bounds[node, 1] + tree.bounds[node, 2]) / 2
                todo += [(int(tree.inner[node]), rows[near]), (int(tree.outer[node]), rows[~near])]
            todo = [(0, np.arange(len(self.queries)), np.zeros(len(self.queries)))]
            while todo:
                node, rows, least = todo.pop()
                # equal bounds are visited: ties go to the smaller id
                some = ~(least * self.relax > self.far[rows, -1] * (1 + 1e-12))
                rows, least = rows[some], least[some]
                if not len(rows):
                    continue
                if tree.inner[node] < 0:
                    rows = rows[home[rows] != node]
                    if len(rows):
                        self.leaf(node, rows)
                    continue
                far = lengths(self.queries[rows] - tree.points[tree.vantage[node]])
                low, high, low2, high2 = tree.bounds[node]
                gap = lambda a, b: np.maximum(least, np.maximum(a - far, far - b) - 1e-12 * (far + b))  # noqa: E731,B023
                todo += [(int(tree.outer[node]), rows, gap(low2, high2)), (int(tree.inner[node]), rows, gap(low, high))]


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rest: pa.Table | None = None

    def row(table: pa.Table) -> pa.RecordBatch:
        dims, shard = table.column("dims")[0].as_py(), table.column("shard")[0].as_py()
        points = matrix(table.column("v"), dims).astype(np.float64)
        tree, order = Tree.grown(points, shard)
        order = pa.array(order)
        one = {"dims": dims, "shard": shard, "uids": table.column("uid").take(order).to_pylist(), "ids": table.column("id").take(order).to_pylist(), "vectors": tree.points.ravel(), "bounds": tree.bounds.ravel()}
        one |= {c: getattr(tree, c) for c in ("vantage", "inner", "outer", "start", "stop")}
        kinds = {"dims": pa.int32(), "shard": pa.int32(), "uids": pa.list_(pa.int64()), "ids": pa.list_(pa.int64()), "vectors": pa.list_(pa.float64()), "bounds": pa.list_(pa.float64())}
        names = [c.split()[0] for c in TREE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([one[c]], kinds.get(c, pa.list_(pa.int32()))) for c in names], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        dims, shard = (numbers(table.column(c)) for c in ("dims", "shard"))
        cuts = [0, *(np.flatnonzero((dims[1:] != dims[:-1]) | (shard[1:] != shard[:-1])) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield row(table.slice(a, b - a).combine_chunks())
        rest = table.slice(cuts[-1])
    if rest is not None:
        yield row(rest.combine_chunks())


def _search(k: int, relax: float):
    def run(trees: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        for i in range(trees.num_rows if queries.num_rows else 0):
            one = {c: trees.column(c)[i].values for c in ("uids", "ids", "vectors", "vantage", "inner", "outer", "bounds", "start", "stop")}
            dims = trees.column("dims")[i].as_py()
            tree = Tree(one["vectors"].to_numpy().reshape(-1, dims), *(one[c].to_numpy() for c in ("vantage", "inner", "outer", "bounds", "start", "stop")))
            uids, ids = one["uids"].to_numpy(), numbers(one["ids"], LAST)
            asked = numbers(queries.column("query"))
            search = Search(tree, ids, uids, matrix(queries.column("v"), dims).astype(np.float64), asked, k, relax)
            search.run()
            q, j = np.nonzero(search.at >= 0)
            at = search.at[q, j]
            for x, y in zip(out, (pa.array(asked[q]), pa.array(uids[at]), one["ids"].take(pa.array(at)), pa.array(search.far[q, j])), strict=True):
                x.append(y)
        kinds = {"query": pa.int64(), "uid": pa.int64(), "id": pa.int64(), "score": pa.float64()}
        return pa.table({c: pa.chunked_array(x, kind) for (c, kind), x in zip(kinds.items(), out, strict=True)})

    return run


class Index:
    """Trees over the sound, non-zero vectors of a table: `rows` (uid, id, dims, v) and `trees`, one row for each shard, both in the shared folder."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", also: Column | None = None):
        """Vectors that are null, empty, zero or hold null or non-finite components are left out; `also` is kept as column `asks` of the rows."""
        usable = sound(vector) & F.exists(vector, lambda x: x != 0)
        named = vectors.filter(usable).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(also if also is not None else F.lit(False), F.lit(False)).alias("asks"))
        self.rows = keep(named.withColumn("dims", F.size("v")).withColumn("uid", F.monotonically_increasing_id()))
        n, widest = self.rows.agg(F.count(F.lit(1)), F.max("dims")).first()
        most = max(1, min(SHARD, COMPONENTS // max(1, widest or 1)))
        self.shards = block_count(n, min(most, LEAST_SHARD), most, vectors.sparkSession.sparkContext.defaultParallelism)
        dealt = self.rows.select("uid", "id", "dims", "v", block_of("uid", self.shards).alias("shard")).repartition("dims", "shard").sortWithinPartitions("dims", "shard")
        self.trees = keep(dealt.select("uid", "id", "v", "dims", "shard").mapInArrow(settled(_build), TREE))

    def search(self, queries: DataFrame, k: int = 10, relax: float = 1.0) -> DataFrame:
        """(query, uid, id, score, rank): the k nearest rows of the index for each of `queries` (query long, dims, v), nearest first, ties to the smaller id, a null id last.

        A row whose uid is the query's own number is no candidate. Vectors of other lengths are none either. `relax` of one is exact; above one, a child of a tree is
        left out although its bound is up to that factor below the kth nearest.
        """
        asked = queries.agg(F.count(F.lit(1))).first()[0]
        blocks = max(1, -(-asked // QUERIES))
        left = self.trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = queries.select("query", "dims", "v", block_of("query", blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1))).alias("shard"))
        key = ["dims", "shard", "block"]
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_search(k, relax), "query long, uid long, id long, score double")
        rank = F.row_number().over(Window.partitionBy("query").orderBy("score", F.col("id").asc_nulls_last(), "uid"))  # at most k rows a shard
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def neighbours(vectors: DataFrame, asks: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 10, relax: float = 1.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows, by Euclidean distance in double precision, of each row for which `asks` is true.

    Nearest first, ties to the smaller id; all candidates, if fewer than k. Vectors that are null, empty, zero or hold null or non-finite components take no
    part. A row with a null id is a candidate, last on ties, and no query. Rows that share an id are rows of their own, each a query and a candidate for the other. Vectors of
    unlike lengths are no candidates for each other. An empty table gives an empty result; other columns are ignored.
    """
    index = Index(vectors, id_col, vector, asks & F.col(id_col).isNotNull())
    queries = index.rows.filter("asks").select(F.col("uid").alias("query"), "id", "dims", "v")
    found = index.search(queries.select("query", "dims", "v"), k, relax)
    named = found.select("query", "rank", F.col("id").alias("_found"), "score").join(queries.select("query", F.col("id").alias("_asked")), "query")
    return named.select(F.col("_asked").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("_found").alias(id_col), "score")


ORACLE = """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  d AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - v.e[i]) * (q.e[i] - v.e[i])), lambda a, b: a + b)) AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM d
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""
