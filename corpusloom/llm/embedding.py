"""Near-duplicate vectors by a forest of random-projection trees with spill.

Each tree splits its space again and again along a random direction at the sample's median; vectors
within a margin of the split go to both sides. Vectors that share a leaf of any tree are compared by
cosine in double precision, and links at or above the threshold are united.

The directions and medians are fitted on a bounded sample (SAMPLE vectors); every vector is indexed.
A leaf over `BLOCK` vectors is cut into blocks and every two blocks meet. A pair is counted in the
smallest leaf that both vectors are in, so links are counted once without listing all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, keep, salted_join
from .textkernel import settled

SAMPLE = 16384
BLOCK = 1000


@dataclass
class Tree:
    """Inner nodes in heap order: children of i are 2i + 1 and 2i + 2; the leaves follow."""

    depth: int
    directions: np.ndarray
    cuts: np.ndarray


def fit_forest(sample: np.ndarray, n: int, trees: int, leaf: int, seed: int) -> list[Tree]:
    """Trees over unit vectors, deep enough that n vectors leave about `leaf` in each leaf, as far as the sample lasts (16 a leaf)."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
    depth = min(depth, int(np.log2(max(1, len(sample) / 16))))
    out = []
    for _ in range(trees):
        inner = (1 << depth) - 1
        directions = rng.standard_normal((inner, dims))
        directions /= np.linalg.norm(directions, axis=1, keepdims=True)
        cuts, held = np.zeros(inner), {0: np.arange(len(sample))}
        for i in range(inner):
            own = held.pop(i)
            at = sample[own] @ directions[i]
            cuts[i] = np.median(at) if len(own) else 0.0
            held[2 * i + 1], held[2 * i + 2] = own[at <= cuts[i]], own[at > cuts[i]]
        out.append(Tree(depth, directions, cuts))
    return out


def assign(tree: Tree, vectors: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, leaf) of all leaves that each vector reaches."""
    level = [(0, np.arange(len(vectors)))]
    for _ in range(tree.depth):
        below = []
        for node, rows in level:
            at = vectors[rows] @ tree.directions[node]
            below.append((2 * node + 1, rows[at <= tree.cuts[node] + margin]))
            below.append((2 * node + 2, rows[at > tree.cuts[node] - margin]))
        level = [(k, r) for k, r in below if len(r)]
    first = (1 << tree.depth) - 1
    rows = np.concatenate([r for _, r in level]) if level else np.zeros(0, dtype=np.int64)
    leaves = np.concatenate([np.full(len(r), k - first) for k, r in level]) if level else np.zeros(0, dtype=np.int64)
    return rows, leaves


def unit(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision."""
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _index(forest: list[Tree], margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                cut = batch.slice(start, 2000)
                vectors = unit(_matrix(cut.column(1)))
                rows, leaves = [], []
                for t, tree in enumerate(forest):
                    r, leaf = assign(tree, vectors, margin)
                    rows.append(r)
                    leaves.append(leaf + (t << 24))
                rows, leaves = np.concatenate(rows), np.concatenate(leaves)
                order = np.lexsort((leaves, rows))
                rows, leaves = rows[order], leaves[order]
                ends = np.searchsorted(rows, np.arange(len(vectors) + 1))
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), cut.column(2), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaves, pa.int32()))], names=["id", "vector", "n", "leaves"])

    return run


def _spread(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the first row of its component."""
    root = np.arange(len(linked))
    free = linked.any(axis=1)
    for i in range(len(linked)):
        if not free[i]:
            continue
        front = linked[i].copy()
        front[i] = True
        seen = front.copy()
        while front.any():
            front = linked[front].any(axis=0) & ~seen
            seen |= front
        root[seen] = i
        free &= ~seen
    return root


def _compare(threshold: float):
    """Rows sorted by (leaf, x, y): for each vector with links counted in the group (id, number of linked rows, root)."""

    def solve(leaf: int, x: int, y: int, ids: np.ndarray, vectors: np.ndarray, n: np.ndarray, leaves: list, block: np.ndarray):
        v = unit(vectors)
        linked = v @ v.T >= threshold
        np.fill_diagonal(linked, False)
        if x != y:
            linked &= block[:, None] != block[None, :]
        rows = np.flatnonzero(linked.any(axis=1))
        if not len(rows):
            return None
        linked = linked[np.ix_(rows, rows)]
        lengths = np.array([len(leaves[r]) for r in rows])
        flat = np.concatenate([leaves[r] for r in rows])
        who = np.repeat(np.arange(len(rows)), lengths)
        earlier = flat < leaf
        names, col = np.unique(flat[earlier], return_inverse=True)
        member = np.zeros((len(rows), len(names)), dtype=np.float32)
        member[who[earlier], col] = 1
        linked &= ~((member @ member.T) > 0)
        count = linked @ n[rows].astype(np.int64)
        root = _spread(linked)
        some = np.flatnonzero(linked.any(axis=1))
        return ids[rows[some]], count[some], ids[rows[root[some]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def out(table: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a < 2:
                    continue
                own = table.slice(a, b - a).combine_chunks()
                col = [own.column(k).combine_chunks() if isinstance(own.column(k), pa.ChunkedArray) else own.column(k) for k in range(own.num_columns)]
                col = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in col]
                num = lambda k: col[k].to_numpy(zero_copy_only=False)
                found = solve(int(num(0)[0]), int(num(1)[0]), int(num(2)[0]), num(3), _matrix(col[4]), num(5), col[6].to_numpy(zero_copy_only=False), num(7))
                if found is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["id", "links", "root"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if rest is not None and rest.num_rows:
                table = pa.concat_tables([rest, table])
            keys = [table.column(k).to_numpy() for k in range(3)]
            change = np.zeros(table.num_rows, dtype=bool)
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            cuts = [0, *np.flatnonzero(change).tolist()]
            yield from out(table, cuts)
            rest = table.slice(cuts[-1])
        if rest is not None:
            yield from out(rest, [0, rest.num_rows])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, trees: int = 6, leaf: int = 1000, spill: float = 0.5, seed: int = 17) -> DataFrame:
    """One row per row of `vectors`: id_col, n_links, component_id, kept.

    n_links counts the other rows linked directly (cosine >= threshold), component_id is the smallest id reachable over
    links, kept says that this is the row's own id. Vectors that are null, empty, zero or hold null or non-finite
    components, and vectors of unlike lengths, link with nothing. Equal vectors are one node; each repeated row counts
    as a vector, and rows that share an id but not a vector are vectors of their own. A row
    with a null id links with nothing and has a null component_id and kept = false. The margin of a split is
    `spill` times the deviation that a pair at the threshold has along a random direction. An empty table gives an
    empty result; other columns are ignored.
    """
    rows = keep(vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector).alias("_v")))
    sound = F.col("_id").isNotNull() & F.col("_v").isNotNull() & (F.size("_v") > 0)
    finite = ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("_v", lambda x: x != 0)
    nodes = keep(rows.filter(sound).filter(finite).groupBy("_v").agg(F.min("_id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("node", F.monotonically_increasing_id()))
    found = None
    for dims, n in sorted((r[0], r[1]) for r in nodes.groupBy(F.size("_v")).count().collect()):
        own = nodes.filter(F.size("_v") == dims).select(F.col("node").alias("id"), F.col("_v").alias("vector"), "n")
        sample = own.select("vector").orderBy(F.xxhash64("vector"), "id").limit(SAMPLE).toArrow().column(0).combine_chunks()
        sample = sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample
        forest = fit_forest(unit(_matrix(sample)), n, trees, leaf, seed)
        margin = spill * float(np.sqrt(max(0.0, 2 - 2 * threshold))) / float(np.sqrt(dims))
        kind = nodes.schema["_v"].dataType.simpleString()
        indexed = keep(own.mapInArrow(settled(_index(forest, margin)), f"id long, vector {kind}, n long, leaves array<int>"))
        sizes = indexed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count()
        size = {r[0]: r[1] for r in sizes.filter(f"count > {BLOCK}").collect()}  # at most 2 ** depth leaves a tree
        large = F.create_map(*[F.lit(x) for kv in size.items() for x in kv]) if size else None
        some = indexed.select(F.explode("leaves").alias("leaf"), "id", "vector", "n", "leaves")
        cut = F.ceil(F.coalesce(large[F.col("leaf")], F.lit(1)) / BLOCK).cast("int") if size else F.lit(1)
        block = F.pmod(F.xxhash64("id"), cut).cast("int")
        meets = F.transform(F.sequence(F.lit(0), cut - 1), lambda o: F.struct(F.least(o, block).alias("x"), F.greatest(o, block).alias("y")))
        dealt = some.select("leaf", F.explode(meets).alias("m"), "id", "vector", "n", "leaves", block.alias("block"))
        groups = dealt.select("leaf", "m.x", "m.y", "id", "vector", "n", "leaves", "block").repartition("leaf", "x", "y").sortWithinPartitions("leaf", "x", "y")
        part = groups.mapInArrow(settled(_compare(threshold)), "id long, links long, root long")
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.col("_id").isNotNull().alias("kept"))
    found = keep(found)
    counts = found.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links"))
    joined = keep(components(found.select(F.col("id").alias("src"), F.col("root").alias("dst"))))
    least = nodes.join(joined, "node").groupBy("component").agg(F.min("id").alias("least"))
    labels = nodes.join(counts, "node", "left").join(joined.join(least, "component").select("node", "least"), "node", "left")
    labels = labels.select("_v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("least", "id").alias("component"), "n")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    out = salted_join(rows, labels, "_v", "_id", "n", total)
    known = F.col("_id").isNotNull()
    component = F.when(known, F.coalesce("component", "_id"))
    return out.select(F.col("_id").alias(id_col), F.when(known, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
  r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.c = l.a),
  k AS (SELECT id, min(c) AS c FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, k.c AS component_id, vec_id = k.c AS kept FROM embeddings JOIN k ON vec_id = id LEFT JOIN n ON vec_id = a
"""
