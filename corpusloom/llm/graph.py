"""Links and connected components as DataFrames."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernel import settled

#: Edges that a task contracts at a time.
EDGES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset a folder of the warehouse. The latter holds for a session of
    one process alone (tests); on a cluster an unset folder is an error."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known.rstrip("/")


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Frames made within it (a select will do) delete their shuffle files as soon as an action's result is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage ends there, and a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def salted_join(left: DataFrame, right: DataFrame, key: str | list[str], spread: str, count: str, total: int, parts: int = 512, salts: int = 64) -> DataFrame:
    """Left join on a key that few rows of `right` may share with very many of `left`.

    `right` has one row for each key with the number of its rows in `left` in column `count`, whose sum is
    `total`. At most `parts` keys can have total / parts rows; only those are broadcast, as a bare list, to
    tell `left` which keys are hot. Rows with a hot key are dealt over `salts` tasks by a hash of `spread`;
    the hot rows of `right` are repeated for each.
    """
    least = max(2, -(-total // parts))
    keys = [key] if isinstance(key, str) else key
    hot = right.filter(F.col(count) >= least).select(*[F.col(k).alias(f"_hot{i}") for i, k in enumerate(keys)], F.lit(True).alias("_hot"))
    same = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_hot{i}") for i, k in enumerate(keys)])
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    dealt = left.join(F.broadcast(hot), same, "left").withColumn("_salt", salt).drop("_hot", *[f"_hot{i}" for i in range(len(keys))])
    copies = F.when(F.col(count) >= least, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.withColumn("_salt", F.explode(copies)).drop(count)
    return dealt.join(repeated, [*keys, "_salt"], "left").drop("_salt")


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b): stars (a, b) about the smallest nodes that connect the same, for up to EDGES rows at a time."""

    def solve(edges: np.ndarray) -> pa.RecordBatch:
        nodes, place = np.unique(edges, return_inverse=True)
        a, b = place.reshape(edges.shape)
        up = np.arange(len(nodes))
        while len(a):
            x, y = up[a], up[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(above := up[up], up):
                up = above
        own = np.flatnonzero(up != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[up[own]])], names=["a", "b"])

    held, count = [], 0
    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
        count += batch.num_rows
        if count >= EDGES:
            yield solve(np.concatenate(held, axis=1))
            held, count = [], 0
    if count:
        yield solve(np.concatenate(held, axis=1))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable node of each node that has an edge: (node, component), both long.

    `edges` has long columns src and dst. Each round replaces every edge by edges to the smallest neighbour,
    first among the larger neighbours and then among the smaller ones, until only stars are left
    (large-star and small-star, Kiveris et al. 2014). Minima are aggregated before they are shuffled, so no
    task gathers the neighbours of a node. Before each round a task contracts the edges that it holds to
    stars, which saves most rounds and, with them, jobs and files.
    """
    local = lambda df: df.mapInArrow(settled(contracted), "a long, b long")
    found = keep(local(local(edges.filter("src <> dst").select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"))).distinct()))
    for _ in range(rounds):
        if _stars(found):
            break
        both = found.select(F.col("a").alias("u"), F.col("b").alias("v")).union(found.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        found = large.join(small, "a").select(F.explode(ends).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        found = keep(local(found))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = found.select(F.col("b").alias("node")).distinct()
    return found.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most and no node with one is itself such a neighbour."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    with tidy(edges.sparkSession):
        return not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up > 0 and down > 0").limit(1).count()
