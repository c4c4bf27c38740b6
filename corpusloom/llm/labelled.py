"""A bounded sample of labelled rows, and a task that fits a model on it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkernel import settled


def remainder(id_col: str, modulus: int) -> Column:
    """crc32(id as text) mod modulus."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, limit: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(order, label, text) of at most `limit` labelled documents, those with the smallest hash of the id; of rows that share an id one, the text of least hash.

    Rows with a null id or label do not count; of several labels of an id the smallest counts. The list of ids is bounded by
    `limit`, so it is broadcast.
    """
    chosen = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & allowed).groupBy(id_col).agg(F.min(label).cast("int").alias("label"))
    chosen = chosen.withColumn("order", F.xxhash64(F.lit(label), id_col)).orderBy("order", id_col).limit(limit)
    chosen = chosen.select(F.col(id_col).alias("_id"), "label", "order")
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text).alias("text"))
    found = rows.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    return found.groupBy("order", "label", "_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("order", "label", "text")


def fit_in_one_task(rows: DataFrame, train: Callable[[np.ndarray, list[np.ndarray]], np.ndarray]) -> np.ndarray:
    """Train on bounded rows (order, label, features array) in the order of `order` and return the parameters as one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, features = [], []
        for batch in batches:
            labels.append(batch.column(1).to_numpy(zero_copy_only=False))
            column = batch.column(2)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            features += [flat[a - ends[0] : b - ends[0]].copy() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        out = train(np.concatenate(labels) if labels else np.zeros(0, dtype=np.int32), features)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int64)), pa.array(out.astype(np.float64))], names=["at", "value"])

    held = rows.repartition(1).sortWithinPartitions("order").mapInArrow(settled(run), "at long, value double").filter("value <> 0 or at = 0").toArrow()
    at, value = held.column(0).to_numpy(), held.column(1).to_numpy()
    out = np.zeros(int(at.max()) + 1 if len(at) else 1)
    out[at] = value
    return out
