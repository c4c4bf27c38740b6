"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the different words, word pairs and pairs with one word between them, lower-cased and hashed to
2 ** BITS places. Each coordinate has its own learning rate; L1 keeps most weights at zero, so the weights that are
broadcast are few and their number is bounded by 2 ** BITS. (McMahan et al. 2013.)

Weights are fitted on at most TRAIN labelled documents, chosen by a hash of the id. Every document is scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fit_in_one_task, remainder, sample
from .textkernel import Block, PUNCTUATION, blocks, settled, splitmix

BITS = 20
TRAIN = 16000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 12.0, 0.1


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every word, pair and skip pair of a block, repeats included. Place 0 is kept for the constant."""
    h, row = block.hashes(), block.row_of_word()
    rows, keys = [row], [h]
    for gap, name in ((1, 0x51ED270B), (2, 0x2545F491)):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            rows.append(row[gap:][same])
            keys.append((h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] + np.uint64(name))[same])
    place = splitmix(np.concatenate(keys)) >> np.uint64(64 - BITS)
    return np.concatenate(rows), np.maximum(place, 1).astype(np.int64)


def ftrl(labels: np.ndarray, rows: list[np.ndarray], epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights after some passes over the rows, each a list of places."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at):
        own = z[at]
        out = -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        out[np.abs(own) <= l1] = 0.0
        return out

    for _ in range(epochs):
        for y, at in zip(labels, rows, strict=True):
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - y
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    return weights(np.arange(1 << BITS))


def fit(docs: DataFrame, labels: DataFrame, label: str, allowed, limit: int = TRAIN) -> np.ndarray:
    """Weights (index 0 is the constant) from at most `limit` labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2), gaps=PUNCTUATION, lowered=True):
                row, place = features(block)
                both = np.unique((row << BITS) | place)
                n = block.last - block.first
                ends = np.searchsorted(both >> BITS, np.arange(n + 1))
                flat = np.insert((both & ((1 << BITS) - 1)).astype(np.int32), ends[:-1], 0)
                lists = pa.ListArray.from_arrays(pa.array((ends + np.arange(n + 1)).astype(np.int32)), pa.array(flat))
                own = batch.slice(block.first, n)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), lists], names=["order", "label", "features"])

    rows = sample(docs, labels, label, allowed, limit).mapInArrow(settled(run), "order long, label int, features array<int>")
    return fit_in_one_task(rows, ftrl)


def score(docs: DataFrame, weights: np.ndarray, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`carry` and score, the probability of label 1. Null and empty texts get the constant's."""
    at = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weights[at]))
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS, dtype=np.float64)
        dense[shared.value[0]] = shared.value[1]
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for block in blocks(batch.column(batch.num_columns - 1), gaps=PUNCTUATION, lowered=True):
                row, place = features(block)
                some = dense[place] != 0
                both = np.unique((row[some] << BITS) | place[some])
                total[block.first : block.last] = np.bincount(both >> BITS, weights=dense[both & ((1 << BITS) - 1)], minlength=block.last - block.first)
            p = 1 / (1 + np.exp(-np.clip(total + dense[0], -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], names=[*carry, "score"])

    schema = "".join(f"`{c}` {fields[c]}, " for c in carry) + "score double"
    return docs.select(*carry, F.col(text).alias("_text")).mapInArrow(settled(run), schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held: int = 0, threshold: float = 0.5) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, held_out, score, predicted.

    Labels are learned only from rows whose crc32(doc_id as text) mod `modulus` is not `held`; a null doc_id is held out. With no
    label at all every score is 0.5. Repeated rows are scored each; an empty table gives an empty result; a score that equals
    the threshold counts as label 1. Other columns are ignored.
    """
    weights = fit(docs, labels, label, remainder("doc_id", modulus) != held)
    scored = score(docs.select("doc_id", "text"), weights)
    out = F.coalesce(remainder("doc_id", modulus) == held, F.lit(True))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
