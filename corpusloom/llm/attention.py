"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. A passage is described by shares (letter case, digits, symbols, word
lengths, repeats and others) and a signed hash projection of its words, and encoded by a learned layer. Gated attention
weighs the passages, and the weighted sum of their codes is classified (Ilse et al. 2018). Labels belong to documents alone;
which passages matter is learned.

Parameters are fitted on at most TRAIN labelled documents, chosen by a hash of the id. Every passage of every
document is encoded and scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fit_in_one_task, remainder, sample
from .textkernel import Block, blocks, settled

PASSAGE = 50
HASHED = 16
SHARES = 16
WIDTH = SHARES + HASHED
CODE, GATE = 16, 8
TRAIN = 5000
EPOCHS = 12

_KINDS = np.zeros((256, 8), dtype=bool)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".,;:", b"\n", b"=\"'()[]{}/\\_~^@+", bytes(range(128, 256)))):
    _KINDS[list(_chars), _k] = True


def passages(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages and the first passage of each row; a row without words has one passage of zeros."""
    n_rows, counts = block.last - block.first, block.n_words
    number = np.maximum(1, -(-counts // PASSAGE))
    first = np.concatenate([[0], np.cumsum(number)])
    n, words = int(first[-1]), len(block.starts)
    place = np.arange(words) - np.repeat(block.rows[:-1], counts)
    owner = np.repeat(first[:-1], counts) + place // PASSAGE
    out = np.zeros((n, WIDTH))
    if not words:
        return out, first
    size = np.bincount(owner, minlength=n).astype(np.float64)
    lengths = (block.ends - block.starts).astype(np.float64)
    chars = np.bincount(owner, weights=lengths, minlength=n)
    some, many = np.maximum(size, 1), np.maximum(chars, 1)
    ends = np.append(block.starts[1:], len(block.data))
    for k in range(8):
        total = np.concatenate([[0], np.cumsum(_KINDS[:, k][block.data])])
        out[:, k] = np.bincount(owner, weights=(total[ends] - total[block.starts]).astype(np.float64), minlength=n) / many
    out[:, 5] *= 5
    out[:, 8] = chars / some / 10
    out[:, 9] = np.sqrt(np.maximum(0, np.bincount(owner, weights=lengths**2, minlength=n) / some - (chars / some) ** 2)) / 10
    out[:, 10] = np.bincount(owner, weights=lengths <= 3, minlength=n) / some
    out[:, 11] = np.bincount(owner, weights=lengths == 1, minlength=n) / some
    h = block.hashes()
    order = np.lexsort((h, owner))
    new = np.ones(words, dtype=bool)
    new[1:] = (owner[order][1:] != owner[order][:-1]) | (h[order][1:] != h[order][:-1])
    out[:, 12] = np.bincount(owner[order], weights=new, minlength=n) / some
    again = np.zeros(words)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    out[:, 13] = np.bincount(owner, weights=again, minlength=n) / some
    out[:, 14] = size / PASSAGE
    out[:, 15] = np.log1p(np.repeat(counts, number)) / 10
    sign = ((h >> np.uint64(32)) & np.uint64(1)).astype(np.float64) * 2 - 1
    slot = owner * HASHED + (h & np.uint64(HASHED - 1)).astype(np.int64)
    out[:, SHARES:] = np.bincount(slot, weights=sign, minlength=n * HASHED).reshape(n, HASHED) / np.sqrt(some)[:, None] / 4
    return out, first


_SHAPES = [("mean", (WIDTH,)), ("scale", (WIDTH,)), ("E", (WIDTH, CODE)), ("e", (CODE,)), ("V", (CODE, GATE)), ("U", (CODE, GATE)), ("w", (GATE,)), ("c", (CODE,)), ("b", (1,))]


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    size = sum(int(np.prod(s)) for _, s in _SHAPES)
    flat = np.concatenate([flat, np.zeros(max(0, size - len(flat)))])
    for name, shape in _SHAPES:
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape).copy()
        at += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def forward(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray):
    """Scores of bags, and what the gradient needs. Bag i has the passages first[i]..first[i + 1]."""
    h = np.tanh(((x - p["mean"]) * p["scale"]) @ p["E"] + p["e"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    a = (t * g) @ p["w"]
    bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
    a = np.exp(a - np.maximum.reduceat(a, first[:-1])[bag])
    a /= np.add.reduceat(a, first[:-1])[bag]
    z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
    return _sigmoid(z @ p["c"] + p["b"][0]), (h, t, g, a, z, bag)


def gradient(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean log loss."""
    score, (h, t, g, a, z, bag) = forward(p, x, first)
    d = (score - y) / len(y)
    dz = d[:, None] * p["c"]
    da = (dz[bag] * h).sum(axis=1)
    ds = a * (da - np.add.reduceat(a * da, first[:-1])[bag])
    dt, dg = ds[:, None] * g * p["w"] * (1 - t * t), ds[:, None] * t * p["w"] * g * (1 - g)
    dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
    return {"E": ((x - p["mean"]) * p["scale"]).T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (ds[:, None] * t * g).sum(0), "c": z.T @ d, "b": np.array([d.sum()])}


def train(labels: np.ndarray, bags: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.01, decay: float = 1e-4, batch: int = 64, seed: int = 5) -> np.ndarray:
    """Adam over mini-batches of bags; all parameters as one vector."""
    p = unpack(np.zeros(1))
    if not len(labels):
        return np.concatenate([p[k].ravel() for k, _ in _SHAPES])
    rng = np.random.default_rng(seed)
    bags = [b.reshape(-1, WIDTH).astype(np.float64) for b in bags]
    everything = np.concatenate(bags)
    p["mean"], p["scale"] = everything.mean(0), 1 / (everything.std(0) + 0.05)
    for name, shape in _SHAPES[2:]:
        if len(shape) == 2:
            p[name] = rng.standard_normal(shape) / np.sqrt(shape[0])
    p["w"], p["c"] = rng.standard_normal(GATE) / np.sqrt(GATE), rng.standard_normal(CODE) / np.sqrt(CODE)
    names = [k for k, _ in _SHAPES[2:]]
    m, v, step = {k: np.zeros_like(p[k]) for k in names}, {k: np.zeros_like(p[k]) for k in names}, 0
    for epoch in range(epochs):
        order, pace = rng.permutation(len(bags)), rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in own])])
            grads = gradient(p, np.concatenate([bags[i] for i in own]), first, labels[own].astype(np.float64))
            step += 1
            for k in names:
                g = grads[k] + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return np.concatenate([p[k].ravel() for k, _ in _SHAPES])


def fit(docs: DataFrame, labels: DataFrame, label: str, allowed, limit: int = TRAIN) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                x, first = passages(block)
                own = batch.slice(block.first, block.last - block.first)
                lists = pa.ListArray.from_arrays(pa.array((first * WIDTH).astype(np.int32)), pa.array(x.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), lists], names=["order", "label", "features"])

    rows = sample(docs, labels, label, allowed, limit).mapInArrow(settled(run), "order long, label int, features array<float>")
    return fit_in_one_task(rows, train)


def score(docs: DataFrame, flat: np.ndarray, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`carry`, score and attention, the largest weight of a passage."""
    shared = docs.sparkSession.sparkContext.broadcast(flat)
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = unpack(shared.value)
        for batch in batches:
            total, top = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for block in blocks(batch.column(batch.num_columns - 1)):
                x, first = passages(block)
                found, state = forward(p, x, first)
                total[block.first : block.last] = found
                top[block.first : block.last] = np.maximum.reduceat(state[3], first[:-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(total), pa.array(top)], names=[*carry, "score", "attention"])

    schema = "".join(f"`{c}` {fields[c]}, " for c in carry) + "score double, attention double"
    return docs.select(*carry, F.col(text).alias("_text")).mapInArrow(settled(run), schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, held_out, score, predicted, attention.

    Labels are learned only from rows whose crc32(doc_id as text) mod `modulus` is not `held`; a null doc_id is held out. Null and
    empty texts are one passage of zeros. With no label at all every score is 0.5. Repeated rows are scored each; an empty
    table gives an empty result; a score that equals the threshold counts as label 1. Other columns are ignored.
    """
    flat = fit(docs, labels, label, remainder("doc_id", modulus) != held)
    scored = score(docs.select("doc_id", "text"), flat)
    out = F.coalesce(remainder("doc_id", modulus) == held, F.lit(True))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "attention")
