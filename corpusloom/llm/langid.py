"""Language identification by prediction by partial matching (PPM).

For each language a context tree over bytes holds how often each byte follows each context of up to
ORDER bytes. A byte costs -log2 of its share in the longest known context; a byte not seen there costs
an escape (as often as the context has different bytes: method C) and is coded in the next shorter
context without the bytes already excluded, in the end among all bytes left. With frozen statistics
the cost depends on the last ORDER + 1 bytes alone, so the costs of all trained byte 4-grams are held in
one hash table and a text's exact code length is a sum of lookups; other 4-grams are worked
out from the trees. The language with the shortest code wins.

The trees are fitted on a bounded sample: about PER_LANG documents of each language, chosen by a hash
of doc_id. Every document is scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import blocks, settled

ORDER = 3
PER_LANG = 1500
_LETTER = regex.compile(rb"[A-Za-z]")
_ANY_LETTER = regex.compile(r"\p{L}")


class Tree:
    """Counts of one language: for each order k the known (k + 1)-grams and contexts, and what escapes cost."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams, self.counts, self.contexts, self.seen, self.kinds = [], [], [], [], []
        for k in range(ORDER + 1):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            keys, at = np.unique(grams.astype(np.uint64) & mask, return_inverse=True)
            n = np.bincount(at, weights=counts, minlength=len(keys))
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            self.grams.append(keys)
            self.counts.append(n)
            self.contexts.append(contexts)
            self.seen.append(np.bincount(of, weights=n, minlength=len(contexts)))
            self.kinds.append(np.bincount(of, minlength=len(contexts)).astype(np.float64))
        #: For each context of order k + 1: the total and the kinds left at order k once its own bytes are excluded.
        self.left, self.fresh = [], []
        for k in range(ORDER):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            below = self.counts[k][np.searchsorted(self.grams[k], self.grams[k + 1] & mask)]
            owner = np.searchsorted(self.contexts[k + 1], self.grams[k + 1] >> np.uint64(8))
            excluded = np.bincount(owner, weights=below, minlength=len(self.contexts[k + 1]))
            suffix = np.searchsorted(self.contexts[k], self.contexts[k + 1] & np.uint64((1 << 8 * k) - 1))
            self.fresh.append(self.kinds[k][suffix] - self.kinds[k + 1])
            self.left.append(self.seen[k][suffix] - excluded + self.fresh[-1])

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """Bits for the last byte of each 4-gram after its first three."""
        grams = grams.astype(np.uint64)
        bits, open_, entered = np.zeros(len(grams)), np.ones(len(grams), dtype=bool), np.zeros(len(grams), dtype=bool)
        above = np.zeros(len(grams), dtype=np.int64)
        for k in range(ORDER, -1, -1):
            context = (grams >> np.uint64(8)) & np.uint64((1 << 8 * k) - 1)
            at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            known = open_ & (self.contexts[k][at] == context)
            key = grams & np.uint64((1 << 8 * (k + 1)) - 1)
            own = np.minimum(np.searchsorted(self.grams[k], key), len(self.grams[k]) - 1)
            count = np.where(self.grams[k][own] == key, self.counts[k][own], 0.0)
            total, kinds = self.seen[k][at] + self.kinds[k][at], self.kinds[k][at]
            if k < ORDER:
                total, kinds = np.where(entered, self.left[k][above], total), np.where(entered, self.fresh[k][above], kinds)
            hit = known & (count > 0)
            miss = known & (count == 0) & (kinds > 0)
            bits[hit] += np.log2(total[hit] / count[hit])
            bits[miss] += np.log2(total[miss] / kinds[miss])
            entered |= known
            open_ &= ~hit
            above = np.where(known, at, 0)
        bits[open_] += np.log2(np.maximum(1.0, 256 - self.kinds[0][0]))
        return bits


class Model:
    """The trees of all languages and the hash table of the costs of trained 4-grams."""

    SLOTS = 20

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.trees = [Tree(*counts[x]) for x in self.langs]
        self.table = None

    def build(self) -> None:
        grams = np.unique(np.concatenate([t.grams[ORDER] for t in self.trees]))
        self.costs = np.stack([t.cost(grams) for t in self.trees]).astype(np.float32)
        self.table, rest = [], np.arange(len(grams))
        for salt in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1):
            slots = self.slot(grams[rest].astype(np.uint32), salt)
            keys, rows = np.zeros(1 << self.SLOTS, dtype=np.uint32), np.full(1 << self.SLOTS, -1, dtype=np.int32)
            rows[slots] = rest
            keys[slots] = grams[rest]
            self.table.append((salt, keys, rows))
            rest = rest[rows[slots] != rest]
            if not len(rest):
                break

    def slot(self, grams: np.ndarray, salt: int) -> np.ndarray:
        return (grams * np.uint32(salt)) >> np.uint32(32 - self.SLOTS)

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each row under each language: an array (languages, rows)."""
        if self.table is None:
            self.build()
        n, rows = len(data), len(offsets) - 1
        padded = np.full(n + ORDER * rows, 10, dtype=np.uint32)
        place = np.arange(n) + np.repeat(np.arange(1, rows + 1) * ORDER, np.diff(offsets))
        padded[place] = data
        grams = padded.copy()
        for k in range(1, ORDER + 1):
            grams[k:] |= padded[:-k] << np.uint32(8 * k)
        grams = grams[place]
        salt, keys, ids = self.table[0]
        slots = self.slot(grams, salt)
        row = np.where(keys[slots] == grams, ids[slots], -1)
        for salt, keys, ids in self.table[1:]:
            open_ = np.flatnonzero(row < 0)
            slots = self.slot(grams[open_], salt)
            row[open_] = np.where(keys[slots] == grams[open_], ids[slots], -1)
        open_ = np.flatnonzero(row < 0)
        other, at = np.unique(grams[open_], return_inverse=True)
        out = np.zeros((len(self.langs), rows))
        for k, tree in enumerate(self.trees):
            cost = self.costs[k][row]
            if len(open_):
                cost[open_] = tree.cost(other)[at]
            total = np.concatenate([[0.0], np.cumsum(cost, dtype=np.float64)])
            out[k] = total[offsets[1:]] - total[offsets[:-1]]
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for block in blocks(batch.column(1)):
            n, rows = len(block.data), block.last - block.first
            padded = np.full(n + ORDER * rows, 10, dtype=np.uint32)
            owner = np.repeat(np.arange(rows), np.diff(block.offsets))
            place = np.arange(n) + (owner + 1) * ORDER
            padded[place] = block.data
            grams = padded.copy()
            for k in range(1, ORDER + 1):
                grams[k:] |= padded[:-k] << np.uint32(8 * k)
            grams, own = grams[place], langs[block.first : block.last]
            for lang in sorted(set(own.tolist())):
                keys, counts = np.unique(grams[(own == lang)[owner]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])


def fit(rows: DataFrame, lang: str = "lang", text: str = "text", id_col: str = "doc_id", per_lang: int = PER_LANG) -> Model | None:
    """A model from rows with a language and a text; about per_lang rows of each language, chosen by a hash of the id."""
    known = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    if not sizes:
        return None
    spread = F.pmod(F.xxhash64(F.lit("ppm"), F.col(id_col)), F.lit(1 << 30))
    limit = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, per_lang / n) * (1 << 30)))])
    sample = known.filter(spread < limit[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    found = sample.mapInArrow(settled(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = {k: (g["gram"].to_numpy(np.int64), g["n"].to_numpy(np.float64)) for k, g in found.groupby("lang")}
    return Model(counts) if counts else None


def _has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or bool(_ANY_LETTER.search(text.decode("utf-8", "replace")))


def predict(docs: DataFrame, model: Model | None, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`carry`, lang_pred, score (the language's probability if all are equally likely beforehand) and bits (per byte).

    A null text, a text without a letter, and any text when there is no model get `und`, score 0 and null bits. Equal code
    lengths go to the language that sorts first.
    """
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = "".join(f"`{c}` {fields[c]}, " for c in carry) + "lang_pred string, score double, bits double"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            column, n = batch.column(batch.num_columns - 1), batch.num_rows
            lang, score, rate = np.full(n, "und", dtype=object), np.zeros(n), np.full(n, np.nan)
            for block in blocks(column) if own is not None else ():
                bits = own.bits(block.data, block.offsets)
                best = bits.argmin(axis=0)
                low = bits.min(axis=0)
                chance = 1 / np.exp2(np.maximum(low - bits, -1000)).sum(axis=0)
                for r in range(block.last - block.first):
                    a, b = block.offsets[r], block.offsets[r + 1]
                    if b > a and _has_letter(block.data[a:b].tobytes()):
                        at = block.first + r
                        lang[at], score[at], rate[at] = own.langs[best[r]], min(1.0, chance[r]), low[r] / (b - a)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(rate, from_pandas=True)], names=[*carry, "lang_pred", "score", "bits"])

    return docs.select(*carry, F.col(text).alias("_text")).mapInArrow(settled(run), schema)


def identify(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text, lang): doc_id, held_out, lang_pred, score, bits.

    Trees learn from the rows with a language and a text whose crc32(doc_id as text) mod 3 is not 1; the others are held
    out, as are rows with a null doc_id. Repeated rows are scored each; an empty table gives an empty result. Other
    columns are ignored.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    model = fit(docs.filter(~held))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits")
