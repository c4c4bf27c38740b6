"""Byte-level BPE encoding and decoding by the ranks of a tiktoken file.

A text is cut by the tokenizer's pattern into words; a word is the array of its bytes, in which the
adjacent pair of lowest rank is merged, the leftmost first, until no pair has a rank.

`fold` is that loop as a Spark expression: `aggregate` over the byte array of each distinct word, with the ranks as one
literal (an array of small maps, picked by a hash of the pair, since a look-up in a map literal scans its keys).
It makes the ids of the most frequent distinct words of a bounded sample, at most WORDS of them, which are broadcast.
Other distinct words are folded where they occur by the same merges over the same ranks, many words at a time and each once for a
worker's cache. Decoding concatenates the pieces of the ids.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernel import settled

RANK_FILE = "byte_bpe_50k.tiktoken"
SAMPLE_DOCS = 2000
WORDS = 20000
BUCKETS = 8192
CACHE = 150_000
#: Words over so many bytes are not folded by the Spark expression, whose work grows with the square of the length.
LONGEST = 48


@lru_cache(maxsize=1)
def load_ranks(path: str | None = None) -> dict[bytes, int]:
    with open(path or public_tokenizers.path(RANK_FILE), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """An array of BUCKETS maps from the hex digits of a piece to its rank, as one constant."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def fold(word: Column, ranks: Column) -> Column:
    """The ids of a binary word as an array of int; null if a byte has no rank."""
    never = F.lit(2**31 - 1)
    rank = lambda piece: F.try_element_at(ranks[(F.crc32(piece.cast("binary")) % BUCKETS).cast("int")], piece)
    parts = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.hex(F.substring(word, i, F.lit(1))))

    def merge(parts: Column, _: Column) -> Column:
        of_pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda j: F.coalesce(rank(F.concat(F.element_at(parts, j), F.element_at(parts, j + 1))), never))

        def apply(found: Column) -> Column:
            best = F.array_min(found)
            at = F.array_position(found, best).cast("int")
            joined = F.array(F.concat(F.element_at(parts, at), F.element_at(parts, at + 1)))
            return F.when(best == never, parts).otherwise(F.concat(F.slice(parts, F.lit(1), at - 1), joined, F.slice(parts, at + 2, F.size(parts))))

        return F.when(F.size(parts) < 2, parts).otherwise(F.transform(F.array(of_pairs), apply)[0])

    merged = F.when(F.length(word) < 2, parts).otherwise(F.aggregate(F.sequence(F.lit(2), F.length(word)), parts, merge))
    whole = rank(F.hex(word))
    ids = F.transform(merged, rank)
    return F.when(F.length(word) == 0, F.array().cast("array<int>")).when(whole.isNotNull(), F.array(whole)).otherwise(F.when(~F.exists(ids, lambda x: x.isNull()), ids))


def encode_words(words: DataFrame, ranks: dict[bytes, int], word: str = "word") -> DataFrame:
    """`words` (a binary column of distinct words) and their ids, by the fold."""
    # The literal stands in the plan once, as each mention is some MB of the driver's text of the plan.
    return words.withColumn("ids", F.transform(F.array(rank_literal(ranks)), lambda known: fold(F.col(word), known))[0])


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word; a heap of ranked pairs keeps long words near-linear."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    n = len(parts)
    before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, piece = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or parts[i] + parts[j] != piece:
            continue
        parts[i], alive[j], after[i] = piece, False, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece + parts[after[i]])) is not None:
                heapq.heappush(heap, (r, i, piece + parts[after[i]]))
        if before[i] >= 0 and (r := ranks.get(parts[before[i]] + piece)) is not None:
            heapq.heappush(heap, (r, before[i], parts[before[i]] + piece))
    return [ranks[parts[i]] for i in range(n) if alive[i]]


class Merges:
    """The same merges for many words at a time: one step merges the pair of lowest rank, the leftmost first, of every word that has one.

    A pair of ids has the rank of its bytes; all such pairs are held in a hash table of a few layers.
    """

    SLOTS = 18
    NEVER = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        found = [(ranks[piece[:i]] << 32 | ranks[piece[i:]], rank) for piece, rank in ranks.items() for i in range(1, len(piece)) if piece[:i] in ranks and piece[i:] in ranks]
        pairs, merged = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 2
        self.layers, left = [], np.arange(len(pairs))
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9):
            keys, values = np.full(1 << self.SLOTS, -1, dtype=np.int64), np.full(1 << self.SLOTS, self.NEVER, dtype=np.int32)
            at = self._slot(pairs[left], salt)
            keys[at], values[at] = pairs[left], merged[left]
            left = left[keys[at] != pairs[left]]
            self.layers.append((salt, keys, values))
            if not len(left):
                break
        self.rest = {int(pairs[k]): int(merged[k]) for k in left}

    def _slot(self, pairs: np.ndarray, salt: int) -> np.ndarray:
        return ((pairs.view(np.uint64) * np.uint64(salt)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NEVER where there is none."""
        pairs = a.astype(np.int64) << 32 | b
        out, open_ = np.full(len(pairs), self.NEVER, dtype=np.int32), np.arange(len(pairs))
        for salt, keys, values in self.layers:
            at = self._slot(pairs[open_], salt)
            hit = keys[at] == pairs[open_]
            out[open_[hit]] = values[at[hit]]
            open_ = open_[~hit & (keys[at] >= 0)]
        for k in open_.tolist() if self.rest else ():
            out[k] = self.rest.get(int(pairs[k]), self.NEVER)
        return out

    def _fold(self, words: list[bytes], width: int) -> list[list[int]]:
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(-1, width)
        if (self.bytes[raw] < 0).any():  # a byte without a rank: the plain way says which
            return [merge_word(w, self.ranks) for w in words]
        place = np.arange(width)
        ids = np.where(place < size[:, None], self.bytes[raw], -1)
        pairs = np.full((len(words), width), self.NEVER, dtype=np.int32)
        inner = place[:-1] + 1 < size[:, None]
        pairs[:, :-1][inner] = self._rank(ids[:, :-1][inner], ids[:, 1:][inner])
        out, live = ids.copy(), np.arange(len(words))
        while True:
            best = pairs.min(axis=1)
            some = best < self.NEVER
            if not some.all():
                out[live[~some]] = ids[~some]
                ids, pairs, live, best = ids[some], pairs[some], live[some], best[some]
            if not len(live):
                break
            at, rows = pairs.argmin(axis=1), np.arange(len(live))
            later = place > at[:, None]
            ids = np.take_along_axis(np.pad(ids, ((0, 0), (0, 1)), constant_values=-1), place + later, axis=1)
            ids[rows, at] = best
            pairs = np.take_along_axis(np.pad(pairs, ((0, 0), (0, 1)), constant_values=self.NEVER), place + (place >= at[:, None]), axis=1)
            for shift in (0, -1):  # the pairs that the merged piece begins and ends
                first = at + shift
                mine = np.flatnonzero((first >= 0) & (first + 1 < width))
                mine = mine[ids[mine, first[mine] + 1] >= 0]
                pairs[rows[mine], first[mine]] = self._rank(ids[mine, first[mine]], ids[mine, first[mine] + 1])
                gone = np.flatnonzero((first >= 0) & ((first + 1 >= width) | (ids[rows, np.minimum(first + 1, width - 1)] < 0)))
                pairs[gone, first[gone]] = self.NEVER
        ends = (out >= 0).sum(axis=1).tolist()
        return [row[:n] for row, n in zip(out.tolist(), ends, strict=True)]

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        found: list = [[self.ranks[w]] if w in self.ranks else None for w in words]
        for low, high in ((0, 8), (8, 16), (16, LONGEST)):
            own = [k for k, w in enumerate(words) if found[k] is None and low < len(w) <= high]
            for at in range(0, len(own), 4096):
                for k, ids in zip(own[at : at + 4096], self._fold([words[k] for k in own[at : at + 4096]], high), strict=True):
                    found[k] = ids
        return [merge_word(w, self.ranks) if ids is None else ids for w, ids in zip(words, found, strict=True)]


class Encoder:
    """Cuts texts and looks words up; words not yet known are folded once and cached, up to CACHE of them."""

    def __init__(self, ranks: dict[bytes, int], known: dict[str, list[int]], pattern: str):
        self.merges, self.known, self.cut = Merges(ranks), known, regex.compile(pattern)
        self.reset()

    def reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.ids: list[list[int]] = []
        for word, ids in self.known.items():
            self.rows[word] = len(self.ids)
            self.ids.append(ids)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each text's."""
        if len(self.ids) > CACHE + len(self.known):
            self.reset()
        rows, ids = self.rows, self.ids
        words = [self.cut.findall(text) for text in texts]
        new = list(set().union(*words).difference(rows))
        for w, own in zip(new, self.merges([w.encode("utf-8") for w in new]), strict=True):
            rows[w] = len(ids)
            ids.append(own)
        places = [np.fromiter(map(rows.__getitem__, x), dtype=np.int64, count=len(x)) for x in words]
        used, at = np.unique(np.concatenate(places) if places else np.zeros(0, dtype=np.int64), return_inverse=True)
        own = [ids[r] for r in used.tolist()]
        size = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        start = np.concatenate([[0], np.cumsum(size)])
        flat = np.fromiter((x for ids_ in own for x in ids_), dtype=np.int32, count=int(start[-1]))
        take = size[at] if len(own) else np.zeros(0, dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(take)])
        index = np.arange(int(total[-1])) - np.repeat(total[:-1], take) + np.repeat(start[:-1][at], take) if len(own) else np.zeros(0, dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int64)
        lengths = np.diff(total[ends])
        return flat[index], lengths


def texts_of(column: pa.Array) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in column.view(pa.binary()).to_pylist()]


def frequent_words(docs: DataFrame, pattern: str, text: str = "text", sample: int = SAMPLE_DOCS, words: int = WORDS) -> list[str]:
    """The most frequent distinct words of about `sample` rows, whatever their ids and however often they repeat; at most `words`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, found = regex.compile(pattern), Counter()
        for batch in batches:
            for t in texts_of(batch.column(0)):
                found.update(cut.findall(t))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    n = docs.count()
    some = docs.select(text).sample(min(1.0, sample / max(1, n)), seed=17)
    counts = some.filter(F.col(text).isNotNull()).mapInArrow(settled(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r[0] for r in counts.filter(F.octet_length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(words).collect()]


def dictionary(spark: SparkSession, words: list[str], ranks: dict[bytes, int]) -> dict[str, list[int]]:
    """Ids of distinct words by the Spark fold."""
    if not words:
        return {}
    rows = spark.createDataFrame([(w,) for w in words], "text string").withColumn("word", F.col("text").cast("binary"))
    name = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")  # the driver keeps the text of each plan, and the literal would be in it many times
    try:
        table = encode_words(rows.repartition(spark.sparkContext.defaultParallelism), ranks).select("text", "ids").toArrow()
    finally:
        spark.conf.set(name, before)
    return {w: ids for w, ids in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True) if ids is not None}


class Pieces:
    """The pieces of all ids in one byte array, from which texts are gathered."""

    def __init__(self, ranks: dict[bytes, int]):
        pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.size = np.array([len(p) for p in pieces], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def join(self, ids: np.ndarray, n: np.ndarray) -> pa.Array:
        """Binary texts of lists of ids that lie one after the other; n[i] ids belong to text i. An unknown id is an error."""
        ids = ids.astype(np.int64)
        take = self.size[ids]
        total = np.concatenate([[0], np.cumsum(take)])
        index = np.arange(int(total[-1])) + np.repeat(self.start[ids] - total[:-1], take)
        ends = total[np.concatenate([[0], np.cumsum(n)])].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(self.bytes[index].tobytes())])


def encode(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", ranks: dict[bytes, int] | None = None, pattern: str | None = None, decoded: bool = False) -> DataFrame:
    """`carry` and ids (array of int) of every row's whole text; a null text is empty and has no ids. Empty tables stay empty, repeated rows are
    encoded each, bytes that are no UTF-8 count as U+FFFD, and columns of `carry` named ids or decoded are left out.

    With `decoded` the ids are decoded again in the same pass: a binary column more.
    """
    carry = tuple(c for c in carry if c not in ("ids", "decoded"))
    spark, ranks, pattern = docs.sparkSession, ranks or load_ranks(), pattern or public_tokenizers.PATTERN
    known = dictionary(spark, frequent_words(docs, pattern, text), ranks)
    shared = spark.sparkContext.broadcast((ranks, known))
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value, pattern)
        pieces = Pieces(shared.value[0]) if decoded else None
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                cut = batch.slice(at, 250)
                ids, n = encoder(texts_of(cut.column(cut.num_columns - 1)))
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                out = [*cut.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*out, pieces.join(ids, n)], names=[*carry, "ids", "decoded"]) if pieces else pa.RecordBatch.from_arrays(out, names=[*carry, "ids"])

    schema = "".join(f"`{c}` {fields[c]}, " for c in carry) + "ids array<int>" + ", decoded binary" * decoded
    return docs.select(*carry, F.col(text).alias("_text")).mapInArrow(settled(run), schema)


def decode(rows: DataFrame, carry: tuple[str, ...] = ("doc_id", "ids"), ids: str = "ids", ranks: dict[bytes, int] | None = None) -> DataFrame:
    """`carry` and decoded (binary): the pieces of the ids one after the other. Null or no ids give empty bytes; an unknown id is an error.

    Repeated rows are decoded each, an empty table stays empty, and a column of `carry` named decoded is left out.
    """
    carry = tuple(c for c in carry if c != "decoded")
    shared = rows.sparkSession.sparkContext.broadcast(ranks or load_ranks())
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                cut = batch.slice(at, 250)
                column = cut.column(cut.num_columns - 1)
                n = np.array([len(x) if x.is_valid else 0 for x in column], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*cut.columns[:-1], pieces.join(column.flatten().to_numpy(zero_copy_only=False), n)], names=[*carry, "decoded"])

    schema = "".join(f"`{c}` {fields[c]}, " for c in carry) + "decoded binary"
    return rows.select(*carry, F.col(ids).alias("_ids")).mapInArrow(settled(run), schema)
