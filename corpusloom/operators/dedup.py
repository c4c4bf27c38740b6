"""Exact and approximate deduplication of URLs, links, files and bytes."""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.shared import keep
from .manifest import latest


def distinct_first(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """First occurrence of each key."""
    return latest(rows, key, [order], first=True)


def ordered_distinct(*lists: Column) -> Column:
    """Union of lists, first occurrences in order."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))


def unseen(candidates: DataFrame, *seen: DataFrame, key: list[str]) -> DataFrame:
    """Candidates whose key is in none of the sets."""
    for other in seen:
        candidates = candidates.join(other.select(*key), key, "left_anti")
    return candidates


def content_groups(rows: DataFrame, content: str, id_col: str) -> DataFrame:
    """Rows with equal bytes: hash, smallest id, count."""
    return rows.groupBy(F.sha2(content, 256).alias("sha256")).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("copies"))


def best_files(files: DataFrame, preference: Column) -> DataFrame:
    """For each (identifier, stem) the name of least preference, the first listed on a tie; unlisted formats go."""
    ranked = files.withColumn("_p", preference).filter("_p is not null").withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", ""))
    return ranked.groupBy("identifier", "stem").agg(F.min_by("name", F.struct("_p", "index")).alias("name")).orderBy("identifier", "name").select("identifier", "name")


class Bloom:
    """A bloom filter of URLs made by DataFrame aggregation: no false negatives, about `fpp` false positives; for a prefilter before an exact check.

    The bits lie in blocks of `BITS`. A value sets places of one block, so a probe is one join by block, and the places are tested
    in the array of the block's words as part of one expression. The number of blocks follows from `capacity` and `fpp`, whatever the filter is given: up to
    `broadcast_words` words of 64 bits it is broadcast, and beyond that the rows are shuffled by block, once.
    """

    BITS = 4096

    def __init__(self, capacity: int, fpp: float = 0.001, broadcast_words: int = 1 << 20):
        bits = max(self.BITS, math.ceil(-capacity * math.log(fpp) / math.log(2) ** 2))
        self.blocks, self.hashes = -(-bits // self.BITS), max(1, round(-math.log2(fpp)))
        self.words = self.blocks * self.BITS // 64
        self.small, self.count, self.table, self._held = self.words <= broadcast_words, 0, None, None

    def _block(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.blocks)).cast("int")

    def _places(self, column: str) -> list[Column]:
        """The places of a value in its block: five of twelve bits from each further hash."""
        hashes = [F.xxhash64(F.lit(f"bloom{j}"), column) for j in range(-(-self.hashes // 5))]
        return [F.shiftright(hashes[i // 5], 12 * (i % 5)).bitwiseAND(self.BITS - 1).cast("int") for i in range(self.hashes)]

    def mark(self, rows: DataFrame, column: str) -> Bloom:
        """Add all values of a column; nulls are left out. `count` grows by the number of rows, repeats included, as counted in the same pass."""
        seen = Observation()
        own = rows.observe(seen, F.count(column).alias("n")).filter(F.col(column).isNotNull())
        bits = own.select(self._block(column).alias("block"), F.explode(F.array(*self._places(column))).alias("at"))
        words = bits.select("block", F.expr("int(at / 64)").alias("word"), F.expr("shiftleft(1L, at % 64)").alias("mask"))
        if self.table is not None:
            words = words.union(self.table.select("block", F.posexplode("words").alias("word", "mask")).filter("mask <> 0"))
        found = words.groupBy("block", "word").agg(F.bit_or("mask").alias("mask"))  # summed up before the shuffle: one row a word at most
        packed = found.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("m"))
        every = F.transform(F.sequence(F.lit(0), F.lit(self.BITS // 64 - 1)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long")))
        self.table = keep(packed.select("block", every.alias("words")))
        self._held = None
        self.count += seen.get["n"]
        return self

    def split(self, rows: DataFrame, column: str) -> DataFrame:
        """`rows` with `maybe_seen`: false only for values that were never added. Null values were not."""
        if self.table is None:
            return rows.withColumn("maybe_seen", F.lit(False))
        known = self.table.withColumnRenamed("block", "_block").withColumnRenamed("words", "_words")
        met = rows.join(F.broadcast(known) if self.small else known, self._block(column) == F.col("_block"), "left")
        hit = F.col("_words").isNotNull() & F.col(column).isNotNull()
        for p in self._places(column):
            hit = hit & (F.call_function("shiftright", F.get("_words", F.call_function("shiftright", p, F.lit(6))), p.bitwiseAND(63)).bitwiseAND(1) == 1)
        return met.withColumn("maybe_seen", F.coalesce(hit, F.lit(False))).drop("_block", "_words")

    def unseen(self, rows: DataFrame, column: str, exact: DataFrame) -> DataFrame:
        """Rows whose value is not in `exact` (which has the column): only those that may have been seen meet the exact table."""
        parted = self.split(rows, column)
        checked = parted.filter("maybe_seen").join(exact.select(column), column, "left_anti").select(*parted.columns)
        return parted.filter("not maybe_seen").union(checked).drop("maybe_seen")

    def probably_seen(self, value: str) -> bool:
        """The same for one value; the words, whose number is fixed, are fetched once."""
        if self.table is None:
            return False
        if self._held is None:
            self._held = {r["block"]: r["words"] for r in self.table.collect()}
        data = value.encode()
        words = self._held.get(_signed(xxhash.xxh64_intdigest(data, 42)) % self.blocks)
        hashes = [xxhash.xxh64_intdigest(data, xxhash.xxh64_intdigest(f"bloom{j}".encode(), 42)) for j in range(-(-self.hashes // 5))]
        places = [hashes[i // 5] >> 12 * (i % 5) & self.BITS - 1 for i in range(self.hashes)]
        return words is not None and all(words[p // 64] >> p % 64 & 1 for p in places)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def approx_seen(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.approx_count_distinct(column).alias("estimated"))
