"""Removal of repeated passages through a log-structured index of window fingerprints.

A window is WIDTH consecutive words of one document. Each window is known in the index by the fingerprint
of one word gram in it, the one of least hash (winnowing): equal windows choose equal grams at equal
places, so a window that occurs twice has a fingerprint that occurs twice, and one fingerprint stands for
about ten windows.

`FingerprintIndex` holds immutable runs (fp, n), bucketed and sorted by fingerprint, in a folder that outlives a session. A batch is
aggregated into a run of its own, which is merge-joined with the earlier runs, bucket by bucket and without a shuffle of the history;
the batch's fingerprints that now have two occurrences or more are its candidates. When there are FANOUT runs they are merged into one
before the next batch. Windows at candidate fingerprints are then verified
by a 128-bit hash of their words, so the index decides only what is verified, never what is removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import put_text
from .graph import drop_path, keep, salted_join, scratch, tidy
from .linededup import _cuts
from .textkernel import Block, blocks, settled, slide_min, splitmix, window_hashes

WIDTH = 35
GRAM = 16
FANOUT = 2
BATCHES = 3
_PLACE = np.uint64((1 << 24) - 1)


def anchors(block: Block, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Valid window starts and each one's chosen gram (word index); the chosen grams and their fingerprints."""
    empty = np.zeros(0, dtype=np.int64)
    if len(block.starts) < width:
        return empty, empty, empty, np.zeros(0, dtype=np.uint64)
    grams = window_hashes(block.hashes(), gram)
    if len(grams) > int(_PLACE):
        return _anchors_by_part(block, grams, width, gram)
    keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    chosen = (slide_min(keys, width - gram + 1) & _PLACE).astype(np.int64)
    starts = np.flatnonzero(np.arange(len(chosen)) + width <= block.row_end_of_word()[: len(chosen)])
    at = chosen[starts]
    unique = np.unique(at)
    return starts, at, unique, grams[unique]


def _anchors_by_part(block: Block, grams: np.ndarray, width: int, gram: int):
    """The same for a block of more than 2 ** 24 words: overlapping parts, each with places of its own."""
    span, step = width - gram + 1, 1 << 23
    chosen = []
    for first in range(0, len(grams) - span + 1, step):
        own = grams[first : first + step + span - 1]
        keys = (own & ~_PLACE) | np.arange(len(own), dtype=np.uint64)
        chosen.append((slide_min(keys, span) & _PLACE).astype(np.int64) + first)
    chosen = np.concatenate(chosen)
    starts = np.flatnonzero(np.arange(len(chosen)) + width <= block.row_end_of_word()[: len(chosen)])
    at = chosen[starts]
    unique = np.unique(at)
    return starts, at, unique, grams[unique]


def _fingerprints(width: int, gram: int):
    """Rows (fp, n) of the chosen grams, counted within a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                fp, n = np.unique(anchors(block, width, gram)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(n.astype(np.int64))], names=["fp", "n"])

    return run


def _occurrences(width: int, gram: int):
    """Rows (fp, key, at) of the chosen grams of rows (key, text); `at` is a word's place in its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for block in blocks(batch.column(1)):
                _, _, at, fp = anchors(block, width, gram)
                row = block.row_of_word()[at] if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), ids.slice(block.first, block.last - block.first).take(pa.array(row)), pa.array((at - block.rows[row]).astype(np.int32))], names=["fp", "key", "at"])

    return run


def _windows(width: int, gram: int):
    """Rows (w1, w2, key, start, known) of the windows whose gram is a candidate: two halves of the hash of the words.

    Of windows that repeat within a block one carries the hash; the others, known to be repeated, carry a hash of their
    place instead, so that a very common passage does not meet in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places = batch.column(0), batch.column(2)
            offsets = places.offsets.to_numpy() - (places.offsets[0].as_py() if len(places) else 0)
            flat = places.flatten().to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1)):
                starts, at, _, _ = anchors(block, width, gram)
                if not len(starts):
                    continue
                wanted = np.zeros(len(block.starts) + 1, dtype=bool)
                lo, hi = offsets[block.first], offsets[block.last]
                rows = np.repeat(np.arange(block.last - block.first), np.diff(offsets[block.first : block.last + 1]))
                place = block.rows[rows] + flat[lo:hi]
                wanted[place[place < len(block.starts)]] = True
                starts = starts[wanted[at]]
                text = _joined(block)
                size = np.concatenate([[0], np.cumsum(block.ends - block.starts + 1)])
                a, b = size[starts].tolist(), (size[starts + width] - 1).tolist()
                digest = xxhash.xxh3_128_digest
                found = np.frombuffer(b"".join([digest(text[x:y]) for x, y in zip(a, b, strict=True)]), dtype=">i8").reshape(-1, 2).astype(np.int64)
                row = block.row_of_word()[starts]
                key = keys.slice(block.first, block.last - block.first).take(pa.array(row)).to_numpy(zero_copy_only=False)
                place = (starts - block.rows[row]).astype(np.int32)
                _, first, of = np.unique(found[:, 0], return_index=True, return_inverse=True)
                lead = first[of]
                other = (lead != np.arange(len(lead))) & (found[:, 1] == found[lead, 1])
                known = other.copy()
                known[lead[other]] = True
                spread = splitmix(key.view(np.uint64) ^ splitmix(place.astype(np.uint64)))
                w1 = np.where(other, spread.view(np.int64), found[:, 0])
                w2 = np.where(other, splitmix(spread).view(np.int64), found[:, 1])
                yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), pa.array(key), pa.array(place), pa.array(known)], names=["w1", "w2", "key", "start", "known"])

    return run


def _joined(block: Block) -> bytes:
    """The block's words, each followed by one space."""
    n = block.ends - block.starts
    out = np.full(int(n.sum()) + len(n), 0x20, dtype=np.uint8)
    step = np.concatenate([[0], np.cumsum(n)])[:-1]
    source = np.arange(int(n.sum())) - np.repeat(step, n)
    out[source + np.repeat(step + np.arange(len(n)), n)] = block.data[source + np.repeat(block.starts, n)]
    return out.tobytes()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (w1, w2) those whose neighbour has the same hash and those known to be repeated: (key, start)."""
    last: tuple | None = None

    def out(keys: list, starts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int32())], names=["key", "start"])

    open_: tuple | None = None  # the last row, if it is not yet known to repeat
    for batch in batches:
        if not batch.num_rows:
            continue
        w1, w2, key, start, known = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        like = (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])
        hit = known.astype(bool)
        hit[1:] |= like
        hit[:-1] |= like
        if last == (w1[0], w2[0]):
            hit[0] = True
            if open_ is not None:
                yield out([open_[0]], [open_[1]])
        last = (w1[-1], w2[-1])
        open_ = None if hit[-1] else (key[-1], start[-1])
        yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(start[hit])], names=["key", "start"])


class FingerprintIndex:
    """Runs (fp, n) in a folder of the shared file system, each with one row for a fingerprint, bucketed and sorted by it.

    An index opened on a folder that holds runs goes on with them; `buckets` counts for a new one alone.
    """

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.path, self.fanout = spark, path, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: dict[str, str] = {}
        self.runs: list[str] = []
        listed = self._listed()
        if listed:
            self.buckets, self.runs = listed["buckets"], listed["runs"]

    def _listed(self) -> dict | None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs.json")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return None
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/runs.json").collect()))

    def _list(self) -> None:
        put_text(self.spark, f"{self.path}/runs.json", json.dumps({"buckets": self.buckets, "runs": self.runs}))

    def _write(self, run: DataFrame) -> str:
        """Write rows (fp, n) that already lie together by bucket as a run; return its name."""
        name = f"run_{uuid.uuid4().hex}"
        with tidy(self.spark):
            run.select("fp", "n").write.format("parquet").bucketBy(self.buckets, "fp").sortBy("fp").option("path", f"{self.path}/{name}").saveAsTable(f"corpusloom_{name}")
        self.tables[name] = f"corpusloom_{name}"
        return name

    def run(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS corpusloom_{name} (fp BIGINT, n BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
            self.tables[name] = f"corpusloom_{name}"
        return self.spark.table(self.tables[name])

    def _forget(self, names: list[str]) -> None:
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")

    def append(self, fingerprints: DataFrame) -> DataFrame:
        """Add a batch (fp, n) as a new run; return (fp, n) of its fingerprints that now have two occurrences or more, n in all runs.

        When there are `fanout` runs, they are compacted first. The result is kept apart from the runs.
        """
        if len(self.runs) >= self.fanout:
            self.compact()
        earlier = list(self.runs)
        new = self._write(fingerprints.repartition(self.buckets, "fp").groupBy("fp").agg(F.sum("n").alias("n")))
        known = self.run(new)
        for name in earlier:
            old = self.run(name).withColumnRenamed("n", "m").hint("merge")
            known = known.join(old, "fp", "left").select("fp", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
        found = keep(known.filter("n > 1"))
        self.runs.append(new)
        self._list()
        return found

    def compact(self) -> None:
        """Merge all runs into one; the old ones are deleted once the new one is whole and listed."""
        if len(self.runs) < 2:
            return
        old, merged = list(self.runs), self.run(self.runs[0])
        for name in old[1:]:
            other = self.run(name).withColumnRenamed("n", "m").hint("merge")
            merged = merged.join(other, "fp", "full_outer").select("fp", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        self.runs = [self._write(merged)]
        self._list()
        self._forget(old)
        for name in old:
            drop_path(self.spark, f"{self.path}/{name}")

    def close(self) -> None:
        """Forget the session's tables; the runs stay in their folder."""
        self._forget(list(self.tables))

    def drop(self) -> None:
        self.close()
        drop_path(self.spark, self.path)


def _strip(width: int):
    """Rows (.., kept text, n_words, n_removed) from the starts of the repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in _cuts(batch, 2 << 20):
                kept, total, removed = [], [], []
                for text, starts in zip(cut.column(2), cut.column(1), strict=True):
                    words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                    gone = np.zeros(len(words) + 1, dtype=np.int64)
                    if starts.is_valid and len(words):
                        s = np.unique(starts.values.to_numpy(zero_copy_only=False))
                        gone[s] += 1
                        np.subtract.at(gone, np.minimum(s + width, len(words)), 1)
                    covered = np.cumsum(gone)[: len(words)] > 0
                    total.append(len(words))
                    removed.append(int(covered.sum()))
                    kept.append(b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c] if removed[-1] else words))
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).view(pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return run


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """One row per row of `docs`: id_col, n_words, n_removed, kept (the words left, joined by one space).

    A word goes if a window of `width` words that covers it also starts anywhere else, in this or another row, all rows
    judged as given. A null or empty text has no words. Identical rows (same id and text) repeat one another, rows
    that share an id but not a text are texts of their own, a null id is an id like any other. There are no ties to break:
    every copy goes. An empty table gives an empty result; other columns are ignored. `batches` parts of the documents, by
    a hash of id and text, enter a new index one after the other; each is merge-joined with the runs before it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text"))
    named = rows.withColumn("_key", F.xxhash64("_id", "_text"))
    index, candidates = FingerprintIndex(spark, scratch(spark, "fingerprints"), fanout), None
    for k in range(batches):
        part = named.filter(F.pmod(F.xxhash64(F.lit("batch"), "_key"), F.lit(batches)) == k).select("_text")
        found = index.append(part.mapInArrow(settled(_fingerprints(width, gram)), "fp long, n long"))
        candidates = found if candidates is None else candidates.union(found)
    # A fingerprint is found again with each batch that holds it, at last with all its occurrences.
    candidates = keep(candidates.groupBy("fp").agg(F.max("n").alias("n")))
    index.drop()
    total = candidates.agg(F.sum("n")).first()[0] or 0
    places = named.select("_key", "_text").mapInArrow(settled(_occurrences(width, gram)), "fp long, key long, at int")
    hits = salted_join(places, candidates.withColumn("hit", F.lit(True)), "fp", "key", "n", total).filter("hit")
    spots = keep(hits.groupBy("key").agg(F.collect_set("at").alias("spots")))
    suspects = named.join(spots, F.col("_key") == F.col("key")).select("_key", "_text", "spots")
    windows = suspects.mapInArrow(settled(_windows(width, gram)), "w1 long, w2 long, key long, start int, known boolean")
    grouped = windows.repartition("w1", "w2").sortWithinPartitions("w1", "w2")
    repeated = keep(grouped.mapInArrow(settled(_repeated), "key long, start int").groupBy("key").agg(F.collect_set("start").alias("starts")))
    out = named.join(repeated, F.col("_key") == F.col("key"), "left").select("_id", "starts", "_text")
    return out.mapInArrow(settled(_strip(width)), "id long, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  p AS (SELECT rid, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM d),
  g AS (SELECT rid, pos, md5(array_to_string(list(word) OVER f, ' ')) AS h, count(*) OVER f AS n FROM p WINDOW f AS (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
  s AS (SELECT rid, pos, count(*) OVER (PARTITION BY h) > 1 AS again FROM g WHERE n = 35),
  c AS (SELECT p.rid, p.pos, p.word, coalesce(max(again::INT) OVER (PARTITION BY p.rid ORDER BY p.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone FROM p LEFT JOIN s ON p.rid = s.rid AND p.pos = s.pos),
  k AS (SELECT rid, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.rid = k.rid
"""
