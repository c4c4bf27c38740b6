"""SimHash near-duplicates by the general pigeonhole principle.

A text's fingerprint has a bit set where over half of its shingle hashes have it set. Two
fingerprints are linked when at most `radius` bits differ. The 64 bits are cut into parts;
correlated bits share a part, so that the other parts stay selective. Part i gets a threshold
t_i >= -1 with sum(t_i + 1) = radius + 1: two linked fingerprints then differ in at most t_i bits in
some part i (a part with -1 is not probed). Thresholds are found by dynamic programming on
the estimated cost of probes and candidates. The estimates come from a bounded sample and steer
speed alone: every choice of parts and thresholds finds all links.

Equal fingerprints are one node. Nodes that share a probe key meet in one group; a group over
`BLOCK` rows is cut into blocks and every two blocks meet, so no task gathers a large group. A
group yields a spanning forest of its links, not all of its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, drop_path, keep, salted_join, scratch, tidy
from .linededup import _cuts
from .textkernel import blocks, settled, splitmix, window_hashes

BLOCK = 1000
#: The same where links are verified, as wider thresholds make larger groups.
LARGE = 4096
#: Partners that a text takes in one group before links are united, where links are verified; FURTHER times as many each time after.
FIRST, FURTHER = 1, 64
#: Candidate pairs are compared in this many parts, so that one part's texts are on disk at a time.
PARTS = 4
SAMPLE = 4096
#: Seconds for one probe row that is shuffled, and for one candidate pair that is compared.
ROW_COST, PAIR_COST = 4e-6, 8e-9


def fingerprint(text: bytes, width: int = 3, seed: int = 42, chunk: int = 1 << 15) -> int:
    """The fingerprint of one text; with no word it is 0, with fewer words than `width` all words are the one shingle."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, chunk):
        to = min(n, at + chunk)
        spans = zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = 3, seed: int = 42, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` and `fp` (long, the fingerprint's bits as a signed number)."""
    fields = [f for f in docs.schema.fields if f.name in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", width, seed) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*carry, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for c in carry for f in fields if f.name == c) + ", fp long"
    return docs.select(*carry, F.col(text).alias("_text")).mapInArrow(settled(run), schema)


def plan(sample: np.ndarray, n: int, radius: int) -> list[tuple[list[int], int]]:
    """Parts (bits, threshold) for about n different fingerprints of which `sample` is a sample (uint64)."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64) if len(sample) else np.zeros((0, 64))
    if len(bits) > 1:
        mean = bits.mean(axis=0)
        spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
        related = np.abs((bits.T @ bits) / len(bits) - np.outer(mean, mean)) / np.outer(spread, spread)
        differ = 2 * mean * (1 - mean)
    else:
        related, differ = np.eye(64), np.full(64, 0.5)
    n = max(n, SAMPLE)  # the changed keys of a wide threshold are listed whatever the size of the table
    pairs, best = n * (n - 1) / 2, None
    for m in range(1, radius + 2):
        parts = _group(related, m)
        cost = []
        for part in parts:
            near = _near(bits, part, differ, radius)
            row = [0.0]
            for t in range(radius + 1):
                probes = sum(_choose(len(part), k) / (2.0**k) for k in range(t + 1))
                row.append(n * probes * ROW_COST + pairs * near[t] * PAIR_COST)
            cost.append(row)
        value, units = _allocate(cost, radius + 1)
        if best is None or value < best[0]:
            best = (value, [(part, u - 1) for part, u in zip(parts, units, strict=True) if u])
    return best[1]


def _choose(n: int, k: int) -> int:
    return reduce(lambda x, i: x * (n - i) // (i + 1), range(k), 1)


def _group(related: np.ndarray, m: int) -> list[list[int]]:
    """Cut the bits into m parts of equal width; each takes the free bits most correlated with its own."""
    free, parts = set(range(64)), []
    for k in range(m):
        size = len(free) // (m - k)
        pairs = sorted(free)
        sub = related[np.ix_(pairs, pairs)] - 2 * np.eye(len(pairs))
        part = [pairs[int(np.argmax(sub.max(axis=1)))]] if len(pairs) > 1 else pairs[:1]
        while len(part) < size:
            rest = sorted(free - set(part))
            part.append(rest[int(np.argmax(related[np.ix_(rest, part)].sum(axis=1)))])
        parts.append(sorted(part))
        free -= set(part)
    return parts


def _near(bits: np.ndarray, part: list[int], differ: np.ndarray, radius: int) -> np.ndarray:
    """Estimated share of pairs with at most t differing bits in the part, t = 0..radius: the larger of the sample's and that of independent bits."""
    alone = np.zeros(radius + 1)
    alone[0] = 1.0
    for p in differ[part]:
        alone[1:] = alone[1:] * (1 - p) + alone[:-1] * p
        alone[0] *= 1 - p
    seen = np.zeros(radius + 1)
    rows = bits[:1024][:, part]
    if len(rows) > 1:
        apart = rows.sum(1)[:, None] + rows.sum(1)[None, :] - 2 * rows @ rows.T
        at = apart[np.triu_indices(len(rows), 1)]
        seen = np.array([(at <= t).mean() for t in range(radius + 1)])
    return np.maximum(np.cumsum(alone), seen)


def _allocate(cost: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Least cost of giving each part u_i units with sum units; u_i units mean the threshold u_i - 1."""
    table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (value, given) in table.items():
            for u in range(min(units - used, len(row) - 1) + 1):
                if used + u not in new or value + row[u] < new[used + u][0]:
                    new[used + u] = (value + row[u], [*given, u])
        table = new
    return table[units]


def _probes(parts: list[tuple[list[int], int]]):
    """Rows (part, key, fp, id, own) of rows (fp, id, print): a fingerprint's own key in each part, and the keys that arise when up to t of its set bits are cleared or, for two and more, changed. Each print has parts of its own."""
    from itertools import combinations

    masks = [(k, np.uint64(sum(1 << b for b in part)), [np.uint64(sum(1 << b for b in c)) for d in range(1, t + 1) for c in combinations(part, d)]) for k, (part, t) in enumerate(parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                cut = batch.slice(at, 2000)
                fp = cut.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                ids = cut.column(1).to_numpy(zero_copy_only=False)
                base = cut.column(2).to_numpy(zero_copy_only=False) * np.int32(len(masks))
                for k, mask, changes in masks:
                    keys, who, own = [fp & mask], [np.arange(len(fp))], [np.ones(len(fp), dtype=bool)]
                    for change in changes:
                        # Of two keys that differ, one probes for the other: the one with the larger value.
                        other = (fp & mask) ^ change
                        at_ = np.flatnonzero(other < (fp & mask))
                        keys.append(other[at_])
                        who.append(at_)
                        own.append(np.zeros(len(at_), dtype=bool))
                    w = np.concatenate(who)
                    key = np.concatenate(keys).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(base[w] + np.int32(k)), pa.array(key), pa.array(fp[w].view(np.int64)), pa.array(ids[w]), pa.array(np.concatenate(own))], names=["part", "key", "fp", "id", "own"])

    return run


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _links(radius: int):
    """For each group (part, key, block pair), whose rows lie together: a spanning forest of the pairs with an own row and at most `radius` differing bits."""

    def solve(fp: np.ndarray, ids: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
        mine = np.flatnonzero(own)
        if not len(mine) or len(fp) < 2:
            return []
        pairs: list[tuple[int, int]] = []
        step = max(1, (1 << 20) // len(fp))
        for at in range(0, len(mine), step):
            rows = mine[at : at + step]
            a, b = np.nonzero(np.bitwise_count(fp[rows][:, None] ^ fp[None, :]) <= radius)
            a = rows[a]
            ok = ids[a] != ids[b]
            pairs += _forest(len(fp), a[ok], b[ok])
        return pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def out(cols: list[np.ndarray], cuts: np.ndarray) -> pa.RecordBatch:
            src, dst = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a > 1:
                    ids = cols[5][a:b]
                    for x, y in solve(cols[4][a:b].view(np.uint64), ids, cols[6][a:b]):
                        src.append(int(ids[x]))
                        dst.append(int(ids[y]))
            return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            if rest is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(rest, cols, strict=True)]
            change = np.zeros(len(cols[0]), dtype=bool)
            for c in cols[:4]:
                change[1:] |= c[1:] != c[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(change)])
            yield out(cols, cuts)
            rest = [c[cuts[-1] :] for c in cols]
        if rest is not None:
            yield out(rest, np.array([0, len(rest[0])]))

    return run


def _groups(nodes: DataFrame, parts: list[tuple[list[int], int]], most: int) -> DataFrame:
    """Rows (part, key, x, y, fp, id, own, block) that lie together by the first four: the rows (fp, id, print) of `nodes` that share a probe key of a print, two blocks of at most about `most` at a time."""
    probes = nodes.select("fp", "id", "print").mapInArrow(settled(_probes(parts)), "part int, key long, fp long, id long, own boolean")
    sizes = keep(probes.groupBy("part", "key").agg(F.count(F.lit(1)).alias("size"), F.max("own").alias("any")).filter("any and size > 1").select("part", "key", "size", F.col("size").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    found = salted_join(probes, sizes, ["part", "key"], "id", "n", total).filter("size is not null")
    cut = F.ceil(F.col("size") / most).cast("int")
    block = F.pmod(F.xxhash64("id"), cut).cast("int")
    meets = F.when(cut <= 1, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(F.transform(F.sequence(F.lit(0), cut - 1), lambda o: F.struct(F.least(o, block).alias("x"), F.greatest(o, block).alias("y"))))
    dealt = found.select("part", "key", F.explode(meets).alias("m"), "fp", "id", "own", block.alias("block"))
    return dealt.select("part", "key", "m.x", "m.y", "fp", "id", "own", "block")


def _parts(nodes: DataFrame, radius: int) -> list[tuple[list[int], int]]:
    sample = nodes.select("fp").orderBy(F.xxhash64("fp", "id")).limit(SAMPLE).toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    return plan(sample, nodes.count(), radius)


def link_edges(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (src, dst) that connect exactly what links of at most `radius` bits connect. `nodes` has fp (different) and id (long)."""
    groups = _groups(nodes.withColumn("print", F.lit(0)), _parts(nodes, radius), BLOCK).drop("block").repartition("part", "key", "x", "y").sortWithinPartitions("part", "key", "x", "y")
    return groups.mapInArrow(settled(_links(radius)), "src long, dst long")


def _partners(radius: int, cap: int):
    """For each group (part, key, block pair), whose rows lie together: of each own row the first `cap` partners with at most `radius` differing bits and another label; a row (id, null) if there are more."""

    def solve(x: int, y: int, fp: np.ndarray, ids: np.ndarray, own: np.ndarray, block: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        left, right, more = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], False
        mine = np.flatnonzero(own)
        step, place = max(1, (1 << 20) // len(fp)), np.arange(len(fp))
        for at in range(0, len(mine), step):
            rows = mine[at : at + step]
            near = (np.bitwise_count(fp[rows][:, None] ^ fp[None, :]) <= radius) & (label[rows][:, None] != label[None, :])
            near &= ~own[None, :] | (place[None, :] > rows[:, None])  # two own rows meet once
            if x != y:
                near &= block[rows][:, None] != block[None, :]
            a, b = np.nonzero(near)
            rank = np.arange(len(a)) - np.searchsorted(a, a)
            more |= bool((rank >= cap).any())
            a, b = a[rank < cap], b[rank < cap]
            left.append(ids[rows[a]])
            right.append(ids[b])
        return np.concatenate(left), np.concatenate(right), more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def out(cols: list[np.ndarray], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a > 1:
                    src, dst, more = solve(int(cols[2][a]), int(cols[3][a]), cols[4][a:b].view(np.uint64), cols[5][a:b], cols[6][a:b].astype(bool), cols[7][a:b], cols[8][a:b])
                    if len(src):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(src, dst)), pa.array(np.maximum(src, dst))], names=["src", "dst"])
                    if more:
                        yield pa.RecordBatch.from_arrays([pa.array([int(src[0])], pa.int64()), pa.nulls(1, pa.int64())], names=["src", "dst"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            if rest is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(rest, cols, strict=True)]
            change = np.zeros(len(cols[0]), dtype=bool)
            for c in cols[:4]:
                change[1:] |= c[1:] != c[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(change)])
            yield from out(cols, cuts)
            rest = [c[cuts[-1] :] for c in cols]
        if rest is not None:
            yield from out(rest, np.array([0, len(rest[0])]))

    return run


def shingle_lists(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of each text's lower-case words, repeats included; with fewer words than `width` all words are the one shingle."""
    for block in blocks(column, lowered=True):
        words = block.hashes()
        grams = window_hashes(words, width)
        for a, b in zip(block.rows[:-1].tolist(), block.rows[1:].tolist(), strict=True):
            yield grams[a : b - width + 1] if b - a >= width else window_hashes(words[a:b], max(1, b - a))


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted hashes of the different shingles of each text's lower-case words; with fewer words than `width` all words are the one shingle."""
    return [np.unique(grams) for grams in shingle_lists(column, width)]


def _similar(width: int, similarity: float):
    """Of rows (src, dst, a, b) with two texts: those whose sets of shingles have at least this Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in _cuts(batch):
                good = []
                for x, y in zip(shingle_sets(cut.column(2), width), shingle_sets(cut.column(3), width), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(both >= similarity * (len(x) + len(y) - both))
                yield cut.select(["src", "dst"]).filter(pa.array(good, pa.bool_()))

    return run


def with_prints(docs: DataFrame, text: str, width: int, prints: int, carry: tuple[str, ...]) -> DataFrame:
    """The columns `carry` and `fps` (array of long): `prints` fingerprints of each text's shingles, each over hashes of its own. A text without a word has zeros."""
    fields = [f for f in docs.schema.fields if f.name in carry]

    def one(grams: np.ndarray) -> list[int]:
        found = []
        for k in range(prints):
            counts = np.zeros(64, dtype=np.int64)
            for at in range(0, len(grams), 1 << 15):
                mixed = splitmix(grams[at : at + (1 << 15)] ^ np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64)))
                counts += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            found.append(int(np.packbits(2 * counts > len(grams), bitorder="little").view("<i8")[0]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(grams) for grams in shingle_lists(batch.column(batch.num_columns - 1), width)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.int64()))], names=[*carry, "fps"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for c in carry for f in fields if f.name == c) + ", fps array<long>"
    return docs.select(*carry, F.col(text).alias("_text")).mapInArrow(settled(run), schema)


def verified_edges(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], radius: int, width: int, similarity: float) -> DataFrame:
    """Edges (src, dst) that connect exactly what links connect: at most `radius` differing bits in one print and the similarity of shingles. `nodes` has id and fps (array), `texts` gives id and text, one row for each wanted id.

    All prints are probed at once and by the same parts, so that the number of jobs does not grow with the prints. A text takes FIRST partners of a group;
    once these links are united, only texts that are still apart take more, so a large group of copies does not give all its pairs.
    """
    spark = nodes.sparkSession
    path, held = scratch(spark, "similar"), scratch(spark, "groups")
    each = nodes.select(F.posexplode("fps").alias("print", "fp"), "id")
    with tidy(spark):
        _groups(each, _parts(nodes.select(F.col("fps")[0].alias("fp"), "id"), radius), LARGE).write.parquet(held)
    groups = spark.read.schema("part int, key long, x int, y int, fp long, id long, own boolean, block int").parquet(held)
    edges = known = None
    cap = FIRST
    while True:
        if edges is None:
            named = groups.withColumn("label", F.col("id"))
        else:
            united = keep(components(edges))
            edges = united.select(F.col("node").alias("src"), F.col("component").alias("dst")).filter("src <> dst")  # the same groups by fewer links, in one piece
            labels = united.withColumnRenamed("node", "id")
            named = groups.join(labels, "id", "left").select(*groups.columns, F.coalesce("component", "id").alias("label"))
        dealt = named.repartition("part", "key", "x", "y").sortWithinPartitions("part", "key", "x", "y")
        met = keep(dealt.mapInArrow(settled(_partners(radius, cap)), "src long, dst long").distinct())
        pairs = met.filter("dst is not null")
        pairs = pairs if known is None else keep(pairs.join(known, ["src", "dst"], "left_anti"))
        known = pairs if known is None else known.union(pairs)
        wanted = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        with tidy(spark):
            texts(wanted).select("id", "text").write.mode("overwrite").parquet(path)
        words = spark.read.schema("id long, text string").parquet(path)
        first, second = words.select(F.col("id").alias("src"), F.col("text").alias("a")), words.select(F.col("id").alias("dst"), F.col("text").alias("b"))
        for part in range(PARTS):  # texts are dealt to a part of the pairs at a time
            some, ends = (x.filter(F.pmod("dst", F.lit(PARTS)) == part) for x in (pairs, second))
            good = keep(some.join(first, "src").join(ends, "dst").select("src", "dst", "a", "b").mapInArrow(settled(_similar(width, similarity)), "src long, dst long"))
            edges = good if edges is None else edges.union(good)
        if not met.filter("dst is null").limit(1).count():
            drop_path(spark, path)
            drop_path(spark, held)
            return edges
        cap *= FURTHER


#: Fingerprints of a text and the bits in which two may differ, where links are verified. Of pairs with a similarity of 0.8 or more one fingerprint
#: and 12 bits find 0.88, and four and 8 bits more than that for fewer probes: the number of probes grows fast with the bits.
PRINTS, BITS = 4, 8


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = BITS, width: int = 5, similarity: float = 0.8, prints: int = PRINTS) -> DataFrame:
    """One row of each group of near-duplicate rows of `docs`, with its columns.

    Rows with equal texts (a null text counts as empty) are one group, and so are those connected over links: one of `prints` pairs of fingerprints differs in at most
    `radius` bits, and sets of shingles have at least this Jaccard similarity. The first row by (id, hash of the text, the other columns) stays, a null id
    last, whatever the order of the rows; columns must be of types that can be ordered. Rows that repeat an id with unlike texts are rows of their own. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in (id_col, text)]
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.xxhash64(whole).alias("_h1"), F.xxhash64(F.lit("text"), whole).alias("_h2"), F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(whole).alias("h"), F.col(text).isNull().alias("empty"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(others)]).alias("_row"), whole.alias("_t"))
    path = scratch(spark, "nodes")
    found = with_prints(rows, "_t", width, prints, ("_h1", "_h2", "_row"))
    found.groupBy("_h1", "_h2", "fps").agg(F.min("_row").alias("first")).select(F.monotonically_increasing_id().alias("id"), "_h1", "_h2", "fps", "first").write.parquet(path)
    nodes = spark.read.parquet(path)
    named = rows.select("_h1", "_h2", F.col("_row").alias("first"), F.col("_t").alias("text"))

    def texts(wanted: DataFrame) -> DataFrame:
        # Copies of a text are spread over the tasks by their whole row.
        return named.join(nodes.join(wanted, "id").select("_h1", "_h2", "first", "id"), ["_h1", "_h2", "first"]).dropDuplicates(["id"])

    edges = verified_edges(nodes.select("id", "fps"), texts, radius, width, similarity)
    joined = keep(components(edges))
    behind = nodes.join(joined, nodes["id"] == joined["node"])
    leads = behind.groupBy("component").agg(F.min("first").alias("lead"))
    gone = keep(behind.join(leads, "component").filter("first <> lead").select("id"))
    left = nodes.join(gone, "id", "left_anti").select("_h1", "_h2", "first")
    found = named.join(left, ["_h1", "_h2", "first"]).dropDuplicates(["_h1", "_h2"])
    columns = {id_col: F.col("first.id"), text: F.when(~F.col("first.empty"), F.col("text"))} | {c: F.col(f"first.c{k}") for k, c in enumerate(others)}
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 3, width: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of `docs`: id_col, fingerprint (16 lower-case hex digits), component_id, n_copies.

    component_id is the smallest id reachable over links of at most `radius` differing bits, the row's own
    included; n_copies counts the rows with the same fingerprint. Null and empty texts have the fingerprint 0 and are
    linked like any other. A row with a null id keeps its fingerprint, links with nothing and has a null component_id.
    Rows that repeat an id are one document with several texts: they connect what each of them links with. Ties cannot
    arise, as ids order the members. An empty table gives an empty result; other columns are ignored.
    """
    prints = keep(with_fingerprint(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_t")), "_t", width, seed, ("_id",)))
    known = prints.filter("_id is not null")
    nodes = keep(known.groupBy("fp").agg(F.min("_id").alias("id"), F.count(F.lit(1)).alias("n")))
    edges = link_edges(nodes, radius)
    repeated = known.groupBy("_id").agg(F.min("fp").alias("f"), F.max("fp").alias("g")).filter("f <> g").select("_id")
    several = known.join(repeated, "_id").join(nodes.select("fp", "id"), "fp").select(F.col("_id").alias("src"), F.col("id").alias("dst"))
    joined = components(edges.union(several))
    labels = nodes.join(joined, nodes["id"] == joined["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"), "n", F.col("n").alias("n_copies"))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    out = salted_join(prints, labels, "fp", "_id", "n", total)
    component = F.when(F.col("_id").isNotNull(), F.col("component_id"))
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"), "n_copies")
