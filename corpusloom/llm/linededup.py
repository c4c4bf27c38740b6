"""Near-duplicate lines by a segment-partition edit join.

Two lines are linked when their edit distance is at most `limit` of the shorter one: PERCENT of its length, EDITS at least.
Equal lines are one node, known by a 128-bit hash; the edit join works on one row for each different line.

Where the limit t is EDITS, a line is cut into t + 1 segments; two linked lines share at least one segment, at places that
differ by little. Each line is indexed by its segments and probes, for every length from its own down to t less, the
substrings that can match a segment of a line of that length (multi-match-aware selection, as in Pass-Join).

Longer lines are cut into t + 1 disjoint windows of one width for each band of lengths, of which t edits leave one whole.
A window is known by a gram in it, at the place of its least hash of four characters modulo STEPS (mod-sampling, Groot Koerkamp and Pibiri 2024: a
quarter of the places are chosen, a third where the gram begins at the least hash), so every line that holds the
window at any place holds the gram: the grams of the t + 1 windows are indexed and those of all windows probe. Of two linked lines some
window i of the shorter one is whole, with at most i edits before it and t - i after it (let E(i) be the edits before window i: E(i) - i
starts at 0, ends below -(t - edits) and falls by one at whole windows alone), so a key meets only lines whose
length and place fit that. Keys travel as packed 64-bit words, many to a row, and in PASSES parts, each of some bands.

Candidate pairs travel packed too, each once and beside those that share its head, the least line with one of its keys, in cells of CELL pairs.
A line's text goes once to each cell that needs it. There pairs are told apart by counts of characters and of their neighbours and then verified by banded
bit-parallel edit distance, many pairs at a time, the likeliest first and none within what is already united. A line that meets more than FIRST lines by one key takes FIRST of them; the others wait until these links have been
united and are compared only with lines that are still apart, so a large group of copies never gives all its pairs. Both ways find all links, directly or over
others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, drop_path, keep, salted_join, scratch, tidy
from .textkernel import settled

EDITS = 2
PERCENT = 5
CLASSES = 32
#: Lengths from TALL on are not told apart in a key; places are numbers below ANY, which stands for several (or for any in a line so long).
TALL, ANY = (1 << 14) - 1, (1 << 12) - 1
MIN_CHARS = 20
BLOCK = 500
#: Least lengths of the bands of long lines beyond the first.
BANDS = (80, 100, 140, 200, 280, 400, 560, 800, 1200, 2400)
#: Places in a window at which its gram may begin: few give long, telling grams and many keys.
STEPS = 5
#: The bands are dealt over this many passes, so that the packed keys of one pass are on disk at a time.
PASSES = 2
#: Packed keys of one bucket; a bucket is matched by one task.
KEYS = 1 << 20
#: Partners that a line takes from one key before links are united; 32 times as many each time after.
FIRST = 32
#: So few line numbers (of 8 bytes) are broadcast to fetch their texts; more are joined.
FEW = 1 << 19
#: Candidate pairs of one cell.
CELL = 1 << 14

_U = np.uint64


def limit(length: int, edits: int = EDITS, percent: int = PERCENT) -> int:
    """Most edits between two linked lines of which the shorter has this length."""
    return max(edits, length * percent // 100)


def first_long(edits: int, percent: int) -> int | None:
    """The least length whose limit is above `edits`."""
    return -(-100 * (edits + 1) // percent) if percent else None


def bands(edits: int, percent: int, steps: int = STEPS) -> list[tuple[int, int, int]]:
    """(least length, least length of the next band, window) of the bands of long lines, by the shorter line of a pair."""
    start = first_long(edits, percent)
    if start is None:
        return []
    starts = [start, *(b for b in BANDS if b > start), 1 << 31]
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        window = min(n // (limit(n, edits, percent) + 1) for n in range(a, min(b, 4 * a + 400)))
        if window - steps + 1 < 8:
            raise ValueError(f"{percent} % of edits leave windows of {window} characters, too narrow for grams of 8")
        out.append((a, b, window))
    return out


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 segments of a line; the last ones are longer by one where it does not divide."""
    parts = edits + 1
    short, longer = length // parts, length % parts
    sizes = [short + (i >= parts - longer) for i in range(parts)]
    starts = [sum(sizes[:i]) for i in range(parts)]
    return list(zip(starts, sizes, strict=True))


def probes(length: int, edits: int) -> list[tuple[int, int, int, int, bool]]:
    """(indexed length, segment, start, size, own) of the substrings of a line that can equal a segment of a line as long or shorter by up to `edits`."""
    out = []
    for other in range(max(edits + 1, length - edits), length + 1):
        delta = length - other
        for i, (start, size) in enumerate(segments(other, edits)):
            left = max(start - i, start + delta - (edits - i), 0)
            right = min(start + i, start + delta + (edits - i), length - size)
            out += [(other, i, p, size, delta == 0 and p == start) for p in range(left, right + 1)]
    return out


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most `edits`: prefix and suffix off, then a band of bits about the diagonal (Hyyrö 2003)."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > edits:
        return False
    n = min(len(a), len(b))
    lo, hi = 0, n
    while lo < hi:  # length of the common prefix
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    a, b, n = a[lo:], b[lo:], n - lo
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[len(a) - mid : len(a) - lo] == b[len(b) - mid : len(b) - lo]:
            lo = mid
        else:
            hi = mid - 1
    a, b = a[: len(a) - lo], b[: len(b) - lo]
    if len(a) < len(b):
        a, b = b, a
    if len(a) <= edits:
        return True
    if len(b) <= edits:  # too short for the band
        return _plain(a, b) <= edits
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    width = max(64, 2 * edits + 8)
    full = (1 << width) - 1
    up, down, distance, shift = (full << (width - edits - 1)) & full, 0, edits, edits + 1 - width
    across, most = 1 << (width - 2), 2 * edits + len(b) - len(a)
    for i, c in enumerate(b):
        bits = at.get(c, 0)
        x = ((bits >> shift) if shift >= 0 else (bits << -shift)) & full
        d = ((((x & up) + up) & full) ^ up) | x | down
        plus, minus = down | (~(d | up) & full), d & up
        if i < len(a) - edits:
            distance += not d >> (width - 1)
        else:
            distance += bool(plus & across) - bool(minus & across)
            across >>= 1
        if distance > most:
            return False
        up, down = minus | (~((d >> 1) | plus) & full), (d >> 1) & plus
        shift += 1
    return distance <= edits


def _plain(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _cuts(batch: pa.RecordBatch, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of a few MB of text (its last column)."""
    column = batch.column(batch.num_columns - 1)
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False), nan=0)) if len(column) else np.zeros(0)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _strings(column: pa.Array) -> list[str]:
    return [x.decode("utf-8", "replace") for x in column.view(pa.binary()).to_pylist()]


def _signatures(edits: int, percent: int):
    """Rows (sig, line, own) of the short lines among rows (line, words)."""
    start = first_long(edits, percent)
    longest = start - 1 + edits if start else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, list] = {}
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for cut in _cuts(batch):
                sig, own, rows, counts = [], [], [], []
                for r, s in enumerate(_strings(cut.column(1))):
                    if longest and len(s) > longest:
                        continue
                    plan = cache.get(len(s))
                    if plan is None:
                        plan = cache[len(s)] = [(p, p + size, other * 8 + i + 1, mine) for other, i, p, size, mine in probes(len(s), edits)]
                    sig += [digest(s[a:b].encode("utf-8", "replace"), seed) for a, b, seed, _ in plan]
                    own += [mine for _, _, _, mine in plan]
                    rows.append(r)
                    counts.append(len(plan))
                lines = cut.column(0).take(pa.array(np.repeat(np.array(rows, dtype=np.int64), counts)))
                yield pa.RecordBatch.from_arrays([_signed(sig), lines, pa.array(own, pa.bool_())], names=["sig", "line", "own"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (sig, line): (sig, size, line, own) of each distinct line of the keys that hold two lines or more, one of them indexed."""
    rest: list[np.ndarray] | None = None

    def out(sig: np.ndarray, line: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        first = np.ones(len(sig), dtype=bool)
        first[1:] = (sig[1:] != sig[:-1]) | (line[1:] != line[:-1])
        group = np.cumsum(first) - 1
        sig, line, own = sig[first], line[first], np.bincount(group, weights=own) > 0
        head = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(head, len(sig)))
        good = (size > 1) & (np.add.reduceat(own.astype(np.int64), head) > 0)
        take, size = np.repeat(good, size), np.repeat(size, size)
        return pa.RecordBatch.from_arrays([pa.array(sig[take]), pa.array(size[take]), pa.array(line[take]), pa.array(own[take])], names=["sig", "size", "line", "own"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(rest, cols, strict=True)]
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        if last:
            yield out(*[c[:last] for c in cols])
        rest = [c[last:] for c in cols]
    if rest is not None:
        yield out(*rest)


def _verify(edits: int, percent: int):
    """Rows (sig, x, y, line, own, words) sorted by (sig, x, y): a spanning forest of the verified links."""

    def solve(lines: list[int], own: list[bool], words: list[str]) -> list[tuple[int, int]]:
        up = list(range(len(lines)))

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        found = []
        for a in range(len(lines)):
            for b in range(a):
                if (own[a] or own[b]) and (x := root(a)) != (y := root(b)) and within(words[a], words[b], limit(min(len(words[a]), len(words[b])), edits, percent)):
                    up[x] = y
                    found.append((lines[a], lines[b]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, ([], [], [])
        for batch in batches:
            pairs: list[tuple[int, int]] = []
            for sig, x, y, line, own, words in zip(*[c.to_pylist() for c in batch.columns[:-1]], _strings(batch.column(5)), strict=True):
                if name != (sig, x, y):
                    pairs += solve(*held)
                    name, held = (sig, x, y), ([], [], [])
                for part, value in zip(held, (line, own, words), strict=True):
                    part.append(value)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["src", "dst"])
        pairs = solve(*held)
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["src", "dst"])

    return run


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte for each code point (equal ones alike) and the first one of each row, as one more than there are rows."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1, offset=column.offset * 4).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] else np.zeros(0, dtype=np.uint8)
    offsets -= offsets[0]
    if not len(data) or int(data.max()) < 128:
        return data, offsets
    mixed = data.copy()
    mixed[:-1] ^= (data[:-1] >= 0xC0) * (data[1:] * np.uint8(29))
    mixed[:-2] ^= (data[:-2] >= 0xE0) * (data[2:] * np.uint8(101))
    head = (data & 0xC0) != 0x80
    starts = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(head, out=starts[1:], dtype=np.int32)
    return mixed[head], starts[offsets].astype(np.int64)


def _chosen(codes: np.ndarray, n: int, width: int, steps: int) -> np.ndarray:
    """For each of `n` places the place of the gram of the window of `width` characters that begins there, one of the first `steps` of the window. `codes` has `width` + 24 more."""
    span = (width - 3) // steps * steps if width - 3 >= steps else width - 3
    out = np.empty(n, dtype=np.int32)
    offset = (np.arange(span) % steps).astype(np.uint8)
    for a in range(0, n, 1 << 15):  # small arrays stay in the processor's cache
        b = min(n, a + (1 << 15))
        size = b - a + span - 1
        order = np.ndarray((size,), dtype="<u4", buffer=codes, offset=a, strides=(1,)) * np.uint32(0x9E3779B1)
        order ^= order >> np.uint32(15)
        order *= np.uint32(0x85EBCA77)
        at = np.arange(size, dtype=np.uint32)
        best, done = (order & np.uint32(0xFFFF0000)) | at, 1
        while done < span:
            step = min(done, span - done)
            best = np.minimum(best[:-step], best[step:])
            done += step
        best &= np.uint32(0xFFFF)
        best -= at[: b - a]
        np.add(offset[best], np.arange(a, b, dtype=np.int32), out=out[a:b], casting="unsafe")
    return out


def _windows(codes: np.ndarray, starts: np.ndarray, names: np.ndarray, number: int, plan: tuple[int, int, int], edits: int, percent: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, packed word without the hash) of the keys in one band, `plan`, of lines that lie one after the other; `names` are their numbers below 65536. A line above the band, which may be the longer one of a pair, is not indexed."""
    _, end, width = plan
    size, n = np.diff(starts), int(starts[-1])
    codes = np.concatenate([codes, np.zeros(width + 24, dtype=np.uint8)])
    chosen = _chosen(codes, n, width, steps)
    wide = np.ndarray((n + width + 17,), dtype="<u8", buffer=codes, strides=(1,))
    inside = np.zeros(n + 1, dtype=np.int8)
    inside[starts[:-1]] = 1
    inside[starts[:-1] + size - width + 1] = -1
    marked, indexed = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    marked[chosen[np.cumsum(inside[:n], dtype=np.int8).view(bool)]] = True
    at = np.flatnonzero(marked)
    own = np.flatnonzero(size < end)
    parts = np.minimum(np.maximum(edits, size[own] * percent // 100) + 1, size[own] // width)
    firsts = np.repeat(starts[own], parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * width
    indexed[chosen[firsts]] = True
    who = np.repeat(np.arange(len(size), dtype=np.int32), size)[at]
    gram = min(width - steps + 1, 16)
    h = wide[at]
    tail = wide[at + (gram - 8)] * _U(0xC2B2AE3D27D4EB4F)
    h = (h + _U(number + 1)) * _U(0x9E3779B97F4A7C15)
    h ^= tail ^ (tail >> _U(29))
    h ^= h >> _U(32)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(29)
    place = (at - starts[who]) % ANY
    length = np.minimum(size, TALL) << 29 | names
    return _once(h, (length[who] | place << 17 | indexed[at].astype(np.int64) << 16).astype(np.uint64))


def _once(h: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys that a line holds several times once, at the place ANY, indexed if one of them is."""
    both = h << _U(16) | rest & _U(0xFFFF)
    ordered = np.sort(both)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return h, rest
    table = np.zeros(1 << 16, dtype=bool)
    table[((again >> _U(16)) & _U(0xFFFF)).astype(np.int64)] = True
    some = table[(h & _U(0xFFFF)).astype(np.int64)]
    own = np.flatnonzero(some)
    own = own[np.lexsort((h[own], rest[own] & _U(0xFFFF)))]
    head = np.ones(len(own), dtype=bool)
    name = rest[own] & _U(0xFFFF)
    head[1:] = (h[own][1:] != h[own][:-1]) | (name[1:] != name[:-1])
    group = np.cumsum(head) - 1
    several, indexed = np.bincount(group) > 1, np.bincount(group, weights=(rest[own] >> _U(16)) & _U(1)) > 0
    first = own[head]
    merged = np.where(several, rest[first] & ~_U(ANY << 17) | _U(ANY << 17) | indexed.astype(np.uint64) << _U(16), rest[first])
    return np.concatenate([h[~some], h[first]]), np.concatenate([rest[~some], merged])


def _reach(plan: tuple[int, int, int], edits: int, percent: int) -> int:
    """The length from which no line is linked to one of the band."""
    return plan[1] + limit(plan[1] - 1, edits, percent)


def _keys(edits: int, percent: int, steps: int, buckets: int, part: list[int]):
    """Rows (bucket, base, data) of the long lines among rows (line, words), in the bands numbered in `part`: packed keys, whose line is base plus the lowest 16 bits.

    A packed key has 21 bits of hash, 14 of length (at most TALL), 12 of place (ANY: several), 1 if indexed and 16 of line. Buckets are
    dealt by other bits of the hash.
    """
    plans = bands(edits, percent, steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in _cuts(batch, 2 << 20):
                lines, at = cut.column(0).to_numpy(), 0
                while at < len(lines):  # line numbers of one row of the result lie within 65536
                    off = (lines[at:] < lines[at]) | (lines[at:] - lines[at] > 65535)
                    to = at + (int(np.argmax(off)) if off.any() else len(off))
                    words, names, base, at = cut.column(1).slice(at, to - at), lines[at:to] - lines[at], int(lines[at]), to
                    size, found = pc.utf8_length(words).to_numpy(), []
                    for k in part:
                        own = np.flatnonzero((size >= plans[k][0]) & (size < _reach(plans[k], edits, percent)))
                        if len(own):
                            found.append(_windows(*_codes(words.take(pa.array(own))), names[own], k, plans[k], edits, percent, steps))
                    if found:
                        h, rest = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
                        yield _dealt(((h >> _U(34)) % _U(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32), (h << _U(43)) | rest, base)

    return run


def _dealt(bucket: np.ndarray, values: np.ndarray, base: int) -> pa.RecordBatch:
    """Rows (bucket, base, data): the values of each bucket as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket, values = bucket[order], values[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, dtype=np.int64)
    width = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    data = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int64)), pa.array(np.full(len(cuts) - 1, base, dtype=np.int64)), data], names=["bucket", "base", "data"])


def _met(sig: np.ndarray, size: np.ndarray, place: np.ndarray, own: np.ndarray, line: np.ndarray, edits: int, percent: int, high: int, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of keys sorted by (sig, size): rows (src, dst, head) of the pairs with unlike labels that length and place allow, the first `high` of each key's line, and the signatures with further ones."""
    n, plans = len(sig), bands(edits, percent)
    most = np.maximum(edits, size * percent // 100)
    width = np.array([p[2] for p in plans])[np.maximum(np.searchsorted(np.array([p[0] for p in plans]), size, side="right") - 1, 0)]
    window, free = place // width, (place == ANY) | (size >= ANY)
    taken, alive, lag = np.zeros(n, dtype=np.int64), np.arange(n), 0
    left, right, hot = [], [], np.zeros(n, dtype=bool)
    begin = np.ones(n, dtype=bool)
    begin[1:] = sig[1:] != sig[:-1]
    head = np.minimum.reduceat(line, np.flatnonzero(begin))[np.cumsum(begin) - 1] if n else line
    while True:
        lag += 1
        alive = alive[alive + lag < n]
        alive = alive[(sig[alive] == sig[alive + lag]) & (size[alive + lag] - size[alive] <= most[alive])]
        if not len(alive):
            break
        other = alive + lag
        longer, shift = size[other] - size[alive], place[other] - place[alive]
        ok = own[alive] & (free[alive] | free[other] | (np.abs(shift) <= window[alive]) & (np.abs(longer - shift) <= most[alive] - window[alive]))
        ok |= own[other] & (longer == 0) & (free[alive] | free[other] | (np.abs(shift) <= np.minimum(window[other], most[other] - window[other])))
        ok &= line[alive] != line[other]
        if label is not None:
            ok &= label[alive] != label[other]
        a, b = alive[ok], other[ok]
        full = taken[a] >= high
        if full.any():
            hot[a[full]] = True
            alive = alive[~hot[alive]]
            a, b = a[~full], b[~full]
        taken[a] += 1
        left.append(a)
        right.append(b)
    none = np.zeros(0, dtype=np.int64)
    a, b = np.concatenate([none, *left]), np.concatenate([none, *right])
    return _firsts(np.stack([np.minimum(line[a], line[b]), np.maximum(line[a], line[b]), head[a]], axis=1)), np.unique(sig[hot])


def _firsts(pairs: np.ndarray) -> np.ndarray:
    """Of rows (src, dst, head) each different pair once, with its least head, sorted."""
    pairs = pairs[np.lexsort((pairs[:, 2], pairs[:, 1], pairs[:, 0]))]
    new = np.ones(len(pairs), dtype=bool)
    new[1:] = (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)
    return pairs[new]


def _candidates(edits: int, percent: int, high: int, buckets: int):
    """Of rows (bucket, base, data) sorted by bucket: rows (bucket, base, data) of candidate pairs and their heads, 24 bytes each, bucketed by their first line (base -1), and of the signatures with further ones their (line, signature and key), 16 bytes each (in their own bucket, base 0)."""

    def solve(bucket: int, bases: list[int], data: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        packed = np.concatenate(data)
        ordered = np.sort(packed)
        sig, size = ordered >> _U(43), ((ordered >> _U(29)) & _U(TALL)).astype(np.int64)
        near = np.flatnonzero((sig[1:] == sig[:-1]) & (size[1:] - size[:-1] <= np.maximum(edits, size[:-1] * percent // 100)))
        if not len(near):
            return
        table = np.zeros(1 << 21, dtype=bool)  # keys whose signature meets none need no exact order
        table[sig[near].astype(np.int32)] = True
        del ordered, sig, size, near
        some = np.flatnonzero(table[(packed >> _U(43)).astype(np.int32)])
        line = np.repeat(np.array(bases, dtype=np.int64), [len(d) for d in data])[some]
        packed = packed[some]
        line += (packed & _U(0xFFFF)).astype(np.int64)
        at = np.argsort(packed)
        line, packed = line[at], packed[at]
        number = lambda shift, bits: ((packed >> _U(shift)) & _U((1 << bits) - 1)).astype(np.int64)
        sig = number(43, 21)
        pairs, more = _met(sig, number(29, 14), number(17, 12), number(16, 1) > 0, line, edits, percent, high)
        yield _dealt((pairs[:, 0] % buckets).astype(np.uint16 if buckets <= 1 << 16 else np.uint32), pairs, -1)
        if len(more):
            held = np.flatnonzero(np.isin(sig, more))
            key = ((bucket & 0x7FFF) << 48) | (sig[held] << 27) | number(16, 27)[held]
            yield _dealt(np.full(len(held), bucket, dtype=np.uint32), np.stack([line[held], key], axis=1), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, bases, data = None, [], []
        for batch in batches:
            for bucket, base, blob in zip(*batch.columns, strict=True):
                if bucket.as_py() != name:
                    if data:
                        yield from solve(name, bases, data)
                    name, bases, data = bucket.as_py(), [], []
                bases.append(base.as_py())
                data.append(np.frombuffer(blob.as_buffer(), dtype="<u8").copy())
        if data:
            yield from solve(name, bases, data)

    return run


def _numbers(data: pa.Array, width: int = 2) -> np.ndarray:
    """The numbers in a binary column, `width` to a row."""
    found = [np.frombuffer(x.as_buffer(), dtype="<i8").reshape(-1, width) for x in data]
    return np.concatenate(found) if found else np.zeros((0, width), dtype=np.int64)


def _by_bucket(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """The numbers of each bucket of rows (bucket, data) sorted by bucket."""
    name, held = None, []
    for batch in batches:
        for k, bucket in enumerate(batch.column(0).to_pylist()):
            if bucket != name and held:
                yield name, np.concatenate(held)
                held = []
            name = bucket
            held.append(_numbers(batch.column(1).slice(k, 1), width))
    if held:
        yield name, np.concatenate(held)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The rows of each number in the first column, by which they are sorted."""
    name, held = None, []
    for batch in batches:
        number, at = batch.column(0).to_numpy(), 0
        while at < len(number):
            to = int(np.searchsorted(number, number[at], side="right"))
            if number[at] != name and held:
                yield name, held
                held = []
            name = int(number[at])
            held.append(batch.slice(at, to - at))
            at = to
    if held:
        yield name, held


def _different(buckets: int):
    """Of rows (bucket, data) sorted by bucket: rows (bucket, data) of each different pair (src, dst, head) once, bucketed by the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pairs in _by_bucket(batches, 3):
            pairs = _firsts(pairs)
            yield _dealt((pairs[:, 2] % buckets).astype(np.uint16 if buckets <= 1 << 16 else np.uint32), pairs, 0).select(["bucket", "data"])

    return run


def _celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (bucket, data) sorted by bucket: rows (cell, line, data), a row with the pairs of each cell (line null) and one for each line in it (data null)."""
    for bucket, pairs in _by_bucket(batches, 3):
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0], pairs[:, 2]))]
        for k, at in enumerate(range(0, len(pairs), CELL)):
            own = np.ascontiguousarray(pairs[at : at + CELL, :2])
            lines = np.unique(own)
            n = len(lines)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n + 1, bucket << 32 | k)), pa.array([None, *lines.tolist()], pa.int64()), pa.array([own.tobytes(), *[None] * n], pa.binary())], names=["cell", "line", "data"])


def _lines_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (bucket, data) of (line, signature and key): rows (bucket, line), each line of a row once."""
    for batch in batches:
        for bucket, data in zip(*batch.columns, strict=True):
            lines = np.unique(np.frombuffer(data.as_buffer(), dtype="<i8")[::2])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lines), bucket.as_py())), pa.array(lines)], names=["bucket", "line"])


def _further(edits: int, percent: int, high: int, buckets: int):
    """Of rows (bucket, line, label, data) sorted by bucket, waiting keys (line null) and the labels of their lines (data null): rows (bucket, data, more), candidate pairs with unlike labels and their heads by their first line (not more), and the keys of the signatures that have yet more."""

    def solve(bucket: int, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        named = table.filter(pc.is_valid(table.column("line"))).sort_by("line")
        held = np.concatenate([np.frombuffer(x.as_buffer(), dtype="<i8").reshape(-1, 2) for x in table.filter(pc.is_null(table.column("line"))).column("data")])
        label = named.column("label").to_numpy()[np.searchsorted(named.column("line").to_numpy(), held[:, 0])]
        order = np.argsort(held[:, 1], kind="stable")
        held, label = held[order], label[order]
        sig = held[:, 1] >> 27
        begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        apart = np.repeat(np.minimum.reduceat(label, begin) < np.maximum.reduceat(label, begin), np.diff(np.append(begin, len(sig))))
        held, label, sig = held[apart], label[apart], sig[apart]
        key = held[:, 1] & 0x7FFFFFF
        pairs, more = _met(sig, key >> 13, (key >> 1) & ANY, (key & 1) > 0, held[:, 0], edits, percent, high, label)
        rest = held[np.isin(sig, more)]
        for found, name in ((_dealt((pairs[:, 0] % buckets).astype(np.uint32), pairs, 0), False), (_dealt(np.full(len(rest), bucket, dtype=np.uint32), rest, 0), True)):
            yield pa.RecordBatch.from_arrays([found.column(0), found.column(2), pa.array([name] * found.num_rows, pa.bool_())], names=["bucket", "data", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _runs(batches):
            yield from solve(bucket, rows)

    return run


def distances(a: list[np.ndarray], b: list[np.ndarray], edits: int) -> np.ndarray:
    """Edit distances of many pairs of arrays of code points above 2, a[i] not shorter than b[i] and by at most `edits`, both longer than it: right where at most `edits`, above it elsewhere.

    A band of bits about the diagonal moves along all pairs at once (Hyyrö 2003), in as many 64-bit words as the band is wide. Both
    texts of a pair are lengthened by the same run, which leaves their distance, until all a[i] are equally long.
    """
    k, size_b = len(a), np.array([len(x) for x in b])
    size_a = np.array([len(x) for x in a])
    long = int(size_a.max())
    size_b += long - size_a
    words = -(-(2 * edits + 8) // 64)
    width = 64 * words
    left = width - edits - 1
    kind = np.result_type(*{x.dtype for x in (*a, *b)})
    first, second = np.zeros((k, max(left + long, long + width)), dtype=kind), np.ones((k, long), dtype=kind)
    first[:, left : left + long] = 2
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        first[i, left : left + len(x)] = x
        second[i, : size_b[i]] = 2
        second[i, : len(y)] = y
    second = np.ascontiguousarray(second.T)
    start = ((1 << width) - 1) << left & ((1 << width) - 1)
    up = np.array([[start >> 64 * w & (1 << 64) - 1] * k for w in range(words)], dtype=np.uint64)
    down, across = np.zeros_like(up), np.empty_like(up)
    out, rows = np.full(k, edits + 1, dtype=np.int64), np.arange(k)
    found, most, one, top = np.full(k, edits, dtype=np.int64), 2 * edits + size_b - long, _U(1), _U(63)
    for i in range(long):
        if i % 32 == 31:  # pairs beyond the limit end early
            alive = found <= most
            if alive.mean() < 0.8:
                if not alive.any():
                    return out
                first, second, up, down, found, most, rows, size_b = first[alive], np.ascontiguousarray(second[:, alive]), up[:, alive], down[:, alive], found[alive], most[alive], rows[alive], size_b[alive]
                across = np.empty_like(up)
        same = np.packbits(first[:, i : i + width] == second[i][:, None], axis=1, bitorder="little").view("<u8").T
        carry = None
        for w in range(words):
            x = same[w] & up[w]
            y = x + up[w]
            if carry is None:
                z = y
                carry = y < x if words > 1 else None
            else:
                z = y + carry.astype(np.uint64)
                carry = (y < x) | (z < y)
            across[w] = (z ^ up[w]) | same[w] | down[w]
        plus, minus = down | ~(across | up), across & up
        if i < long - edits:
            found += 1
            found -= (across[-1] >> top).astype(np.int64)
        else:
            bit = width - 2 - (i - (long - edits))
            last = ((plus[bit >> 6] >> _U(bit & 63)) & one).astype(np.int64) - ((minus[bit >> 6] >> _U(bit & 63)) & one).astype(np.int64)
            found += np.where(i < size_b, last, 0)
        moved = across >> one
        if words > 1:
            moved[:-1] |= across[1:] << top
        up, down = minus | ~(moved | plus), moved & plus
    out[rows] = found
    return out


#: Pairs of like length from which the vectorised distance pays.
MANY = 48


def _within_all(pairs: list[tuple[str, str]], most: np.ndarray) -> np.ndarray:
    """Whether each pair's distance is at most its limit."""
    good = np.zeros(len(pairs), dtype=bool)
    size = np.array([max(len(x), len(y)) for x, y in pairs], dtype=np.int64)
    order, at = np.argsort(size, kind="stable"), 0
    while at < len(order):
        length = int(size[order[at]])
        to = min(int(np.searchsorted(size[order], length + length // 4, side="right")), at + max(1, (1 << 21) // (length + 128)))
        own = order[at:to]
        at = to
        band = int(most[own].max())
        shortest = min(min(len(x), len(y)) for x, y in (pairs[i] for i in own))
        if len(own) < MANY or shortest <= band or len(own) < length // 16:
            good[own] = [within(*pairs[i], int(most[i])) for i in own]
            continue
        points = [[np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype="<u4") + np.uint32(3) for s in side] for side in zip(*[sorted(pairs[i], key=len, reverse=True) for i in own], strict=True)]
        if all(int(x.max()) < 1 << 16 for side in points for x in side):
            points = [[x.astype(np.uint16) for x in side] for side in points]
        good[own] = distances(*points, band) <= most[own]
    return good


def _counts(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Counts of CLASSES classes of characters up to 255, a row a line."""
    owner = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
    found = np.bincount(owner * CLASSES + (codes & (CLASSES - 1)), minlength=CLASSES * (len(starts) - 1))
    return np.minimum(found, 255).astype(np.uint8).reshape(-1, CLASSES)


def _neighbours(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Counts of 512 classes of neighbouring characters up to 255, a row a line."""
    owner = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
    both = (codes[1:].astype(np.int32) * 31 + codes[:-1]) & 511
    both += owner[1:] * 512
    found = np.bincount(both[owner[1:] == owner[:-1]], minlength=512 * (len(starts) - 1))
    return np.minimum(found, 255).astype(np.uint8).reshape(-1, 512)


def _apart(counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the counts of a[i] are too many or, if more, too few for b[i]."""
    out, step = np.empty(len(a), dtype=np.int64), max(1, (1 << 19) // counts.shape[1])
    for at in range(0, len(a), step):
        d = counts[a[at : at + step]].astype(np.int16) - counts[b[at : at + step]]
        total, both = d.sum(1, dtype=np.int64), np.abs(d, out=d).sum(1, dtype=np.int64)
        out[at : at + step] = (both + np.abs(total)) >> 1
    return out


def _forest(words: pa.Array, a: np.ndarray, b: np.ndarray, edits: int, percent: int, every: bool) -> list[int]:
    """Which of the pairs of texts (a[i], b[i]) of a column are within the limit: every one, or as many as make a spanning forest of them."""
    codes, starts = _codes(words)
    size = np.diff(starts)
    most = np.maximum(edits, np.minimum(size[a], size[b]) * percent // 100)
    # One edit makes at most one character too many and one too few; it takes two pairs of neighbours away at most and adds two at most.
    some = np.flatnonzero(_apart(_counts(codes, starts), a, b) <= most)
    if not len(some):
        return []
    used, place = np.unique(np.concatenate([a[some], b[some]]), return_inverse=True)
    apart = _apart(_neighbours(*_codes(words.take(pa.array(used)))), place[: len(some)], place[len(some) :])
    good = apart <= 2 * most[some]
    some, apart = some[good], apart[good]
    some = some[np.argsort(apart / most[some], kind="stable")]
    text, up, found, step = {int(k): x for k, x in zip(used, _strings(words.take(pa.array(used))), strict=True)}, np.arange(len(words)), [], 1024
    while len(some):
        now, some = some[:step], some[step:]
        linked = now[_within_all([(text[x], text[y]) for x, y in zip(a[now].tolist(), b[now].tolist(), strict=True)], most[now])]
        for k in linked.tolist():
            x, y = up[a[k]], up[b[k]]
            if every or x != y:
                up[up == max(x, y)] = min(x, y)
                found.append(k)
        some, step = some if every else some[up[a[some]] != up[b[some]]], 4 * step
    return found


def _compared(edits: int, percent: int, every: bool):
    """Of rows (cell, line, data, words) sorted by cell: the linked pairs (src, dst), every one or a spanning forest of each cell's."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        pairs = table.filter(pc.is_null(table.column("line"))).column("data")
        lines = table.filter(pc.is_valid(table.column("line"))).sort_by("line")
        at = lines.column("line").to_numpy()
        pairs = np.concatenate([np.frombuffer(x.as_buffer(), dtype="<i8").reshape(-1, 2) for x in pairs])
        a, b = np.searchsorted(at, pairs[:, 0]), np.searchsorted(at, pairs[:, 1])
        words = lines.column("words").combine_chunks()
        kept = _forest(words.cast(pa.string()) if words.type != pa.string() else words, a, b, edits, percent, every)
        return pa.RecordBatch.from_arrays([pa.array(pairs[kept, 0]), pa.array(pairs[kept, 1])], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches):
            yield solve(rows)

    return run


def _verified(pairs: DataFrame, buckets: int, lines: DataFrame, edits: int, percent: int, every: bool) -> DataFrame:
    """Those of the different pairs in rows (bucket, data) that are linked, every one or as many as connect the same: (src, dst). `lines` has line and words."""
    spark = lines.sparkSession
    cells = keep(pairs.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(settled(_celled), "cell long, line long, data binary"))
    needed = cells.filter("line is not null").select("cell", "line")
    wanted = needed.select("line").distinct()
    with tidy(spark):
        few = wanted.count() <= FEW
    if few:
        wanted = F.broadcast(wanted)
    words = lines.select("line", "words").join(wanted, "line", "left_semi")
    texts = needed.join(words, "line").select("cell", "line", F.lit(None).cast("binary").alias("data"), "words")
    both = cells.filter("line is null").select("cell", "line", "data", F.lit(None).cast("string").alias("words")).union(texts)
    dealt = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell")
    return keep(dealt.mapInArrow(settled(_compared(edits, percent, every)), "src long, dst long"))


def _passes(chars: dict[int, int]) -> list[list[int]]:
    """The bands dealt over PASSES passes of like numbers of characters, given for each band; passes without any are left out."""
    parts: list[list[int]] = [[] for _ in range(PASSES)]
    for k in sorted(chars, key=chars.get, reverse=True):
        min(parts, key=lambda own: sum(chars[x] for x in own)).append(k)
    return [sorted(p) for p in parts if p]


def long_edges(lines: DataFrame, edits: int = EDITS, percent: int = PERCENT, steps: int = STEPS, first: int = FIRST, every: bool = True) -> DataFrame:
    """Edges (src, dst) that connect what links with a limit above `edits` connect; `lines` has line (long, neighbours in a file near each other), words (all different) and size (code points). With `every`, no link among the compared pairs is left out for being within what others connect."""
    spark = lines.sparkSession
    plans = bands(edits, percent, steps)
    band = sum(((F.col("size") >= least).cast("int") for least, _, _ in plans), F.lit(-1))
    chars = {r.band: r.chars for r in lines.groupBy(band.alias("band")).agg(F.sum("size").alias("chars")).collect() if r.band >= 0}
    path, kind = scratch(spark, "candidates"), "bucket long, base long, data binary"
    count = lambda n: max(4, int(n * 3 / (2 * steps + 1)) // KEYS + 1)
    buckets = max([4, *[count(sum(chars[k] for k in part)) for part in _passes(chars)]])
    lines.limit(0).selectExpr("0L bucket", "0L base", "X'' data").write.parquet(path)
    with tidy(spark):
        for part in _passes(chars):
            inside = [F.col("size").between(plans[k][0], _reach(plans[k], edits, percent) - 1) for k in part]
            long = lines.filter(F.array_contains(F.array(*inside), True)).select("line", "words")
            dealt = long.mapInArrow(settled(_keys(edits, percent, steps, buckets, part)), kind)
            dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(settled(_candidates(edits, percent, first, buckets)), kind).write.mode("append").parquet(path)
    met = spark.read.schema(kind).parquet(path)
    pairs = met.filter("base = -1").select("bucket", "data").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    edges = _verified(pairs.mapInArrow(settled(_different(buckets)), "bucket long, data binary"), buckets, lines, edits, percent, every)
    waiting = keep(met.filter("base = 0").select("bucket", "data"))
    drop_path(spark, path)
    high = first
    while waiting.limit(1).count():
        high *= 32
        labels = keep(components(edges))
        lines_in = waiting.mapInArrow(settled(_lines_in), "bucket long, line long").distinct()
        named = lines_in.join(labels, lines_in["line"] == labels["node"], "left").select("bucket", "line", F.coalesce("component", "line").alias("label"), F.lit(None).cast("binary").alias("data"))
        none = F.lit(None).cast("long")
        both = waiting.select("bucket", none.alias("line"), none.alias("label"), "data").union(named)
        more = keep(both.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(settled(_further(edits, percent, high, buckets)), "bucket long, data binary, more boolean"))
        pairs = more.filter("not more").select("bucket", "data").repartition(buckets, "bucket").sortWithinPartitions("bucket")
        edges = edges.union(_verified(pairs.mapInArrow(settled(_different(buckets)), "bucket long, data binary"), buckets, lines, edits, percent, every))
        waiting = keep(more.filter("more").select("bucket", "data"))
    return edges


def link_edges(lines: DataFrame, edits: int = EDITS, percent: int = PERCENT) -> DataFrame:
    """Edges (src, dst) between different lines that connect what links of at most `limit` edits connect; `lines` has line (long), words and size."""
    start = first_long(edits, percent)
    short = lines.filter(F.col("size") < start + edits) if start else lines
    keys = short.select("line", "words").mapInArrow(settled(_signatures(edits, percent)), "sig long, line long, own boolean")
    hits = keep(keys.repartition("sig").sortWithinPartitions("sig", "line").mapInArrow(settled(_shared), "sig long, size long, line long, own boolean"))
    wanted = hits.select("line").distinct()
    words = short.select("line", "words").join(wanted, "line", "left_semi")
    cut = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("line"), cut).cast("int")
    meets = F.transform(F.sequence(F.lit(0), cut - 1), lambda o: F.struct(F.least(o, block).alias("x"), F.greatest(o, block).alias("y")))
    dealt = hits.join(words, "line").select("sig", F.explode(meets).alias("m"), "line", "own", "words").select("sig", "m.x", "m.y", "line", "own", "words")
    groups = dealt.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y")
    found = groups.mapInArrow(settled(_verify(edits, percent)), "src long, dst long")
    return keep(found).union(long_edges(lines, edits, percent, every=False)) if percent else found


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cut in _cuts(batch, 2 << 20):
            kept, total, removed = [], [], []
            for text, gone in zip(cut.column(cut.num_columns - 1), cut.column(cut.num_columns - 2), strict=True):
                lines = text.as_buffer().to_pybytes().split(b"\n") if text.is_valid else []
                out = set(gone.as_py() or ())
                total.append(len(lines))
                removed.append(len(out))
                kept.append((b"\n".join(x for k, x in enumerate(lines) if k not in out) if out else text.as_buffer().to_pybytes()) if text.is_valid else None)
            names = [*cut.schema.names[:-2], "n_lines", "n_removed", "kept"]
            yield pa.RecordBatch.from_arrays([*cut.columns[:-2], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).view(pa.string())], names=names)


def _lines_of(text: bytes, least: int) -> tuple[list[int], list[bytes]]:
    """Places and words of the \n-separated lines with at least `least` code points once surrounding ASCII white space is gone."""
    places, found = [], []
    for k, line in enumerate(text.split(b"\n")):
        line = line.strip()
        if len(line) >= least and (len(line) >= 4 * least or len(line.decode("utf-8", "replace")) >= least):
            places.append(k)
            found.append(line)
    return places, found


def _hashes(lines: list[bytes]) -> list[pa.Array]:
    """The halves of a 128-bit hash of each line."""
    digest = xxhash.xxh3_128_digest
    found = np.frombuffer(b"".join([digest(x) for x in lines]), dtype=">i8").reshape(-1, 2).astype(np.int64)
    return [pa.array(found[:, 0]), pa.array(found[:, 1])]


def _bytes(column: pa.Array) -> Iterator[bytes]:
    for t in column:
        yield t.as_buffer().to_pybytes() if t.is_valid else b""


def _occurrences(least: int):
    """Rows (h1, h2, id, key, twin, place) of the lines of rows (id, key, twin, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in _cuts(batch):
                row, place, lines = [], [], []
                for r, text in enumerate(_bytes(cut.column(3))):
                    places, own = _lines_of(text, max(1, least))
                    row += [r] * len(own)
                    place += places
                    lines += own
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*_hashes(lines), *[cut.column(k).take(at) for k in range(3)], pa.array(place, pa.int32())], names=["h1", "h2", "id", "key", "twin", "place"])

    return run


def _words(least: int):
    """Rows (h1, h2, size, words) of the lines of a text column, each different line of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in _cuts(batch):
                lines = list(dict.fromkeys(x for text in _bytes(cut.column(0)) for x in _lines_of(text, max(1, least))[1]))
                words = pa.array(lines, pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([*_hashes(lines), pc.utf8_length(words), words], names=["h1", "h2", "size", "words"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows that begin with (h1, h2), with equal ones in the same task, each once with a number of its own."""
    task, count, seen = TaskContext.get().partitionId(), 0, set()
    for batch in batches:
        at = []
        for k, name in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if name not in seen:
                seen.add(name)
                at.append(k)
        line = np.arange(count, count + len(at), dtype=np.int64) + (task << 33)
        count += len(at)
        yield pa.RecordBatch.from_arrays([pa.array(line), *[c.take(pa.array(at)) for c in batch.columns]], names=["line", *batch.schema.names])


def different_lines(texts: DataFrame, least: int, path: str) -> DataFrame:
    """One row for each different line of a text column, written to `path`: line (its number), h1, h2, size and words."""
    kind = "h1 long, h2 long, size int, words string"
    with tidy(texts.sparkSession):
        dealt = texts.mapInArrow(settled(_words(least)), kind).repartition("h1", "h2")
        dealt.mapInArrow(settled(_numbered), f"line long, {kind}").write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
    return texts.sparkSession.read.schema(f"line long, {kind}").parquet(path)


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), min_chars: int = MIN_CHARS, edits: int = EDITS, percent: int = PERCENT, exact_from: int | None = None) -> DataFrame:
    """One row per row of `docs`: id_col, `carry`, n_lines, n_removed, kept (the text without the removed lines).

    Lines are compared without surrounding white space. Lines of min_chars code points or more that are equal or linked,
    directly or over others, are one class; of its occurrences the first by (id, place) stays and the others go. Shorter
    lines of `exact_from` code points or more (1: all but blank ones) are in a class with their equals alone; lines shorter still always stay. A null text stays null and has no lines; an empty text has one empty line. A null id sorts last.
    Identical rows (same id and text) are one document and keep the same lines; rows that share an id but not a text are
    ordered by a hash of the text. An empty table gives an empty result; columns not in `carry` are ignored, and those in it that
    are named like a column of the result are left out.
    """
    spark = docs.sparkSession
    carry = tuple(c for c in carry if c not in (id_col, "n_lines", "n_removed", "kept"))
    rows = docs.select(F.col(id_col).cast("long").alias("_line_id"), *[F.col(c).alias(f"_line_c{k}") for k, c in enumerate(carry)], F.col(text).alias("_text"))
    rows = rows.withColumn("_line_key", F.xxhash64("_line_id", "_text")).withColumn("_line_twin", F.xxhash64(F.lit("row"), "_line_id", "_text"))
    path, table = scratch(spark, "places"), scratch(spark, "lines")
    kind, least = "h1 long, h2 long, id long, key long, twin long, place int", min_chars if exact_from is None else min(min_chars, exact_from)
    rows.select("_line_id", "_line_key", "_line_twin", "_text").mapInArrow(settled(_occurrences(least)), kind).write.parquet(path)
    places = spark.read.schema(kind).parquet(path)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key", "twin", "place")
    nodes = places.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    lines = different_lines(rows.select("_text"), min_chars, table)
    joined = keep(components(link_edges(lines.select("line", "words", "size"), edits, percent)))
    linked = keep(lines.select("line", "h1", "h2").join(joined, F.col("line") == F.col("node")).select("h1", "h2", "component"))
    classes = keep(nodes.join(linked, ["h1", "h2"], "left").filter("n > 1 or component is not null"))
    leads = classes.filter("component is not null").groupBy("component").agg(F.min("first").alias("lead"))
    lead = classes.join(leads, "component", "left").withColumn("lead", F.coalesce("lead", "first"))
    lead = keep(lead.select("h1", "h2", F.col("lead.key").alias("lead_key"), F.col("lead.twin").alias("lead_twin"), F.col("lead.place").alias("lead_place"), "n"))
    total = lead.agg(F.sum("n")).first()[0] or 0
    gone = salted_join(places, lead, ["h1", "h2"], "key", "n", total).filter("lead_key is not null and not (lead_key = key and lead_twin = twin and lead_place = place)")
    marks = keep(gone.groupBy("key", "twin").agg(F.collect_set("place").alias("gone")))
    drop_path(spark, path)
    drop_path(spark, table)
    out = rows.join(marks, (rows["_line_key"] == marks["key"]) & (rows["_line_twin"] == marks["twin"]), "left").select("_line_id", *[f"_line_c{k}" for k in range(len(carry))], "gone", "_text")
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = "_line_id long, " + "".join(f"_line_c{k} {fields[c]}, " for k, c in enumerate(carry)) + "n_lines long, n_removed long, kept string"
    return out.mapInArrow(settled(_strip), schema).toDF(id_col, *carry, "n_lines", "n_removed", "kept")
