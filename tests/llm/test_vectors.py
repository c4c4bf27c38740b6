"""Codebooks, hard negatives and vantage-point trees against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import codebooks, negatives, queries, vantage

KIND = "vec_id long, embedding array<float>, label int, uid long, id string, v int, n long, dims string, query int, block int, shard int, window int, asks string, _id int, _label int, code string, error string"
CLASH = (1, "x", 2, 3, "d", 4, 5, 6, 7, "a", 8, 9, "c", "e")


def table(spark, rows):
    """Vectors with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, lab, *CLASH) for i, v, lab in rows], KIND)


def corpus(seed, n=160, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + 0.3 * rng.standard_normal(dims)
        rows.append([i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(rng.integers(3))])
    for i in range(20, 50):  # a group of copies
        rows[i][1] = rows[20][1]
    rows += [[200, None, 1], [201, [], 1], [202, [0.0] * dims, 1], [203, [math.nan, *rows[0][1][1:]], 2], [204, [math.inf, *rows[0][1][1:]], 2], [205, [None, *rows[0][1][1:]], 2]]
    rows += [[300, rows[3][1], None], [None, rows[4][1], 1], [7, rows[7][1], rows[7][2]], [100, rows[8][1], 0], [250, [1.0, 2.0], 1], [350, [1.0, 2.5], 1], [400, [0.5, 2.5], 2], [450, [3e38] * dims, 1], [500, [-3e38] * dims, 1]]
    return rows


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def floors(v, limit):
    return [math.floor(max(-limit, min(limit, 256 * float(np.float32(x))))) for x in v]


def plain_codes(rows, parts, entries, rounds):
    good = [(i, v, lab) for i, v, lab in rows if sound(v)]
    usable = sorted(((i is None, i or 0, v) for i, v, _ in good if v and len(v) % parts == 0), key=lambda r: r)[:entries]
    dims = len(usable[0][2])
    limit, width = 1 << (30 - (dims - 1).bit_length() // 2 - 1), dims // parts
    cut = lambda v: [floors(v, limit)[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, _, v in usable if len(v) == dims] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    own = [(i, cut(v), lab) for i, v, lab in good if len(v) == dims]
    for _ in range(rounds):
        found = [[near(p, x[p]) for p in range(parts)] for _, x, _ in own]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [x[p] for (_, x, _), c in zip(own, found, strict=True) if c[p] == e]
                if mine and e in {c[p] for c in found}:
                    mine = [sum(z) // len(mine) for z in zip(*mine, strict=True)]
                    books[p] = books[p][:e] + [("new", mine)] + books[p][e + 1 :]
            books[p] = [b[1] if isinstance(b, tuple) else b for b in books[p]]
    out = []
    for i, x, lab in own:
        codes = [near(p, x[p]) for p in range(parts)]
        out.append((i, "".join(f"{c:02x}" for c in codes), sum(far(x[p], books[p][codes[p]]) for p in range(parts)), lab))
    return out, books


def test_codes(spark):
    rows = corpus(1)
    got = codebooks.compress(table(spark, rows), parts=4, entries=9).collect()
    expected, books = plain_codes(rows, 4, 9, 2)
    total = Counter()
    for _, _, error, lab in expected:
        total[lab] += error
    assert Counter((r.vec_id, r.code, r.error) for r in got if r.code is not None) == Counter(x[:3] for x in expected)
    by_code = {(r.vec_id, r.code): r.label_error for r in got if r.code is not None}
    assert all(by_code[i, c] in (total[lab], *[total[x[3]] for x in expected if x[0] == i]) for i, c, _, lab in expected)
    assert by_code[300, next(c for i, c, _, _ in expected if i == 300)] == total[None]
    assert sorted(r.vec_id for r in got if r.code is None) == [201, 250, 350, 400]
    digest = codebooks.Codebooks(np.array(books), 256).digest()
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_codes_of_few_and_of_none(spark):
    assert codebooks.compress(table(spark, [])).count() == 0
    assert [r.code for r in codebooks.compress(table(spark, [[1, [1.0, 2.0, 3.0], 1]]), parts=2).collect()] == [None]
    got = codebooks.compress(table(spark, [[5, [1.0, 2.0], None], [3, [1.0, 2.0], None]]), parts=2).collect()
    assert {(r.vec_id, r.code, r.error, r.label_error) for r in got} == {(3, "0000", 0, 0), (5, "0000", 0, 0)}


@pytest.mark.parametrize("width", [1, 2, 4])
def test_kd_tree_finds_the_lowest_of_the_nearest(width):
    rng = np.random.default_rng(width)
    points, x = rng.integers(-6, 6, (64, width)), rng.integers(-9, 9, (500, width))
    who, far = codebooks.nearest(codebooks.tree(points), points, x)
    every = ((x[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    assert (far == every.min(axis=1)).all() and (who == every.argmin(axis=1)).all()


def test_decoded_codes_are_near():
    entries = np.arange(24).reshape(2, 4, 3)
    books = codebooks.Codebooks(entries, 256)
    assert (books.decode(np.array([[1, 3]])) == (np.array([[3, 4, 5, 21, 22, 23]]) + 0.5) / 256).all()


def plain_negatives(rows, positives, wanted):
    own = [(k, i, floors(v, negatives.LIMIT), lab) for k, (i, v, lab) in enumerate(rows) if sound(v) and lab is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    last = lambda i: (i is None, i or 0)
    out = []
    for k, i, a, lab in own:
        if i is None or i % 50:
            continue
        scored = sorted(((-dot(a, b), *last(j), j, la) for m, j, b, la in own if m != k and len(a) == len(b)), key=lambda r: r[:3])
        for score, _, _, j, _ in [r for r in scored if r[4] == lab][:positives]:
            hard = [r for r in scored if r[4] != lab and 50 * -score <= 100 * -r[0] <= 95 * -score][:wanted]
            out += [(i, j, n + 1, r[3], -score, -r[0]) for n, r in enumerate(hard)]
    return out


@pytest.mark.parametrize("blocks", [None, 7])
def test_negatives(spark, monkeypatch, blocks):
    if blocks:
        for name in ("ROWS", "LEAST_ROWS", "ANCHORS", "STEP"):
            monkeypatch.setattr(negatives, name, blocks)
        monkeypatch.setattr(negatives, "DIGIT", 7)
    rows = corpus(2)
    got = negatives.mine(table(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert len(got) > 20
    assert Counter(map(tuple, got)) == Counter(plain_negatives(rows, 5, 3))
    assert negatives.mine(table(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.mine(table(spark, rows), F.col("vec_id") < -5).count() == 0


def test_negatives_where_a_third_of_the_rows_are_one(spark):
    rng = random.Random(3)
    rows = [[i, [rng.random() for _ in range(4)], rng.randrange(2)] for i in range(120)] + [[i, [0.5, 0.5, 0.4, 0.5], i % 2] for i in range(120, 180)] + [[9, [0.4] * 4, 1]] * 30
    got = negatives.mine(table(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert Counter(map(tuple, got)) == Counter(plain_negatives(rows, 5, 3))


def test_scores_beyond_doubles_are_exact():
    a, b = np.array([[(1 << 24), (1 << 24) - 1] * 64]), np.array([[(1 << 24) - 3, -(1 << 24)] * 64])
    assert negatives.scores(a, b)[0, 0] == sum(int(x) * int(y) for x, y in zip(a[0], b[0], strict=True))


def plain_neighbours(rows, every, k):
    own = [(m, i, v) for m, (i, v, _) in enumerate(rows) if sound(v) and any(v)]
    out = []
    for m, i, a in own:
        if i is None or i % every:
            continue
        far = []
        for n, j, b in own:
            if n != m and len(a) == len(b):
                total = 0.0
                for x, y in zip(a, b, strict=True):
                    total += (float(np.float32(x)) - float(np.float32(y))) ** 2
                far.append((math.sqrt(total), j is None, j or 0, j))
        out += [(i, r + 1, f[3], f[0]) for r, f in enumerate(sorted(far, key=lambda f: f[:3])[:k])]
    return out


@pytest.mark.parametrize("leaf", [3, 64])
def test_neighbours(spark, monkeypatch, leaf):
    for name, size in (("LEAF", leaf), ("SHARD", 40), ("LEAST_SHARD", 40), ("QUERIES", 3)):
        monkeypatch.setattr(vantage, name, size)
    rows = corpus(4)
    got = vantage.neighbours(table(spark, rows), F.col("vec_id") % 5 == 0).collect()
    assert Counter(map(tuple, got)) == Counter(plain_neighbours(rows, 5, 10))
    assert vantage.neighbours(table(spark, []), F.col("vec_id") % 5 == 0).count() == 0
    assert vantage.neighbours(table(spark, [[1, [1.0], 0], [None, [1.5], 0], [None, None, None]]), F.col("vec_id") == 1).collect() == [(1, 1, None, 0.5)]


def test_neighbours_among_many_copies(spark):
    rows = [[i, [1.0, 2.0, 3.0], 0] for i in range(400)] + [[400, [1.0, 2.0, 3.5], 0], [500, [9.0, 0.0, 0.0], 0]]
    got = vantage.neighbours(table(spark, rows), F.col("vec_id") % 100 == 0).collect()
    assert Counter(map(tuple, got)) == Counter(plain_neighbours(rows, 100, 10))


def test_a_relaxed_search_looks_at_less_and_finds_most():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    points = centres[rng.integers(40, size=4000)] + 0.4 * rng.standard_normal((4000, 16))
    queries, ids = points[:100] + 0.05 * rng.standard_normal((100, 16)), np.arange(4000)
    tree, order = vantage.Tree.grown(points, 1)
    every = vantage.lengths(queries[:, None, :] - points[None, :, :])
    truth = np.argsort(every, axis=1, kind="stable")[:, :10]
    looked, found = {}, {}
    for relax in (1.0, 1.5):
        search = vantage.Search(tree, order, order, queries, np.full(100, -1), 10, relax)
        search.run()
        looked[relax], found[relax] = search.looked, ids[order][search.at]
    assert (found[1.0] == truth).all()
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found[1.5], truth, strict=True)])
    assert recall >= 0.9 and looked[1.5] < 0.8 * looked[1.0] < 0.8 * 100 * 4000


def test_the_thin_query_moves_labels_first(spark, tmp_path):
    rows = [[i, v, lab] for i, v, lab in corpus(6) if i is not None]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    moved = [[i, v, (lab + 1) % 10 if lab is not None and i % 7 == 0 else lab] for i, v, lab in rows]
    got = queries.op12_hard_negatives(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_negatives(moved, 5, 3))
