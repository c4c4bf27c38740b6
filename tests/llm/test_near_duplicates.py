import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import embedding, graph, linededup, queries, simhash, substring

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, fp string, key string"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "x", "y") for i, t in rows], DOCS)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = make(60)
    out = []
    for i in range(n):
        text = make(rng.randrange(5, 120))
        if i % 7 == 0:
            text += "\n" + passage + " " + make(3)
        if i % 9 == 0 and out:
            text = out[-1][1]
        out.append((i, text))
    return out + [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (104, "one"), (None, out[3][1]), (3, out[3][1])]


def spread(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)] + [(5, 5), (200, 201), (200, 201)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    at = {x: i for i, x in enumerate(nodes)}
    pairs = {(at[a], at[b]) for a, b in edges if a != b} | {(at[b], at[a]) for a, b in edges if a != b}
    lab = spread(len(nodes), lambda a, b: (a, b) in pairs)
    least = {}
    for i, r in enumerate(lab):
        least[r] = min(least.get(r, nodes[i]), nodes[i])
    assert got == {nodes[i]: least[r] for i, r in enumerate(lab)}


def test_simhash(spark, monkeypatch):
    rows = corpus(2)
    base = rows[10][1] if rows[10][1] else "x"
    rows += [(200 + i, base + " extra" * (i % 3)) for i in range(12)]
    monkeypatch.setattr(simhash, "BLOCK", 4)
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    known = [(i, simhash.fingerprint((t or "").encode())) for i, t in rows if i is not None]
    lab = spread(len(known), lambda a, b: known[a][0] == known[b][0] or (known[a][1] ^ known[b][1]).bit_count() <= 3)
    least = {}
    for (i, _), r in zip(known, lab, strict=True):
        least[r] = min(least.get(r, i), i)
    expected = Counter((i, f"{f:016x}", least[r]) for (i, f), r in zip(known, lab, strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == expected
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("parts", [[(list(range(0, 22)), 1), (list(range(22, 43)), 0), (list(range(43, 64)), 0)], [(list(range(0, 32)), 1), (list(range(32, 64)), 1)], [(list(range(64)), 3)]])
def test_any_allocation_finds_all_links(spark, monkeypatch, parts):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(8)})
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "fp long, id long")
    monkeypatch.setattr(simhash, "plan", lambda *a: parts)
    got = dict(map(tuple, graph.components(simhash.link_edges(nodes)).collect()))
    lab = spread(len(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    least = {}
    for i, r in enumerate(lab):
        least[r] = min(least.get(r, i), i)
    assert all(got.get(i, i) == least[r] for i, r in enumerate(lab))


def test_plan_is_valid():
    rng = np.random.default_rng(0)
    for n in (0, 10, 10**6, 10**10):
        sample = rng.integers(0, 2**63, 500).astype(np.uint64)
        parts = simhash.plan(sample if n else sample[:0], n, 3)
        assert sum(t + 1 for _, t in parts) == 4 and len({b for p, _ in parts for b in p}) == sum(len(p) for p, _ in parts)


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((25, 16))
    vectors = [c + rng.standard_normal(16) * 0.07 for c in centres for _ in range(8)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    rows += [(500 + k, rows[0][1]) for k in range(5)] + [(600, [2 * x for x in rows[1][1]])]
    bad = [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [float("inf")] + [1.0] * 15), (704, [None] + [1.0] * 15), (705, []), (706, [1.0, 2.0]), (None, rows[2][1])]
    monkeypatch.setattr(embedding, "BLOCK", 20)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + bad], "vec_id long, embedding array<float>, id int")
    got = {r.vec_id: r for r in embedding.near_duplicates(df, leaf=40).collect()}
    e = np.array([v for _, v in rows])
    e /= np.linalg.norm(e, axis=1)[:, None]
    linked = e @ e.T >= 0.95
    np.fill_diagonal(linked, False)
    lab = spread(len(rows), lambda a, b: linked[a, b])
    least = {}
    for (i, _), r in zip(rows, lab, strict=True):
        least[r] = min(least.get(r, i), i)
    exact = [got[i].n_links == int(n) for (i, _), n in zip(rows, linked.sum(1), strict=True)]
    assert np.mean(exact) >= 0.99 and all(got[i].n_links <= n for (i, _), n in zip(rows, linked.sum(1), strict=True))
    assert np.mean([got[i].component_id == least[r] for (i, _), r in zip(rows, lab, strict=True)]) >= 0.99
    for i, _ in bad[:-1]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert embedding.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.01]), (3, [0.01, 3.0]), (4, [1.0, 1.0]), (4, [1.0, 1.0])]
    got = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (4, 1, 4, True)]


def brute_passages(rows, width):
    words = [(t or "").encode().split() for _, t in rows]
    counts = Counter(b" ".join(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if counts[b" ".join(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((doc, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return Counter(out)


def test_substrings(spark):
    rows = corpus(5) + [(300, "ab " * 200), (301, "é x " * 40 + "\x0b\x0c end")]
    got = substring.remove_repeated_passages(docs(spark, rows), batches=3)
    assert Counter(map(tuple, got.collect())) == brute_passages(rows, 35)
    assert substring.remove_repeated_passages(docs(spark, [])).count() == 0


def test_index_merges_and_compacts(spark):
    path = graph.scratch(spark, "test")
    index = substring.FingerprintIndex(spark, path, fanout=2)
    frame = lambda *fps: spark.createDataFrame([(f, 1) for f in fps], "fp long, n long")
    assert index.append(frame(1, 2, 2)).collect() == [(2, 2)]
    assert sorted(map(tuple, index.append(frame(1, 3)).collect())) == [(1, 2)]
    assert len(index.runs) == 2
    index.close()
    index = substring.FingerprintIndex(spark, path, fanout=2)  # goes on with the runs of the folder
    found = index.append(frame(3, 2, 4))
    assert sorted(map(tuple, found.collect())) == [(2, 3), (3, 2)]
    assert len(index.runs) == 2 and sorted(map(tuple, index.run(index.runs[0]).collect())) == [(1, 2), (2, 2), (3, 1)]
    joined = index.run(index.runs[1]).join(index.run(index.runs[0]).hint("merge"), "fp")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in joined and "Exchange" not in joined
    index.drop()


@pytest.mark.parametrize("fanout", [1, 2, 5])
def test_batches_in_turn_equal_brute_force(spark, fanout):
    rows = corpus(11, 40)
    got = substring.remove_repeated_passages(docs(spark, rows), batches=4, fanout=fanout)
    assert Counter(map(tuple, got.collect())) == brute_passages(rows, 35)


def test_passages_need_the_merge_join(spark, monkeypatch):
    """Copies that lie in unlike batches are found by the join alone."""
    monkeypatch.setattr(substring.FingerprintIndex, "run", lambda self, name: spark.table(self.tables[name]).filter("n < 0") if name in self.runs else spark.table(self.tables[name]))
    passages = [" ".join(f"p{j}x{k}" for k in range(40)) for j in range(12)]
    rows = [(2 * j + k, f"{p} own{j}x{k}") for j, p in enumerate(passages) for k in range(2)]
    got = [r.n_removed for r in substring.remove_repeated_passages(docs(spark, rows), batches=2).collect()]
    monkeypatch.undo()
    whole = [r.n_removed for r in substring.remove_repeated_passages(docs(spark, rows), batches=2).collect()]
    assert whole == [40] * 24 and sum(got) < sum(whole)


def test_edit_distance():
    rng = random.Random(6)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(12)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(12)))
        t = rng.choice([1, 2, 3])
        assert linededup.within(a, b, t) == (linededup._plain(a, b) <= t)


def edited(rng, line, edits):
    line = list(line)
    for _ in range(edits):
        p = rng.randrange(len(line))
        line[p : p + 1] = rng.choice(["", "é", line[p] + "z"])
    return "".join(line)


def stripped(text, least=20):
    """(place, line) of the lines that take part in the edit join."""
    return [(k, line.strip(" \t\r\x0b\x0c")) for k, line in enumerate((text or "").split("\n")) if len(line.strip(" \t\r\x0b\x0c")) >= least]


def different(spark, lines):
    counts = linededup._counts(*linededup._codes(pa.array(lines))) if lines else []
    return spark.createDataFrame([(k, x, len(x), bytearray(c.tobytes())) for k, (x, c) in enumerate(zip(lines, counts, strict=True))], "line long, words string, size int, counts binary")


def test_lines(spark, monkeypatch):
    rng = random.Random(7)
    pool = ["".join(rng.choice("abcdefgh éß") for _ in range(rng.randrange(22, 60))).strip().ljust(22, "x") for _ in range(25)]
    rows = [(i, "\n".join(edited(rng, rng.choice(pool), rng.randrange(4)) for _ in range(rng.randrange(1, 6))) + "\nshort\n") for i in range(40)]
    rows += [(100, None), (101, ""), (102, "  " + pool[0] + "\t\n" + pool[0]), (None, pool[1])]
    monkeypatch.setattr(linededup, "BLOCK", 3)
    got = {r.doc_id: r for r in linededup.remove_repeated_lines(docs(spark, rows)).collect()}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    occ = [(k, p, line) for k in order for p, line in stripped(rows[k][1])]
    texts = sorted({x for _, _, x in occ})
    lab = dict(zip(texts, spread(len(texts), lambda a, b: linededup._plain(texts[a], texts[b]) <= 2), strict=True))
    seen, gone = set(), Counter()
    for k, _, x in occ:
        gone[rows[k][0]] += lab[x] in seen
        seen.add(lab[x])
    assert {i: r.n_removed for i, r in got.items()} == {i: gone[i] for i, _ in rows}
    assert got[100].kept is None and got[101].kept == "" and all("short" in got[i].kept for i in range(40))
    assert linededup.remove_repeated_lines(docs(spark, [])).count() == 0


def test_wide_edit_distance():
    rng = random.Random(8)
    for _ in range(150):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(60, 160)))
        b = edited(rng, a, rng.randrange(70))
        t = rng.choice([5, 20, 31, 32, 45])
        assert linededup.within(a, b, t) == (linededup._plain(a, b) <= t)


def test_long_lines_link_by_their_length(spark):
    rng = random.Random(9)
    pool = ["".join(rng.choice("abcdefgh éß") for _ in range(n)).strip().ljust(n, "x") for n in (57, 60, 61, 80, 99, 100, 104, 140, 199, 200, 209, 399, 400, 420)]
    pool += ["-" * 90, "ab" * 60]
    lines = sorted({edited(rng, x, rng.randrange(2 * linededup.limit(len(x)))).strip() for x in pool for _ in range(9)})
    lines = [x for x in lines if len(x) >= linededup.MIN_CHARS]
    near = {(a, b): linededup._plain(a, b) <= linededup.limit(min(len(a), len(b))) for k, a in enumerate(lines) for b in lines[:k] if abs(len(a) - len(b)) <= 30}
    lab = spread(len(lines), lambda a, b: near.get((lines[a], lines[b]), False))
    least = {}
    for k, r in enumerate(lab):
        least[r] = min(least.get(r, k), k)
    table = different(spark, lines)
    got = dict(map(tuple, graph.components(linededup.link_edges(table)).collect()))
    assert all(got.get(k, k) == least[r] for k, r in enumerate(lab))
    at = {x: k for k, x in enumerate(lines)}
    pairs = {frozenset(r) for r in linededup.long_edges(table, first=10**6).collect()}
    assert {frozenset((at[a], at[b])) for (a, b), yes in near.items() if yes and min(len(a), len(b)) >= 60} <= pairs
    assert len(pairs) > 50
    # With two partners at a time the rest waits, and the same lines are connected.
    few = linededup.long_edges(table, first=2)
    assert few.count() < len(pairs)
    both = graph.components(few), graph.components(linededup.long_edges(table, first=10**6))
    assert sorted(map(tuple, both[0].collect())) == sorted(map(tuple, both[1].collect()))


def test_equal_windows_choose_equal_grams_at_few_places():
    rng = np.random.default_rng(11)
    codes = rng.integers(97, 123, 40000).astype(np.uint8)
    codes[30000:30500] = codes[100:600]
    for width in (15, 16, 17, 18, 19):
        chosen = linededup._chosen(np.concatenate([codes, np.zeros(width + 24, dtype=np.uint8)]), len(codes), width, linededup.STEPS)
        inside = 500 - width + 1
        assert (chosen[30000 : 30000 + inside] - 30000 == chosen[100 : 100 + inside] - 100).all()
        assert ((shift := chosen - np.arange(len(codes))) >= 0).all() and (shift < linededup.STEPS).all()
        assert len(np.unique(chosen)) < 0.3 * len(codes)


def test_a_cell_has_a_row_for_each_line_not_each_pair():
    pairs = np.array([(a, b, 0) for b in range(100) for a in range(b)], dtype="<i8")
    rows = [r for batch in linededup._celled(iter([linededup._dealt(np.zeros(len(pairs), dtype=np.uint16), pairs, 0).select(["bucket", "data"])])) for r in batch.to_pylist()]
    assert sorted(r["line"] for r in rows if r["line"] is not None) == list(range(100))
    assert len(rows) == 101 and {frozenset(x) for r in rows if r["data"] for x in np.frombuffer(r["data"], dtype="<i8").reshape(-1, 2).tolist()} == {frozenset(x[:2]) for x in pairs.tolist()}


def test_waiting_keys_travel_packed_and_lines_get_labels_once():
    """40 lines that share 50 keys: 40 rows of labels, not 2000; only lines with unlike labels meet."""
    number = lambda line, sig: (line, sig << 27 | 100 << 13 | 3 << 1 | 1)
    held = np.array([number(line, sig) for sig in range(50) for line in range(40)], dtype="<i8")
    keys = linededup._dealt(np.full(len(held), 5, dtype=np.uint32), held, 0).select(["bucket", "data"])
    lines = [r["line"] for b in linededup._lines_in(iter([keys])) for r in b.to_pylist()]
    assert lines == list(range(40))
    none = pa.nulls(1, pa.int64())
    rows = [pa.RecordBatch.from_arrays([keys.column(0), none, none, keys.column(1)], names=["bucket", "line", "label", "data"])]
    rows.append(pa.RecordBatch.from_arrays([pa.array([5] * 40), pa.array(lines), pa.array([0] * 38 + [38, 39]), pa.nulls(40, pa.binary())], names=["bucket", "line", "label", "data"]))
    got = [r for b in linededup._further(2, 5, 10**6, 4)(iter(rows)) for r in b.to_pylist()]
    pairs = {tuple(x) for r in got if not r["more"] for x in np.frombuffer(r["data"], dtype="<i8").reshape(-1, 3)[:, :2].tolist()}
    assert pairs == {(a, b) for b in (38, 39) for a in range(b)} and not any(r["more"] for r in got)
    got = [r for b in linededup._further(2, 5, 1, 4)(iter(rows)) for r in b.to_pylist()]
    assert {r["bucket"] for r in got if r["more"]} == {5} and sum(len(r["data"]) for r in got if r["more"]) == held.nbytes


def test_banded_distances_of_many_pairs():
    rng = random.Random(10)
    for edits in (3, 9, 28, 29, 70):
        a, b = [], []
        while len(a) < 24:
            x = "".join(rng.choice("abcd") for _ in range(rng.randrange(edits + 5, 5 * edits + 40)))
            y = edited(rng, x, rng.randrange(edits + 4)) if len(a) % 3 else "".join(rng.sample(x, len(x)))
            x, y = (x, y) if len(x) >= len(y) else (y, x)
            if len(x) - len(y) <= edits < len(y):
                a.append(x)
                b.append(y)
        points = [[np.frombuffer(s.encode("utf-32-le"), dtype="<u4") + np.uint32(3) for s in side] for side in (a, b)]
        for x, y, d in zip(a, b, linededup.distances(*points, edits), strict=True):
            true = linededup._plain(x, y)
            assert d == true if true <= edits else d > edits


def test_short_lines_repeat_once(spark, tmp_path):
    rows = [(1, "Les.\n\nAnd ornd.\nLes."), (2, " Les. \n\nAnd ornd!\nb"), (3, "b\n" + "a longer line of some words" + "\nLes"), (None, "b")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n_removed for r in queries.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, None: 1}
    kept = {r.doc_id: r.kept for r in linededup.remove_repeated_lines(docs(spark, rows), exact_from=1).collect()}
    assert kept == {1: "Les.\n\nAnd ornd.", 2: "\nAnd ornd!\nb", 3: "a longer line of some words\nLes", None: ""}


def test_near_dedup_finds_most_pairs_and_no_others(spark):
    """600 texts, half of them with some words changed: those with a similarity of 0.8 or more go, in nine of ten cases at least, and none below it."""
    rng = random.Random(11)
    words = [f"w{rng.randrange(10**5)}" for _ in range(4000)]
    rows, wanted, unlike = [], set(), set()
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for i in range(300):
        first = [rng.choice(words) for _ in range(rng.randrange(40, 400))]
        second = list(first)
        for _ in range(rng.choice([1, 1, 2, 3, 5, 9])):
            second[rng.randrange(len(second))] = f"z{rng.randrange(10**6)}"
        a, b = sets(first), sets(second)
        (wanted if len(a & b) >= 0.8 * len(a | b) else unlike).add(1000 + i)
        rows += [(i, " ".join(first)), (1000 + i, " ".join(second))]
    left = {r.doc_id for r in simhash.first_of_each(docs(spark, rows)).collect()}
    assert set(range(300)) <= left and unlike <= left
    assert len(wanted) > 100 and len(wanted & left) <= 0.1 * len(wanted)


def test_prints_of_whole_texts(spark):
    rows = [(1, "a b c d e f g"), (2, "A b c\nd E f g"), (3, ""), (4, "a b"), (5, "x " * 40_000)]
    got = {r.doc_id: r.fps for r in simhash.with_prints(docs(spark, rows).select("doc_id", "text"), "text", 5, 3, ("doc_id",)).collect()}
    assert got[1] == got[2] and len(set(got[1])) == 3 and got[3] == [0, 0, 0] and any(got[4]) and len(got[5]) == 3


def test_links_of_all_fingerprints_stay_in_few_pieces(spark, monkeypatch):
    pieces, real = [], simhash.components

    def counted(edges):
        pieces.append(edges._jdf.queryExecution().analyzed().collectLeaves().size())
        return real(edges)

    monkeypatch.setattr(simhash, "components", counted)
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, "something else")]
    assert {r.doc_id for r in simhash.first_of_each(docs(spark, rows)).collect()} == {1, 3}
    assert max(pieces) <= 2 + simhash.PARTS


def test_jobs_do_not_grow_with_the_fingerprints(spark, monkeypatch):
    """Each plan takes memory on the driver, so all fingerprints are probed by the same ones."""
    kept, real = [], simhash.keep
    monkeypatch.setattr(simhash, "keep", lambda df: kept.append(1) or real(df))
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, "something else")]
    counts = []
    for prints in (1, 4):
        kept.clear()
        assert {r.doc_id for r in simhash.first_of_each(docs(spark, rows), prints=prints).collect()} == {1, 3}
        counts.append(len(kept))
    assert counts[0] == counts[1]


def test_components_in_few_rounds(spark, monkeypatch):
    """A long chain and a star are contracted in the tasks that hold them, also piece by piece; a round writes files for each task."""
    rng = random.Random(5)
    chain = [(k, k + 1) for k in range(100, 1100)]
    star = [(2000, k) for k in range(2001, 2100)] + [(3000, 3000)]
    edges = chain + star
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "src long, dst long")
    kept, real = [], graph.keep
    monkeypatch.setattr(graph, "keep", lambda df: kept.append(1) or real(df))
    expected = {k: 100 for k in range(100, 1101)} | {k: 2000 for k in range(2000, 2100)}
    assert dict(map(tuple, graph.components(df).collect())) == expected
    assert len(kept) <= 4
    pieces = [pa.RecordBatch.from_pydict({"a": [x for x, _ in edges[i : i + 7]], "b": [y for _, y in edges[i : i + 7]]}) for i in range(0, len(edges), 7)]
    monkeypatch.setattr(graph, "EDGES", 50)
    again = [(x, y) for b in graph.contracted(iter(pieces)) for x, y in zip(*[c.to_pylist() for c in b.columns], strict=True)]
    assert all(x > y for x, y in again)
    assert dict(map(tuple, graph.components(spark.createDataFrame(again, "src long, dst long")).collect())) == expected
