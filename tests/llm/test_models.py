import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from corpusloom.llm import attention, bpe, langid, mixing, rules, textkernel, toxicity

DOCS = "doc_id long, text string, lang string, source string, label int, order int, score double, n long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, 0, 0.0, 0) for i, t, lang, s in rows], DOCS)


EDGES = [(9001, None, "en", None), (9002, "", "en", "s"), (9003, " \n ", None, "s"), (9004, "123 !?", "en", "s"), (None, "abc abc", "en", "s"), (9005, "x" * 70000 + " y", "en", "s"), (9005, "x" * 70000 + " y", "en", "s")]


def speech(rng, letters, n=60):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_kernel():
    import pyarrow as pa

    texts = ["a b  c", None, "", "é\tx\x0by", " lead", "tail ", "a b  c"]
    out = []
    for block in textkernel.blocks(pa.array(texts), max_bytes=8):
        for r in range(block.last - block.first):
            a, b = block.rows[r], block.rows[r + 1]
            out.append([block.data[s:e].tobytes().decode() for s, e in zip(block.starts[a:b], block.ends[a:b], strict=True)])
    assert out == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    whole = next(textkernel.blocks(pa.array(["q w e q w e r"])))
    w = textkernel.window_hashes(whole.hashes(), 3)
    assert w[0] == w[3] and len(set(w.tolist())) == 4
    keys = np.array([5, 3, 9, 1, 7, 8], dtype=np.uint64)
    assert textkernel.slide_min(keys, 3).tolist() == [3, 1, 1, 1]


def test_language_id(spark):
    rng = random.Random(1)
    kinds = {"aa": "aeiouklm", "bb": "rstnxyzé", "cc": "ßöüdfghj"}
    rows = [(i, speech(rng, kinds[k]), k, "s") for i, k in enumerate(rng.choice(list(kinds)) for _ in range(90))] + EDGES
    got = langid.identify(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == k and by[i].score > 0.99 and by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, k, _ in rows[:90])
    assert [by[i].lang_pred for i in (9001, 9002, 9003, 9004)] == ["und"] * 4 and by[None].held_out
    assert langid.identify(docs(spark, [])).count() == 0
    assert {r.lang_pred for r in langid.identify(docs(spark, [(1, "abc", None, "s")])).collect()} == {"und"}


def test_code_lengths_are_exact():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 101, 400).astype(np.uint8)
    padded = np.concatenate([np.full(3, 10, np.uint8), text]).astype(np.uint64)
    grams = (padded[:-3] << np.uint64(24)) | (padded[1:-2] << np.uint64(16)) | (padded[2:-1] << np.uint64(8)) | padded[3:]
    keys, counts = np.unique(grams, return_counts=True)
    tree = langid.Tree(keys, counts.astype(float))
    for context in (b"abc", b"zzz", b"zab", b"\n\n\n"):  # every context's shares add up to one
        base = int.from_bytes(context, "big") << 8
        assert abs(np.exp2(-tree.cost(np.array([base | b for b in range(256)], dtype=np.uint64))).sum() - 1) < 1e-9
    model = langid.Model({"x": (keys, counts.astype(float))})
    bits = model.bits(text, np.array([0, 100, 100, 400]))
    assert np.allclose(bits.sum(), tree.cost(grams).sum(), rtol=1e-3, atol=60) and bits[0, 1] == 0


def test_bpe(spark):
    ranks = bpe.load_ranks()
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "Hello world, it's 2024!  \n\n  x", "en", "s"), (2, "日本語 ñandú \U0001f600 a b c", "en", "s"), (3, "!" * 500 + "<|endoftext|>", "en", "s"), *EDGES]
    enc = bpe.encode(docs(spark, rows), carry=("doc_id", "text"))
    got = bpe.decode(enc, carry=("doc_id", "text", "ids")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r.ids) == real.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    both = bpe.encode(docs(spark, rows), carry=("doc_id", "text"), decoded=True).collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in both) == Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got)
    words = ["hello", " world", "a", "", "ñandú", "zzzzqqqq", "\n\n", "antidisestablishment"]
    folded = bpe.encode_words(spark.createDataFrame([(bytearray(w.encode()),) for w in words], "word binary"), ranks).collect()
    assert [list(r.ids) for r in folded] == [real.encode_ordinary(w) if w else [] for w in words]
    assert bpe.encode(docs(spark, [])).count() == 0


def reference_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            out |= share
            break
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, speech(rng, "abc", rng.randrange(40)), "en", rng.choice(["a", "b", "ä", None, "hot", "hot", "hot"])) for i in range(300)] + EDGES
    got = mixing.mix(docs(spark, rows).withColumn("_size", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in got:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r._size == n and 0 <= r._copies <= 2
        sizes[r.source] += n
    want = reference_targets(sizes)
    longest = max(r._size for r in got)
    for s, n in sizes.items():
        own = [r for r in got if r.source == s]
        assert own[0]._source_size == n and own[0]._target == pytest.approx(want[s])
        assert abs(sum(r._size * r._copies for r in own) - want[s]) <= longest
    again = Counter((r.doc_id, r._copies) for r in mixing.mix(docs(spark, rows)).collect())
    assert again == Counter((r.doc_id, r._copies) for r in got)
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.repeated(mixing.mix(docs(spark, rows)), ["doc_id"]).count() == sum(r._copies for r in got)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    rng = random.Random(4)
    rows = []
    for i in range(500):
        words = speech(rng, "abcdefgh", 40).split()
        if i % 4 == 0:
            words[rng.randrange(40)] = rng.choice(["vile,", "NASTY"])
        rows.append((i, " ".join(words), "en", "s"))
    d = docs(spark, rows + EDGES)
    lab = labels(spark, [(i, 1, int(i % 4 == 0)) for i in range(500)] + [(None, 1, 1), (3, None, None), (9001, 1, None)])
    got = {r.doc_id: r for r in toxicity.classify(d, lab).collect()}
    held = [i for i in range(500) if got[i].held_out]
    assert held == [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == int(i % 4 == 0) for i in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[9001].score == got[9002].score
    assert toxicity.classify(docs(spark, []), lab).count() == 0
    assert {r.score for r in toxicity.classify(d, lab.limit(0)).collect()} == {0.5}


def test_attention(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        text = speech(rng, "abcdefgh", 120).split()
        if i % 3 == 0:
            text[60:100] = [w.upper() + "###" for w in text[60:100]]
        rows.append((i, " ".join(text), "en", "s"))
    d, lab = docs(spark, rows + EDGES), labels(spark, [(i, int(i % 3 != 0), 0) for i in range(300)])
    got = {r.doc_id: r for r in attention.classify(d, lab).collect()}
    held = [i for i in range(300) if got[i].held_out]
    assert np.mean([got[i].predicted == int(i % 3 != 0) for i in held]) >= 0.95
    assert len(got) == 300 + len(EDGES) - 1 and {r.score for r in attention.classify(d, lab.limit(0)).collect()} == {0.5}
    assert attention.classify(docs(spark, []), lab).count() == 0


def test_attention_gradient():
    rng = np.random.default_rng(6)
    p = attention.unpack(rng.standard_normal(3000) * 0.3)
    x, first, y = rng.standard_normal((7, attention.WIDTH)), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])
    grads = attention.gradient(p, x, first, y)

    def loss():
        s = attention.forward(p, x, first)[0]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name, g in grads.items():
        at = tuple(0 for _ in g.shape)
        p[name][at] += 1e-6
        up = loss()
        p[name][at] -= 2e-6
        down = loss()
        p[name][at] += 1e-6
        assert (up - down) / 2e-6 == pytest.approx(g[at], abs=1e-5)


def test_rules(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        words = speech(rng, "abcdefgh", 80).split()
        if i % 5 == 0:
            words = [w + "#$" for w in words]
        if i % 11 == 1:
            words = (words[:4] * 30)[:80]
        rows.append((i, "\n".join(" ".join(words[k : k + 10]) for k in range(0, 80, 10)), "en", "s"))
    d, lab = docs(spark, rows + EDGES), labels(spark, [(i, int(i % 5 != 0), 0) for i in range(400)])
    got = rules.judge(d, lab).collect()
    assert len(got) == 400 + len(EDGES)
    text_of = {i: t for i, t, *_ in rows + EDGES}
    for r in got:
        t = text_of[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        c, hit = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), set()
        for i in range(len(w) - 2):
            if c[tuple(w[i : i + 3])] > 1:
                hit |= {i, i + 1, i + 2}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.base_failed and r.kept)
    sound = [r for r in got if not r.base_failed and r.doc_id is not None and r.doc_id < 400]
    assert np.mean([r.kept == (r.doc_id % 5 != 0) for r in sound]) >= 0.98
    assert all(r.kept != r.base_failed for r in rules.judge(d, lab.limit(0)).collect()) and rules.judge(docs(spark, []), lab).count() == 0
