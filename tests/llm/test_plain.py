"""The operators' kernels against plain versions written from their definitions, without arrays."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash

from corpusloom.llm import attention, langid, rules, simhash, textkernel, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, width=3):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in text)
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s, seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_fingerprint():
    rng = random.Random(1)
    texts = ["", " \n\t", "One", "one two", "one Two THREE", "É É é\x1cx y\x0bz", "a b " * 40, "x\u00a0y z"]
    texts += [" ".join(rng.choice("abcXYZé") * rng.randrange(1, 4) for _ in range(rng.randrange(3, 200))) for _ in range(30)]
    texts.append(" ".join(str(rng.randrange(999)) for _ in range(40_000)))  # more shingles than are hashed at a time
    for t in texts:
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t.encode()), t[:40]
        assert simhash.fingerprint(t.encode(), 5) == plain_fingerprint(t.encode(), 5)


def test_shingle_sets_have_the_right_similarity():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    plain = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t.split() else set() for t in texts]
    sets = simhash.shingle_sets(pa.array(texts), 5)
    for a in range(len(texts)):
        for b in range(a):
            assert len(np.intersect1d(sets[a], sets[b])) == len(plain[a] & plain[b])


def plain_ppm(counts, text):
    """Bits of a text: PPM with method C escapes and exclusion; counts[k] maps a context of k bytes to a Counter."""
    data, bits = b"\n" * langid.ORDER + text, 0.0
    for i in range(langid.ORDER, len(data)):
        excluded = set()
        for k in range(langid.ORDER, -1, -1):
            seen = counts[k].get(data[i - k : i])
            if seen is None:
                continue
            left = {c: n for c, n in seen.items() if c not in excluded}
            total = sum(left.values()) + len(left)
            if data[i] in left:
                bits += math.log2(total / left[data[i]])
                break
            if left:
                bits += math.log2(total / len(left))
            excluded |= set(seen)
        else:
            bits += math.log2(256 - len(excluded))
    return bits


def test_code_lengths():
    rng = random.Random(3)
    samples = {"aa": ["".join(rng.choice("abc d") for _ in range(rng.randrange(5, 80))) for _ in range(20)], "bb": ["".join(rng.choice("bcde é") for _ in range(rng.randrange(5, 80))) for _ in range(20)]}
    trained, plain = {}, {}
    for lang, texts in samples.items():
        grams, counts = Counter(), [defaultdict(Counter) for _ in range(langid.ORDER + 1)]
        for t in texts:
            data = b"\n" * langid.ORDER + t.encode()
            for i in range(langid.ORDER, len(data)):
                grams[int.from_bytes(data[i - langid.ORDER : i + 1], "big")] += 1
                for k in range(langid.ORDER + 1):
                    counts[k][data[i - k : i]][data[i]] += 1
        keys = sorted(grams)
        trained[lang] = (np.array(keys, dtype=np.int64), np.array([grams[k] for k in keys], dtype=np.float64))
        plain[lang] = counts
    model = langid.Model(trained)
    texts = [*samples["aa"][:4], *samples["bb"][:4], "zzz", "abca\tbc", "", "Ünlike 123"]
    block = next(textkernel.blocks(pa.array(texts)))
    got = model.bits(block.data, block.offsets)
    for k, lang in enumerate(model.langs):
        for r, t in enumerate(texts):
            assert abs(got[k, r] - plain_ppm(plain[lang], t.encode())) < 1e-3 * max(1, len(t))


def test_ftrl():
    rng = random.Random(4)
    rows = [sorted({0, *(rng.randrange(1, 30) for _ in range(rng.randrange(6)))}) for _ in range(80)]
    labels = [int(3 in r or (5 in r and 7 in r)) for r in rows]
    alpha, beta, l1, l2, epochs = 0.5, 1.0, 0.3, 0.1, 3
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for y, row in zip(labels, rows, strict=True):
            w = {i: weight(i) for i in row}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in row:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    got = toxicity.ftrl(np.array(labels), [np.array(r) for r in rows], epochs, alpha, beta, l1, l2)
    assert all(abs(got[i] - weight(i)) < 1e-9 for i in range(30)) and (got[30:] == 0).all() and (got != 0).any()


def test_ngrams():
    texts = ["a b c a b", "", "d", "b c a"]
    block = next(textkernel.blocks(pa.array(texts), gaps=textkernel.PUNCTUATION, lowered=True))
    row, place = toxicity.features(block)
    found = [Counter(place[row == r].tolist()) for r in range(len(texts))]
    for counter, t in zip(found, texts, strict=True):
        w = t.split()
        plain = [*w, *zip(w, w[1:]), *[("skip", x, y) for x, y in zip(w, w[2:])]]
        assert sorted(counter.values()) == sorted(Counter(plain).values())
    assert len(found[0] & found[3]) == len({"a", "b", "c", ("b", "c"), ("c", "a"), ("skip", "b", "a")})


def test_attention_forward():
    rng = np.random.default_rng(5)
    flat = rng.standard_normal(sum(int(np.prod(s)) for _, s in attention._SHAPES)) * 0.3
    p = attention.unpack(flat)
    first = np.array([0, 1, 4, 6])
    x = rng.standard_normal((6, attention.WIDTH))
    got, state = attention.forward(p, x, first)
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    for bag in range(3):
        codes, scores = [], []
        for row in x[first[bag] : first[bag + 1]]:
            code = [math.tanh(sum((row[i] - p["mean"][i]) * p["scale"][i] * p["E"][i, j] for i in range(attention.WIDTH)) + p["e"][j]) for j in range(attention.CODE)]
            gate = [math.tanh(sum(code[i] * p["V"][i, j] for i in range(attention.CODE))) * sigmoid(sum(code[i] * p["U"][i, j] for i in range(attention.CODE))) for j in range(attention.GATE)]
            codes.append(code)
            scores.append(math.exp(sum(gate[j] * p["w"][j] for j in range(attention.GATE))))
        share = [s / sum(scores) for s in scores]
        whole = [sum(a * c[j] for a, c in zip(share, codes, strict=True)) for j in range(attention.CODE)]
        assert abs(got[bag] - sigmoid(sum(whole[j] * p["c"][j] for j in range(attention.CODE)) + p["b"][0])) < 1e-9
        assert np.allclose(state[3][first[bag] : first[bag + 1]], share)


def plain_statistics(text):
    words, lines = WORD.findall(text.encode()), [x for x in text.split("\n") if WORD.search(x.encode())]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_where_hashes_collide(spark):
    morse = "a"
    for _ in range(12):
        morse += morse.translate(str.maketrans("ab", "ba"))
    other = morse.translate(str.maketrans("ab", "ba"))
    assert len(set(textkernel.span_hashes(np.frombuffer((morse + other).encode(), dtype=np.uint8), np.array([0, 4096]), np.array([4096, 8192])).tolist())) == 1
    texts = [f"{morse}\n{other}\n{morse}", f"{morse} x y {other} x y z", f"{morse} x y {morse} x y {other}", "a b c\na b c\n\n d", "é é é é\n#$", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.statistics(df).collect()}
    assert got == {k: plain_statistics(t) for k, t in enumerate(texts)}


def test_rule_verdicts(spark):
    table = [rules.Rule([("upper_share", True, 0.5)]), rules.Rule([("digit_share", True, 0.2), ("symbols_per_word", False, 0.1)])]
    texts = ["ABC def", "abc", "12 ab", "12 #### ab", "", "AB CD 12"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.keep for r in rules.statistics(df).select("doc_id", rules.verdict(table).alias("keep")).collect()}
    for k, t in enumerate(texts):
        chars = sum(len(w) for w in t.split()) or 1
        upper, digits, symbols = sum(c.isupper() for c in t) / chars, sum(c.isdigit() for c in t) / chars, t.count("#") / max(1, len(t.split()))
        assert got[k] == (not (upper >= 0.5 or (digits >= 0.2 and symbols < 0.1)))
