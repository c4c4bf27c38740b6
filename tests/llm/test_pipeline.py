import random

import duckdb

import corpus_pipeline
from corpusloom.llm import bpe, mixing, queries, simhash


def test_mix_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    expected = con.sql(mixing.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.op6_mixing(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got[expected.columns] == expected).all().all()


def test_stages(spark, tmp_path):
    clean = [(i, f"the quick brown fox number {i} jumps over lazy dogs again and again\nanother line of document {i} with more plain words in it", "en", f"s{i % 2}", 0) for i in range(30)]
    rows = clean + [(50, clean[3][1], "en", "s0", 0), (51, clean[4][1] + " tail", "en", "s1", 0), (60, None, "en", None, 0), (61, "", None, "s0", 0), (62, "12345 67890", "en", "s0", 0), (3, clean[3][1], "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], "").write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert seen[-1].columns == corpus_pipeline.COLUMNS
    kept = {r.doc_id for r in seen[1].collect()}
    assert {i for i, *_ in clean} <= kept and not kept & {60, 61, 62}
    lined = {r.doc_id: r.text for r in seen[2].collect()}
    assert lined[0] == clean[0][1] and 50 not in lined
    near = [r.doc_id for r in seen[3].collect()]
    assert len(near) == len(set(near))
    ids = seen[5].collect()
    assert len(ids) == seen[4].count() and all(r.exact for r in ids)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix_sources", "tokenize"] and bpe.RANK_FILE.endswith(".tiktoken")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def shingles(text, width=5):
    words = text.lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def test_near_copies_by_similarity(spark, monkeypatch):
    rng = random.Random(3)
    texts = []
    for _ in range(4):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        texts.append(" ".join(base))
        for n in (1, 2, 3, 4, 8):
            words = list(base)
            for k in range(n):
                words[10 + 12 * k] = f"x{n}y{k}"
            texts.append(" ".join(words))
        texts.append(" ".join(rng.sample(base, 120)))
    texts += ["a b", "A  B", "c d e f g h"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    sets, prints = [shingles(t) for t in texts], [simhash.fingerprint(t.encode(), 5) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(len(texts)):
                if (prints[a] ^ prints[b]).bit_count() <= 12 and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert len(set(label)) < len(texts) - 6
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(label)
    monkeypatch.setattr(simhash, "LARGE", 3)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(label)


def test_near_dedup_keeps_unlike_texts_of_an_id(spark):
    text = lambda k: " ".join(f"word{k}x{i}" for i in range(30))
    rows = [(1, text(1)), (1, text(2)), (1, text(2)), (2, text(2)), (3, text(3)), (None, text(3)), (None, text(4)), (None, text(4)), (None, text(4) + " tail")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text.removesuffix(" tail")) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, text(1)), (1, text(2)), (3, text(3)), (None, text(4))], key=str)
