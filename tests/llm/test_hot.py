"""One line, one passage, one text and a missing id in most rows; invalid bytes; names that clash."""

from collections import Counter

from pyspark.sql import functions as F

from corpusloom.llm import bpe, linededup, mixing, simhash, substring
from test_near_duplicates import brute_passages, docs


def rows():
    line = "this very line stands in most of the documents of this table"
    passage = " ".join(f"p{k}" for k in range(45))
    out = [(None, f"{line}\nown line number {k} of a row without an id {k * 7919}\n{passage} end{k}") for k in range(150)]
    return out + [(None, line)] * 100 + [(7, line)] * 20 + [(k, f"a document {k} with words of its own {k * 104729} and no other") for k in range(20, 40)]


def test_common_lines(spark):
    table = rows()
    got = linededup.remove_repeated_lines(docs(spark, table), exact_from=1).collect()
    assert len(got) == len(table)
    line = table[0][1].split("\n")[0]
    # Rows that share id and text are one document; the first by id keeps the line.
    assert sum(r.kept.count(line) for r in got if r.doc_id == 7) == 20 and not any(line in r.kept for r in got if r.doc_id is None)
    assert sum(r.n_removed for r in got if r.doc_id is not None and r.doc_id >= 20) == 0


def test_common_passages(spark):
    table = rows()
    got = substring.remove_repeated_passages(docs(spark, table))
    assert Counter(map(tuple, got.collect())) == brute_passages(table, 35)


def test_common_ids_in_a_mix(spark):
    mixed = mixing.mix(docs(spark, rows()))
    total = mixed.agg(F.sum("_size"), F.max("_target"), F.sum(F.col("_size") * F.col("_copies"))).first()
    assert abs(total[2] - total[1]) <= max(len(t.split()) for _, t in rows()) and abs(total[1] - 1.5 * total[0]) < 1e-6
    again = mixing.mix(docs(spark, rows()))
    key = ["doc_id", "text", "_copies"]
    assert Counter(map(tuple, mixed.select(*key).collect())) == Counter(map(tuple, again.select(*key).collect()))


def test_common_texts_in_near_dedup(spark):
    table = rows()
    kept = simhash.first_of_each(docs(spark, table)).collect()
    texts = [r.text for r in kept]
    assert len(texts) == len(set(texts)) and {t for i, t in table if i is not None and i >= 20} <= set(texts)


def test_invalid_bytes(spark):
    """A string column may hold bytes that are no UTF-8; they are replaced or kept, and nothing stops."""
    df = spark.createDataFrame([(1, bytearray(b"good line of text here\n\xff\xfe bad line \xc3 of text\nx")), (2, bytearray(b"\xff\xfe bad line \xc3 of text"))], "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    assert {r.doc_id: r.n_removed for r in linededup.remove_repeated_lines(df, exact_from=1).select("doc_id", "n_removed").collect()} == {1: 0, 2: 1}
    assert substring.remove_repeated_passages(df).select("doc_id", "n_words").count() == 2
    assert bpe.encode(df, decoded=True).filter(F.length("decoded") > 0).count() == 2
    assert simhash.near_duplicates(df).count() == 2 and mixing.mix(df.withColumn("source", F.lit("s"))).count() == 2


def test_clashing_names(spark):
    df = docs(spark, [(1, "one line of text\none line of text"), (2, None)]).withColumns({"gone": F.lit(5), "kept": F.lit("k"), "n_lines": F.lit(1), "ids": F.lit(2), "_size": F.lit(3)})
    got = linededup.remove_repeated_lines(df, carry=("gone", "kept", "n", "key"), exact_from=1)
    assert got.columns == ["doc_id", "gone", "n", "key", "n_lines", "n_removed", "kept"]
    assert [(r.gone, r.n_removed, r.kept) for r in got.orderBy("doc_id").collect()] == [(5, 1, "one line of text"), (5, 0, None)]
    assert mixing.mix(df).columns.count("_size") == 1 and bpe.encode(df).columns == ["doc_id", "ids"]


def test_words_for_the_fold_come_from_rows_whatever_their_ids(spark):
    texts = spark.range(3000).select((F.col("id") % 7).cast("string").alias("k")).select(F.concat_ws(" ", F.lit("some"), F.lit("words"), "k").alias("text"))
    for ids in (F.lit(None).cast("long"), F.lit(5).cast("long"), F.monotonically_increasing_id()):
        found = bpe.frequent_words(texts.withColumn("doc_id", ids), bpe.public_tokenizers.PATTERN, sample=300)
        assert {"some", " words"} <= set(found)
    assert bpe.frequent_words(texts.limit(0), bpe.public_tokenizers.PATTERN) == []
    one = bpe.frequent_words(texts, bpe.public_tokenizers.PATTERN, words=2)
    assert len(one) == 2
