"""The key index and the table by buckets: results, plans, replays, compaction."""

import random
import re

from pyspark.sql import functions as F

from corpusloom.operators.manifest import merge_tracks
from corpusloom.plans.schemas import TRACK
from corpusloom.sources.keyed import BucketTable, KeyIndex, States


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def urls(spark, numbers):
    return spark.createDataFrame([(f"j{n % 3}", f"https://e.com/{n}") for n in numbers], "job_id string, url_norm string")


KEY = ["job_id", "url_norm"]


def numbers(df):
    return sorted(int(r.url_norm.rsplit("/", 1)[1]) for r in df.collect())


def test_key_index_equals_a_set(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    for few in (0, 512):
        monkeypatch.setattr(KeyIndex, "FEW", few)
        index, known = KeyIndex(spark, str(tmp_path / f"i{few}"), buckets=4, fanout=3), set()
        for batch in range(8):
            given = [rng.randrange(150) for _ in range(40)]
            fresh = index.unseen(urls(spark, given), KEY, batch)
            assert numbers(fresh) == sorted(n for n in given if n not in known)
            index.add(fresh, KEY, batch)
            known |= set(given)
        assert len(index.state()["runs"]) < 8 and max(r["level"] for r in index.state()["runs"]) >= 1
        index.close()
        again = KeyIndex(spark, str(tmp_path / f"i{few}"), buckets=9)  # opened anew: the buckets are those of the runs
        assert numbers(again.unseen(urls(spark, range(150)), KEY)) == sorted(set(range(150)) - known)
        again.close()


def test_key_index_neither_shuffles_nor_sorts_its_runs(spark, tmp_path, monkeypatch):
    index = KeyIndex(spark, str(tmp_path / "i"), buckets=4)
    index.add(urls(spark, range(2000)), KEY, 0)
    index.add(urls(spark, range(2000, 2500)), KEY, 1)
    few = plan(index.hits(urls(spark, [5]), KEY))
    assert "SelectedBucketsCount: 1 out of 4" in few and re.search(r"PushedFilters: \[[^]]*(In|EqualTo)\(key", few)
    monkeypatch.setattr(KeyIndex, "FEW", 0)
    whole = plan(index.hits(urls(spark, range(100)), KEY))
    joins = whole.split("ShuffledHashJoin")[1:]
    assert len(joins) == 2
    for side in joins:  # the first child of a join is a run
        run = side[: side.index("FileScan parquet")]
        assert "Exchange" not in run and "Sort" not in run
    index.close()


def test_a_replayed_batch_of_keys_changes_nothing(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "i"), buckets=2, fanout=2)
    for batch in range(4):
        for _ in range(2):  # as a crash before the commit would have it
            fresh = index.unseen(urls(spark, [batch, batch + 1]), KEY, batch)
            assert numbers(fresh) == ([0, 1] if batch == 0 else [batch + 1])
            index.add(fresh, KEY, batch)
    assert numbers(index.unseen(urls(spark, range(7)), KEY)) == [5, 6]
    assert index.unseen(urls(spark, []), KEY).count() == 0
    nulls = spark.createDataFrame([(None, "x"), ("a", None)], "job_id string, url_norm string")
    index.add(nulls, KEY, 9)
    assert index.unseen(nulls, KEY).count() == 0
    index.close()


def test_states_keep_the_last_few(spark, tmp_path):
    states = States(spark, str(tmp_path / "s"), stay=2)
    for n in range(5):
        states.write(n, {"n": n})
    assert states.numbers() == [3, 4] and states.before(4) == {"n": 3} and states.before(None) == {"n": 4} and states.before(3) is None
    assert [s["n"] for s in states.write(4, {"n": 40})] == [3, 40]


def track(i, **more):
    row = dict.fromkeys(TRACK.fieldNames())
    return tuple((row | {"source": "s", "source_id": str(i), "title": f"t{i}", "status": "pending"} | more).values())


def tracks(spark, rows):
    return spark.createDataFrame(rows, TRACK)


def state(df):
    return sorted((r.source_id, r.title, r.status) for r in df.collect())


def test_bucket_table_equals_merge_tracks(spark, tmp_path):
    rng, table = random.Random(2), BucketTable(spark, str(tmp_path / "t"), ["source", "source_id"], buckets=6)
    plain = tracks(spark, [])
    for batch in range(5):
        new = {i: track(i, title=rng.choice([None, f"b{batch}"]), status=rng.choice(["done", "failed"])) for i in (rng.randrange(30) for _ in range(12))}
        rows = tracks(spark, list(new.values()))
        table.merge(rows, merge_tracks, batch)
        plain = spark.createDataFrame(merge_tracks(plain, rows).collect(), TRACK)
        assert state(table.read()) == state(plain)
        if batch == 2:
            table.merge(rows, merge_tracks, batch)  # a replay
            assert state(table.read()) == state(plain)
    table.rebucket(3)
    assert state(table.read()) == state(plain) and table.version()["buckets"] == 3


def test_a_batch_of_one_key_rewrites_one_bucket(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ["source", "source_id"], buckets=8)
    table.merge(tracks(spark, [track(i) for i in range(60)]), merge_tracks, 0)
    before, reader = table.version()["folders"], table.read()
    assert len(before) == 8
    assert len(table.merge(tracks(spark, [track(7, status="done")]), merge_tracks, 1)) == 1
    after = table.version()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert {r.status for r in reader.collect()} == {"pending"}  # the version before is still whole
    assert [r.source_id for r in table.read().filter("status = 'done'").collect()] == ["7"]
    table.merge(tracks(spark, []), merge_tracks, 2)
    assert table.version()["folders"] == after
    for n in range(3, 8):
        table.merge(tracks(spark, [track(7, status=f"s{n}")]), merge_tracks, n)
    folders = list((tmp_path / "t" / "data").iterdir())
    assert len(folders) <= 5 and table.read().count() == 60
    assert table.read().select(F.count_if(F.col("status") == "s7")).first()[0] == 1
