"""Walks over landed catalogs, their limits, and the Python data sources."""

import json

import pytest

from corpusloom.sources import catalogs, landed

PAGE = "offset long, headers struct<status:string>, results array<struct<id:string,name:string,artist_name:string,album_name:string,license_ccurl:string,audiodownload:string,audiodownload_allowed:boolean,shareurl:string>>"


def track(i, good=True):
    return (str(i), "n", "a", "al", "http://c/licenses/by/3.0/", "x" if good else "", True, "s")


def walk(spark, sizes, limit=None, stop=3, bad=()):
    """Pages of so many tracks, each page's last not downloadable if it has three or more; returns the ids that the walk lists."""
    rows, n = [], 0
    for k, size in enumerate(sizes):
        rows.append((k * 200, ("failed" if k in bad else "success",), [track(n + i, i < 2 or i < size - 1) for i in range(size)]))
        n += size
    pages = spark.createDataFrame(list(reversed(rows)), PAGE).repartition(3)
    return sorted(int(r.source_id) for r in catalogs.jamendo_items(pages, stop, limit).collect())


def plain(sizes, limit=None, stop=3, bad=()):
    seen, run, n, out = 0, 0, 0, []
    for k, size in enumerate(sizes):
        own = [n + i for i in range(size) if i < 2 or i < size - 1]
        n += size
        if k in bad:
            continue
        if limit is not None and seen >= limit:
            break
        run = run + 1 if not size else 0
        if run >= stop:
            break
        out += own
        seen += len(own)
    return out


@pytest.mark.parametrize("case", [dict(sizes=[3, 2, 4, 2]), dict(sizes=[3, 3, 3], limit=3), dict(sizes=[3, 3, 3], limit=4), dict(sizes=[3], limit=0), dict(sizes=[2, 0, 0, 2, 0, 0, 0, 2]), dict(sizes=[2, 0, 2, 0, 2], stop=2), dict(sizes=[0, 2], stop=1), dict(sizes=[2, 2, 2], bad=(1,)), dict(sizes=[4] * 30 + [0] * 5 + [4] * 3, limit=61)])
def test_a_walk_ends_as_the_loop_does(spark, case):
    assert walk(spark, **case) == plain(**case)


def test_items_are_counted_by_page_and_end_at_an_empty_page(spark):
    page = lambda k, n: (k, [(f"i{k}-{j}", "t", "u", None) for j in range(n)])
    pages = spark.createDataFrame([page(0, 3), page(1, 3), page(2, 0), page(3, 3)], "offset long, items array<struct<identifier:string,title:string,licenseurl:string,rights:string>>")
    count = lambda limit: catalogs.archive_pages(pages, limit).count()
    assert [count(x) for x in (None, 0, 1, 3, 4, 99)] == [6, 0, 3, 3, 6, 6]


def test_new_items_are_counted_one_by_one(spark):
    items = spark.createDataFrame([("fma", str(i)) for i in [10, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9]], "source string, source_id string")
    known = spark.createDataFrame([("fma", "2"), ("fma", "4"), ("other", "1")], "source string, source_id string")
    ids = lambda limit, old: sorted({int(r.source_id) for r in catalogs.up_to_admitted(items, old, limit).collect()})

    def plain(limit, old):
        out, new, seen = [], 0, set(old)
        for i in sorted(int(r.source_id) for r in items.collect()):
            if limit is not None and new >= limit:
                break
            out.append(i)
            new, seen = new + (i not in seen), seen | {i}
        return sorted(set(out))  # a repeat goes with its item

    for limit in (None, 0, 1, 2, 3, 50):
        assert ids(limit, known) == plain(limit, [2, 4]), limit
    assert ids(3, None) == [1, 2, 3]


def test_a_header_may_stand_far_down(spark, tmp_path):
    notes = "".join(f"note {i},,\n" for i in range(30))
    (tmp_path / "t.csv").write_text(notes + ",track,track\ntrack_id,title,license\n2,T,Public Domain\n")
    assert [(r.track_id, r.title) for r in catalogs.two_header_csv(spark, str(tmp_path / "t.csv")).collect()] == [(2, "T")]
    (tmp_path / "u.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="track_id"):
        catalogs.two_header_csv(spark, str(tmp_path / "u.csv"))


def test_landed_pages_are_read_by_ranges_of_offsets(spark, tmp_path):
    landed.register(spark)
    for k in (0, 1, 2, 5, 11):
        (tmp_path / f"p{k * 200}.json").write_text(json.dumps({"headers": {"status": "success"}, "results": [{"id": str(k)}]}))
    (tmp_path / "notes.txt").write_text("x")
    read = spark.read.format("landed_pages").option("path", str(tmp_path)).option("name", "p{offset}.json").option("pages", "3")
    pages = read.load()
    assert pages.rdd.getNumPartitions() == 4 and sorted(r.offset for r in pages.collect()) == [0, 200, 400, 1000, 2200]
    assert sorted(r.offset for r in read.option("last", "1000").load().collect()) == [0, 200, 400, 1000]
    assert spark.read.format("landed_pages").option("path", str(tmp_path / "none")).load().count() == 0


def test_messages_are_pulled_in_bounded_batches_and_go_on_after_a_restart(spark, tmp_path):
    landed.register(spark)
    raw = tmp_path / "raw"
    raw.mkdir()
    write = lambda k, n: (raw / f"{k:03d}.txt").write_text("\n".join(f"{k}-{i}" for i in range(n)))
    sizes, got = [], []

    def run():
        def take(batch, number):
            rows = [r.value for r in batch.collect()]
            sizes.append(len(rows))
            got.extend(rows)

        query = spark.readStream.format("pulled_messages").option("path", str(raw)).option("batch", "40").load().writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "ck")).start()
        query.processAllAvailable()
        query.stop()

    write(0, 25)
    write(1, 90)
    run()
    assert max(sizes) == 40 and got == [f"0-{i}" for i in range(25)] + [f"1-{i}" for i in range(90)]
    write(2, 7)
    run()
    assert got[115:] == [f"2-{i}" for i in range(7)]
    assert landed.PulledMessagesReader({"path": str(raw), "batch": "9000"}).most == 500


def test_a_landed_walk_and_a_pulled_stream_feed_the_operators(spark, tmp_path):
    from corpusloom.plans.schemas import EDGE
    from corpusloom.sources import tables

    (tmp_path / "j").mkdir()
    for k, n in enumerate([2, 2, 0, 0, 0, 2]):
        (tmp_path / "j" / f"{k * 200}.json").write_text(json.dumps({"headers": {"status": "success"}, "results": [{"id": f"{k}-{i}", "license_ccurl": "http://c/licenses/by/3.0/", "audiodownload": "x", "audiodownload_allowed": True} for i in range(n)]}))
    pages = catalogs.landed_pages(spark, str(tmp_path / "j"), catalogs.JAMENDO_PAGE, pages="2")
    assert sorted(r.source_id for r in catalogs.jamendo_items(pages).collect()) == ["0-0", "0-1", "1-0", "1-1"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.txt").write_text("\n".join([json.dumps({"url": f"u{i}", "job_id": "j"}) for i in range(12)] + ["broken"]))
    sizes = []
    good, bad = tables.messages(spark, str(tmp_path / "m"), EDGE, pull=5)
    query = good.writeStream.foreachBatch(lambda batch, number: sizes.append(batch.count())).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert sizes == [5, 5, 2]
